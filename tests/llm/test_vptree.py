import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskweave.llm import vptree
from maskweave.llm.common import read
from tests.llm.conftest import SAMPLE, needs_data

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, is_query, k):
    """All pairs, in double precision on the float vectors."""
    good = {}
    for i, v in rows:
        if i is None or v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        v = np.array(v, np.float32).astype(np.float64)
        if i not in good or v.tolist() < good[i].tolist():
            good[i] = v
    out = {}
    for q, a in good.items():
        if not is_query(q):
            continue
        scored = []
        for i, b in good.items():
            if i != q and len(a) == len(b):
                score = (a * b).sum() / (math.sqrt((a * a).sum()) * math.sqrt((b * b).sum()))
                scored.append((-score, i))
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def vectors(seed, n, dim, copies=0):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(copies)]
    return rows


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def same(got, want):
    assert set(got) == {q for q, found in want.items() if found}
    for q in got:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)


@pytest.mark.parametrize("dim,copies", [(3, 0), (8, 60), (32, 0)])
def test_factor_one_is_exact(spark, dim, copies):
    rows = vectors(dim, 700, dim, copies)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    found = vptree.nearest(df, lambda i: i % 7 == 0, relax=1.0, shard_rows=150, query_block=40)
    same(answers(found), plain(rows, lambda i: i % 7 == 0, 5))


def test_awkward_vectors(spark):
    rows = [
        (0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, []),
        (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0, 1.0]), (8, [1.0, 1.0]),
        (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (100, [0.0, 1.0, 0.0]), (150, [0.0]), (200, [3.0]),
        (10, [-1.0, 0.0]), (11, [1e-30, 1e-30]), (12, [1e30, -1e30]),
    ]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumn("v", F.lit("other"))
    found = vptree.digest(df)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    got = answers(found)
    want = plain(rows, lambda i: i % 50 == 0, 5)
    assert set(got) == {q for q, f in want.items() if f}
    for q in got:
        assert sorted(round(s, 9) for _, s in got[q]) == sorted(round(s, 9) for _, s in want[q])
    assert vptree.digest(df.limit(0)).collect() == []


def by_scores(rows, k, every):
    """Brute force with the operator's own measure: ids as well as scores."""
    ids = np.array([i for i, _ in rows])
    v = vptree._scaled(np.array([v for _, v in rows], dtype=np.float64))
    out = {}
    for n in np.flatnonzero(ids % every == 0):
        score = vptree._cosines(np.repeat(v[n : n + 1], len(v), axis=0), v)
        order = [m for m in np.lexsort((ids, -score)) if m != n][:k]
        out[int(ids[n])] = [(int(ids[m]), float(score[m])) for m in order]
    return out


@pytest.mark.parametrize("relax", [1.0, 0.8])
def test_ties_of_direction_and_components_of_any_size(spark, relax):
    rng = random.Random(11)
    base = [rng.gauss(0, 1) for _ in range(6)]
    rows = [(i, [x * i for x in base]) for i in range(1, 401)]
    rows += [(400 + i, [x * 2.0**i for x in base]) for i in range(-300, 300) if i % 2 and 400 + i > 400]
    big = [[rng.gauss(0, 1) * 10.0 ** rng.choice([-200, 0, 200]) for _ in range(6)] for _ in range(100)]
    rows += [(1000 + i, v) for i, v in enumerate(big)]
    rows += [(2000 + i, [x * 1e-200 for x in base]) for i in range(3)] + [(3000, [1e-310] * 6), (3050, [1.7e308] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for shard_rows in (10_000, 200):
        found = vptree.nearest(df, lambda i: i % 50 == 0, relax=relax, shard_rows=shard_rows, query_block=7)
        got = answers(found)
        want = by_scores(rows, 5, 50)
        assert got.keys() == want.keys()
        if relax == 1.0:
            assert got == want
        else:
            assert sum(got[q] == want[q] for q in want) >= 0.9 * len(want)
        assert all(math.isfinite(s) for a in got.values() for _, s in a)


@needs_data
def test_recall(spark):
    df = read(spark, SAMPLE, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = plain(rows, lambda i: i % 50 == 0, 5)
    got = answers(vptree.nearest(df, lambda i: i % 50 == 0, shard_rows=200))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
