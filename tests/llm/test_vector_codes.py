import hashlib
import math
import random

import numpy as np
import pytest

from maskweave.llm import vector_codes

SCHEMA = "vec_id bigint, embedding array<{}>, label int"


def floor256(x):
    return int(x) * 256 if abs(x) >= 2**53 else math.floor(x * 256)


def plain(rows, parts=16, entries=64, rounds=2):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    out = []
    for dim in sorted({len(r[1]) for r in kept}):
        mine = sorted((r for r in kept if len(r[1]) == dim), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        width = -(-dim // parts)
        points = []
        for r in mine:
            v = [floor256(x) for x in r[1]] + [0] * (width * parts - dim)
            points.append([v[p * width : (p + 1) * width] for p in range(parts)])
        books = [[x[p] for x in points[:entries]] for p in range(parts)]

        def near(x, book):
            return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

        for _ in range(rounds):
            for p in range(parts):
                groups = {}
                for x in points:
                    groups.setdefault(near(x[p], books[p])[1], []).append(x[p])
                for e, xs in groups.items():
                    books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
        sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for r, x in zip(mine, points):
            best = [near(x[p], books[p]) for p in range(parts)]
            out.append((r[0], "".join(f"{i:02x}" for _, i in best), sum(d for d, _ in best), r[2], sha))
    sums = {}
    for r in out:
        sums[r[3]] = sums.get(r[3], 0) + r[2]
    return [(i, code, min(e, 2**63 - 1), min(sums[label], 2**63 - 1), sha) for i, code, e, label, sha in out]


def check(spark, rows, of="double"):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA.format(of) + ", error int, code string")
    if of == "float":
        rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    got = vector_codes.digest(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain(rows)))


@pytest.mark.parametrize("dim,n", [(32, 300), (64, 40), (16, 150)])
def test_against_plain_rounds(spark, dim, n):
    rng = random.Random(dim)
    rows = [(rng.randrange(10**6), [rng.gauss(0, 0.2) for _ in range(dim)], rng.choice([None, 1, 2])) for _ in range(n)]
    check(spark, rows, "float")


def test_awkward_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([0.0, 0.25, -0.5]) for _ in range(20)], i % 3) for i in range(80)]
    rows += [(7, rows[3][1], 1), (7, rows[3][1], 1), (None, rows[4][1], None), (None, rows[5][1], 0)]
    rows += [(200, None, 1), (201, [1.0, None] * 10, 1), (202, [math.nan] * 20, 1), (203, [math.inf] * 20, 1)]
    rows += [(300, [], 1), (301, [], 2), (302, [1.0], 1), (303, [-1.0], 1), (304, [0.5] * 33, None)]
    check(spark, rows)
    check(spark, [])


def test_components_of_any_size(spark):
    rng = random.Random(6)
    sizes = [1.0, 1e6, 1e19, 1e200, 1.7e308, 5e-324]
    rows = [(i, [rng.choice([-1, 1]) * rng.choice(sizes) * rng.random() for _ in range(16)], 0) for i in range(90)]
    check(spark, rows)


def test_one_vector_shared_by_most_rows(spark):
    rows = [(i, [0.5] * 16, 0) for i in range(300)] + [(1000 + i, [i / 7] * 16, 1) for i in range(80)]
    check(spark, rows)


@pytest.mark.parametrize("width,k", [(1, 64), (4, 64), (4, 3), (7, 33)])
def test_candidates_hold_every_nearest_entry(width, k):
    rng = np.random.default_rng(width * k)
    entries = rng.integers(-50, 50, (k, width))
    entries[k // 2] = entries[0]
    points = rng.integers(-60, 60, (500, width))
    slices = vector_codes.Slices(entries)
    far = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
    masks = slices.candidates(points)
    for row, mask in zip(far, masks):
        for e in np.flatnonzero(row == row.min()):
            assert int(mask) >> int(e) & 1
    which, least = slices.nearest(points)
    assert (which == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()
    if width == 4 and k == 64:
        assert np.mean([bin(int(m)).count("1") for m in masks]) < k / 3
