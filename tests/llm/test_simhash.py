import random
import re

import numpy as np
import xxhash

from maskweave.llm import simhash
from maskweave.llm.components import components
from tests.llm.conftest import prose


def plain_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_golay_code_is_perfect():
    nearest, distance = simhash._golay()
    assert distance.max() == 3 and len(np.unique(nearest)) == 4096
    assert (np.bitwise_count(nearest ^ np.arange(1 << 23, dtype=np.uint32)) == distance).all()


def test_every_close_pair_shares_a_key():
    rng = random.Random(3)
    base = np.array([rng.getrandbits(64) for _ in range(2000)], np.uint64)
    other = base.copy()
    for k in range(len(base)):
        for b in rng.sample(range(64), rng.randint(1, 3)):
            other[k] ^= np.uint64(1 << b)
    keys = []
    for prints in (base, other):
        found = {}
        for row, key in zip(*map(np.ndarray.tolist, simhash.bucket_keys(prints))):
            found.setdefault(row, set()).add(key)
        keys.append(found)
    assert all(keys[0][k] & keys[1][k] for k in range(len(base)))
    assert max(map(len, keys[0].values())) <= 6 * 22 + 8
    assert len(simhash.bucket_keys(base)[0]) < 50 * len(base)


def test_bucket_links_keep_components():
    rng = random.Random(5)
    for _ in range(20):
        prints = [0x1234]
        while len(prints) < 80:
            p = rng.choice(prints) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6)))
            if p not in prints:
                prints.append(p)
        values = np.array(prints, np.uint64)
        a, b = simhash.bucket_links(values)
        assert len(a) < len(prints)
        want = plain_components(prints)
        got = list(range(len(prints)))
        for _ in range(len(prints)):
            for i, j in zip(a.tolist(), b.tolist()):
                got[i] = got[j] = min(got[i], got[j])
        assert [want.index(w) for w in want] == [got.index(g) for g in got]


def near_copies():
    rows = [(100 + n, prose(n, 80), "en", "s") for n in range(12)]
    for n in range(40):
        words = prose(n % 4, 80).split(" ")
        words[n % 70] = "changed"
        rows.append((200 + n, " ".join(words), "en", "s"))
    return rows


def test_digest(make_docs, awkward, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT_ROWS", 3)
    docs = make_docs(near_copies()).union(awkward)
    rows = docs.collect()
    prints = [plain_fingerprint(r["text"]) for r in rows]
    group = plain_components(prints)
    least = {}
    for r, g in zip(rows, group):
        if r["doc_id"] is not None:
            least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    want = sorted(
        [(r["doc_id"], f"{p:016x}", least.get(g)) for r, p, g in zip(rows, prints, group)], key=repr
    )
    assert sorted(map(tuple, simhash.digest(docs).collect()), key=repr) == want
    kept = simhash.without_near_copies(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=repr) == sorted([least.get(g) for g in set(group)], key=repr)


def test_empty_and_clashing(nothing, awkward):
    assert simhash.digest(nothing).collect() == []
    assert simhash.without_near_copies(nothing).collect() == []
    df = awkward.withColumnRenamed("source", "__fp").withColumnRenamed("lang", "__row")
    assert simhash.without_near_copies(df).columns == df.columns


def test_components(spark):
    edges = [(n, n + 1) for n in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (200, 200), (None, 3)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({found[n] for n in range(61)}) == 1
    assert found[100] == found[101] != found[0]
    assert found[200] == 200
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
