import hashlib
import random
import zlib

import numpy as np
import pytest

from maskweave.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
ANSWER = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def base_of(c):
    return c - (c % 100 if c >= 0 else -(-c % 100))


def rebuilt(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(base_of(c), [])[: heads[c]] + v[heads[c] :] for c, v in own.items()}


def plain(rows):
    whole = rebuilt(rows)
    members, children = {}, {}
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    for n in members:
        if n:
            children.setdefault(n[:-1], []).append(n)
    below, out = {}, []
    for n in sorted(members, key=len, reverse=True):
        kids = children.get(n, [])
        leaves = sum(below[k][0] for k in kids) or 1
        saved = sum(below[k][1] for k in kids) + ((len(members[n]) - 1) * len(n[-1][1]) if n else 0)
        below[n] = leaves, saved
        ends = ",".join(str(c) for c in sorted(members[n]) if len(whole[c]) == len(n))
        up = min(members[n[:-1]]) if n else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(members[n]), len(n), up, len(members[n]), len(kids), leaves, saved, sha))
    return out


def check(spark, rows, **more):
    df = spark.createDataFrame([(*r, 9, 9) for r in rows], SCHEMA + ", d int, f int")
    got = prefix_trie.trie(df, **more)
    assert got.columns == ANSWER
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain(rows)))


def some(seed, convs, words=3, longest=9):
    rng = random.Random(seed)
    return [
        (c, t, rng.choice(["user", "bot"]), rng.choice(["a", "bb", "ç🎉"][:words]))
        for c in convs
        for t in range(rng.randint(1, longest))
    ]


def test_against_plain_tries(spark):
    check(spark, some(1, [*range(0, 60), *range(100, 130), *range(-120, -90), 5000, 5001]))


def test_awkward_turns(spark):
    rows = some(2, range(20), words=2)
    rows += [(None, 1, "user", "lost"), (3, None, "user", "first"), (30, None, None, None), (31, 1, None, "")]
    rows += [(100, 2, "user", "x" * 100_000), (101, -5, "user", "y"), (102, 7, "user", "é" * 70_000)]
    rows += [(7, 50, "user", "same")] * 3 + [(205, 0, "user", "no base")]
    check(spark, rows)
    check(spark, [])
    check(spark, [(None, 1, "user", "x")])
    check(spark, [(104, 0, "a", "b")])  # its only turn lies in the head it does not get


def test_one_conversation_over_many_partitions_and_one_hot_path(spark):
    rng = random.Random(3)
    rows = [(200, t, "user", rng.choice(["a", "b"])) for t in range(3000)]
    rows += [(c, t, "user", "hello"[: t + 1]) for c in range(201, 299) for t in range(7)]
    rows += some(4, range(300, 320))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ids_of_a_node_are_hashed_in_order_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_PER_CHUNK", 7)
    ends = spark.range(500).selectExpr("1L AS d", "id % 3 AS f", "0L AS g", "id * 1000003 AS conv_id")
    got = {r["f"]: r["ends_sha256"] for r in prefix_trie._hashed_ids(ends).collect()}
    for f in range(3):
        ids = ",".join(str(i * 1000003) for i in range(500) if i % 3 == f)
        assert got[f] == hashlib.sha256(ids.encode()).hexdigest()


def test_products_compose():
    of = prefix_trie.bases(1)
    rng = np.random.default_rng(0)
    turns = rng.integers(0, prefix_trie.PRIME, (40, prefix_trie.LANES))

    def product(rows):
        at = prefix_trie.Powers(of).at(np.arange(1, len(rows) + 1))
        return (rows * at % prefix_trie.PRIME).sum(axis=0) % prefix_trie.PRIME

    shift = np.array([pow(b, 15, prefix_trie.PRIME) for b in of])
    joined = (product(turns[:15]) + shift * product(turns[15:])) % prefix_trie.PRIME
    assert (joined == product(turns)).all()


def test_a_collision_is_found_and_other_bases_are_taken(spark, monkeypatch):
    rows = some(6, range(40), longest=4)
    of = prefix_trie.bases
    # With B = 0 in every lane all prefixes of one depth have one fingerprint.
    monkeypatch.setattr(prefix_trie, "bases", lambda seed: of(seed) if seed > 1 else [prefix_trie.PRIME] * 4)
    monkeypatch.setattr(prefix_trie, "pow", lambda b, e, m: 0 if b % m == 0 and e < 0 else pow(b, e, m), raising=False)
    check(spark, rows)


@pytest.mark.parametrize("seed", [2, 7])
def test_any_seed_gives_the_same_rows(spark, seed):
    check(spark, some(5, range(95, 140)), first_seed=seed)
