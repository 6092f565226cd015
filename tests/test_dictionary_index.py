"""The dictionary path for policies of any size: an index of grams and a join."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskweave.operators import dictionary as DD
from maskweave.operators import dictionary_index as DI
from maskweave.operators.policy import POLICY_SCHEMA

LETTERS = "abcdeé ß-😀I"


def by_key(df, key="id"):
    return {r[key]: [(s.start, s.end, s.label, s.value) for s in r.spans] for r in df.collect()}


def both(df, policy, **how):
    index = DD.with_dictionary_spans(df, policy, out="spans", max_forms=0, chunk_bytes=0, **how)
    auto = DD.with_dictionary_spans(df, policy, out="spans", max_forms=0, chunks=True, **how)
    return by_key(index), by_key(auto)


def random_policy(rng, n, longest):
    rows = []
    for i in range(n):
        form = "".join(rng.choice(LETTERS) for _ in range(rng.randint(1, longest)))
        scope = rng.choice(["global", "a", "b"])
        rows.append((i, "deny", form, f"L{i}", scope, [form[::-1]], "", rng.random() < 0.4))
    return rows


@pytest.mark.parametrize("seed,longest", [(1, 3), (2, 9), (3, 20)])
def test_same_spans_as_the_automaton(spark, seed, longest):
    rng = random.Random(seed)
    policy = spark.createDataFrame(random_policy(rng, 150, longest), POLICY_SCHEMA)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    rows = [(i, t, rng.choice([None, "A", "b", "other"]), 1) for i, t in enumerate(texts)]
    # Nulls, an empty text, copies, a null key, a clashing column.
    rows += [(100, None, "a", 1), (101, "", None, 1), (102, texts[0], rows[0][2], 1), (None, texts[1], "a", 1)]
    df = spark.createDataFrame(rows, "id int, text string, who string, gram int")
    for how in ({}, {"scope": "who"}):
        index, auto = both(df, policy, **how)
        assert index == auto
        assert sum(map(len, index.values())) > 30


def test_large_policy_and_long_text(spark):
    forms = spark.range(200_000).select(
        F.col("id").alias("ord"),
        F.lit("deny").alias("list"),
        F.concat(F.lit("Agent "), F.hex(F.xxhash64("id"))).alias("term"),
        F.lit("CODE").alias("label"),
        F.lit("global").alias("scope"),
        F.array().cast("array<string>").alias("aliases"),
        F.lit("").alias("source"),
        (F.col("id") % 2 == 0).alias("whole_word"),
    )
    known = [r[0] for r in forms.orderBy("ord").limit(40).select("term").collect()]
    long = ("x" * 997 + " ").join(known * 5) + " agent ffff"
    df = spark.createDataFrame([(0, " and ".join(known)), (1, long), (2, "Agent nobody")], "id int, text string")
    index, auto = both(df, forms)
    assert index == auto
    # In the long text letters follow each term: the whole words among them, half, are none there.
    assert [len(index[i]) for i in range(3)] == [40, 100, 0]


def test_the_plan_broadcasts_no_form(spark, make_policy):
    policy = make_policy(*[("deny", f"term number {n}", "T") for n in range(100)])
    df = spark.createDataFrame([(1, "a term number 7 here")], "id int, text string")
    rows = DD.with_dictionary_spans(df, policy, out="spans", max_forms=0, chunk_bytes=0)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner, .*\(gram#\d+L = gram#\d+L\)", plan)
    assert by_key(rows) == {1: [(2, 15, "T", "term number 7")]}


def test_each_form_is_indexed_under_its_rarest_gram(spark, make_policy):
    policy = make_policy(*[("deny", f"common prefix {c * 6}", "T") for c in "abcdefgh"], ("deny", "ab", "T"))
    forms = DD.hidden_forms(policy).select(*DI.FORM_COLUMNS)
    rows = DI.gram_index(forms).collect()
    for r in rows:
        folded = r["form"].lower()
        assert r["gram"] == int(DI.gram_hashes(folded, min(6, len(folded)))[r["at"]].astype(np.int64))
    assert len({r["gram"] for r in rows}) == len(rows)


def test_automata_of_all_chunks_are_built_once_within_the_budget(monkeypatch):
    built = []

    class Sent:
        def __init__(self, name, size):
            self.value = {"id": name, "forms": [("global", name, "L", False, 0, 0)], "bytes": size}

    import ahocorasick

    real = ahocorasick.Automaton
    monkeypatch.setattr(ahocorasick, "Automaton", lambda: built.append(1) or real())
    monkeypatch.setattr(DD, "_WORKER", DD.OrderedDict())
    chunks = [Sent(f"chunk{i}", DD.CHUNK_BYTES) for i in range(2)]
    for _ in range(5):
        for c in chunks:
            assert DD._automaton(c).get(c.value["id"])[0] == len(c.value["id"])
    assert len(built) == 2
    DD._automaton(Sent("chunk3", DD.CHUNK_BYTES))
    assert len(DD._WORKER) == 2 and "chunk0" not in DD._WORKER
