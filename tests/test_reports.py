"""Most frequent values, rollup, best labels of each item."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskweave.operators import metrics as MT
from maskweave.operators import model as M


def plain_top(values, k):
    return [(v, n) for v, n in sorted(Counter(values).items(), key=lambda x: (-x[1], x[0] is not None, x[0] or ""))[:k]]


@pytest.mark.parametrize("counters", [4, 30, 4096])
def test_top_values_are_exact_whatever_the_sketch_holds(spark, counters):
    rng = random.Random(counters)
    heavy = [f"h{i}" for i in range(6) for _ in range(400 - 40 * i)]
    values = [*heavy, *[f"once{i}" for i in range(3000)], *[None] * 150, *["tie a"] * 90, *["tie b"] * 90]
    rng.shuffle(values)
    df = spark.createDataFrame([(v, 1) for v in values], "value string, n int").repartition(4)
    got = [tuple(r) for r in MT.top_values(df, 8, counters=counters).collect()]
    assert got == plain_top(values, 8)
    assert [tuple(r) for r in MT.top_values(df, 5000, counters=counters).collect()] == plain_top(values, 5000)
    assert MT.top_values(df.limit(0), 3).collect() == []


def test_top_values_where_no_value_stands_out(spark):
    df = spark.range(5000).select(F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("value"))
    got = [tuple(r) for r in MT.top_values(df, 3, counters=10).collect()]
    assert got == [("v00000", 1), ("v00001", 1), ("v00002", 1)]


def test_rollup_tells_nulls_from_subtotals(spark):
    rows = [("a", None, "x"), ("a", "E", "x"), ("a", "E", "y"), (None, "E", "x")]
    df = spark.createDataFrame(rows, "who string, label string, value string")
    got = {(r.who, r.label, r.level): (r.redactions, r.distinct_values) for r in MT.redactions_rollup(df, "who", "label").collect()}
    assert got == {
        ("a", None, 0): (1, 1), ("a", "E", 0): (2, 2), (None, "E", 0): (1, 1),
        ("a", None, 1): (3, 2), (None, None, 1): (1, 1), (None, None, 2): (4, 2),
    }


@pytest.mark.parametrize("block", [7, 4096])
def test_best_labels_in_blocks(spark, block):
    rng = np.random.default_rng(block)
    x, y = rng.normal(size=(50, 6)), rng.normal(size=(30, 6))
    y[10] = y[3]  # a tie
    items = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [1.0, None]), (102, [1.0])]
    labels = [(f"l{i:02}", v.tolist()) for i, v in enumerate(y)] + [("none", None)]
    got = M.label_top_k(
        spark.createDataFrame(items, "id int, embedding array<double>"),
        spark.createDataFrame(labels, "label string, vector array<double>"), "id", 4, block=block,
    )
    found = {}
    for r in got.orderBy("id", "rank").collect():
        found.setdefault(r.id, []).append((r.label, round(r.logit, 9)))
    assert found == {
        i: sorted(((f"l{j:02}", round(float(x[i] @ y[j]), 9)) for j in range(30)), key=lambda e: (-e[1], e[0]))[:4]
        for i in range(50)
    }
