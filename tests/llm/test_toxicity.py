import math
import random

import numpy as np
from pyspark.sql import functions as F

from maskweave.llm import toxicity as T
from maskweave.llm.common import fold, held_out
from tests.llm.conftest import AWKWARD, prose


def labelled(n=600):
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(n):
        words = prose(5000 + k, 60).split(" ")
        toxic = k % 4 == 0
        if toxic:
            for w in rng.sample(["vileword", "nastyword", "badword", "grimword"], 3):
                words.insert(rng.randrange(len(words)), w)
        rows.append((k, " ".join(words), "en", "s"))
        labels.append((k, int(toxic)))
    return rows, labels


def test_ftrl_follows_the_published_update():
    m = T.Ftrl(0.5, 1.0, 0.2, 0.3)
    z = {1: 0.0, 2: 0.0}
    n = {1: 0.0, 2: 0.0}

    def weight(i):
        if abs(z[i]) <= 0.2:
            return 0.0
        return -(z[i] - math.copysign(0.2, z[i])) / ((1.0 + math.sqrt(n[i])) / 0.5 + 0.3)

    for at, y in [([1, 2], 1), ([1], 0), ([2], 1), ([1, 2], 1), ([2], 0)]:
        p = 1 / (1 + math.exp(-sum(weight(i) for i in at)))
        w = {i: weight(i) for i in at}
        for i in at:
            g = p - y
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.5
            z[i] += g - sigma * w[i]
            n[i] += g * g
        m.learn(np.array(at), y)
    assert np.allclose(m.z[[1, 2]], [z[1], z[2]]) and np.allclose(m.n[[1, 2]], [n[1], n[2]])
    assert np.allclose(m.weights(np.array([1, 2])), [weight(1), weight(2)])


def test_features_do_not_cross_texts():
    f = T.Features()
    doc, bucket = f(["one two three", "", "four", "five six"])
    each = [sorted(bucket[doc == k].tolist()) for k in range(4)]
    assert [len(e) for e in each] == [1 + 3 + 2 + 1, 1, 2, 1 + 2 + 1]
    for k, text in enumerate(["one two three", "", "four", "five six"]):
        assert sorted(T.Features()([text])[1].tolist()) == each[k]


def test_held_out_rows(spark, make_docs):
    rows, labels = labelled()
    docs = make_docs(rows)
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = T.fit(T.sample(docs, marks, fold() != 1))
    assert 0 < len(model[0]) < 5000
    out = T.scored(docs, spark.sparkContext.broadcast(model)).withColumn("held", held_out())
    told = {r["doc_id"]: r for r in out.where("held").collect()}
    truth = dict(labels)
    right = sum((told[k]["score"] >= T.THRESHOLD) == bool(truth[k]) for k in told)
    assert len(told) > 100 and right >= 0.97 * len(told)


def test_sample_is_bounded_and_takes_one_label_per_id(spark, make_docs):
    docs = make_docs([(k, "a b", "en", "s") for k in range(40)] + [(2, "c", "en", "s")] * 50)
    marks = [(k, 0) for k in range(40)] + [(3, 1), (None, 1), (4, None)]
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int")
    drawn = T.sample(docs, labels, F.lit(True), rows=10)
    assert drawn.count() == drawn.select("doc_id").distinct().count() == 10
    every = T.sample(docs, labels, F.lit(True)).collect()
    assert len(every) == 40 and {r["y"] for r in every if r["doc_id"] == 3} == {1}
    assert [r["text"] for r in every if r["doc_id"] == 2] == ["a b"]


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (4, 0), (8, 1), (7, 0)], "doc_id bigint, toxic int")
    model = T.fit(T.sample(awkward, labels, F.lit(True)))
    sent = spark.sparkContext.broadcast(model)
    rows = T.scored(awkward.withColumn("score", F.lit("old")), sent).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in rows)
    base = {r["score"] for r in rows if not any(c.isalpha() for c in r["text"] or "")}
    assert len(base) == 1
    assert T.scored(nothing, sent).collect() == []
    none = T.fit(T.sample(awkward, labels.limit(0), F.lit(True)))
    assert {r["score"] for r in T.scored(awkward, spark.sparkContext.broadcast(none)).collect()} == {0.5}
