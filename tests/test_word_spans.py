"""Words, candidate spans and score suppression over long inputs and repeated keys."""

import random
import re

from pyspark.sql import functions as F

from maskweave.functions import spans as S
from maskweave.operators import detect as D
from maskweave.operators import model as M
from maskweave.plans import inputs as I
from maskweave.plans.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_of_many_rows_keep_their_places(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices(["ab", "é", "\U0001f600", " ", "\n", "\u2003", "-", "."], k=n)) for n in (0, 1, 9, 700, 9000)]
    texts = [*texts * 30, None, "   ", "x" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    found = {r.id: r.words for r in M.with_words(df).collect()}
    for i, t in enumerate(texts):
        want = [(m.start(), m.end(), m[0]) for m in re.finditer(r"\w+(?:[-_]\w+)*|\S", t or "")]
        assert [tuple(w) for w in found[i]] == want


def test_words_are_found_without_a_fold(spark):
    df = spark.createDataFrame([(1, "a b", "v")], "id int, text string, value string")
    assert "aggregate(" not in plan(M.word_tokens(df, "id"))
    assert M.word_tokens(df, "id", "value").collect() == [(1, "v", 0, "a", 0, 1), (1, "v", 1, "b", 2, 3)]


def test_candidates_in_the_row_are_those_of_the_rows(spark):
    df = spark.createDataFrame([(1, "a bb, c d e"), (2, ""), (3, None)], "id int, text string")
    for width in (1, 3, 8):
        rows = M.candidate_spans(df, "id", max_width=width)
        nested = M.candidate_spans(df, "id", max_width=width, nested="c")
        assert nested.count() == 3
        assert nested.select("id", F.inline("c")).collect() == rows.collect()
    assert "aggregate(" not in plan(rows)


def turns(spark, folder):
    rows = [(1, 0, "u", "a b c"), (1, 0, "a", "dd e"), (1, 0, "a", "dd e"), (1, 1, "u", None), (2, None, "u", "x y"), (None, 3, "u", "p q")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(
        f"{folder}/conversations.parquet"
    )
    return str(folder)


def test_scored_arrays_are_the_scored_spans_of_each_turn(spark, tmp_path):
    sf = turns(spark, tmp_path)
    key = ["conv_id", "turn"]
    want = {}
    for r in I.scored_spans(spark, sf).collect():
        want.setdefault((r.conv_id, r.turn), []).append((r.start, r.end, r.label, r.score))
    got = {
        (r.conv_id, r.turn): [(s.start, s.end, s.label, s.score) for s in r.found]
        for r in I.scored_arrays(spark, sf).collect()
    }
    assert got == {k: sorted(v) for k, v in want.items()}
    strong = D.explode_spans(I.scored_arrays(spark, sf).select(*key, F.col("found").alias("spans")), *key)
    n = strong.where("score >= 0.5").count()
    assert sum(r.n for r in QUERIES["score_threshold"](spark, sf).collect()) == n


def test_only_texts_are_shuffled_and_spans_suppressed_once(spark, tmp_path):
    sf = turns(spark, tmp_path)
    shown = plan(QUERIES["nms_spans"](spark, sf))
    assert shown.count("ArrowEvalPython [numbers(") == 1
    assert "collect_list(text" in shown


def test_suppression_of_more_spans_than_one_run_of_a_batch(spark):
    a = F.sequence(F.lit(0), F.lit(19_999))
    span = lambda i: F.struct(i.cast("bigint").alias("start"), (i + 2).cast("bigint").alias("end"),
                              F.lit("x").alias("label"), (F.lit(1.0) - i / 100_000).alias("score"))
    df = spark.range(0, 30, 1, 1).select("id", F.transform(a, span).alias("found"))
    kept = df.select("id", S.suppressed("found").alias("s")).select("id", F.size("s").alias("n"), F.get("s", F.lit(7))["start"].alias("at"))
    assert kept.distinct().count() == 30
    assert {(r.n, r["at"]) for r in kept.collect()} == {(10_000, 14)}
    assert [*S._cuts(__import__("numpy").array([3, 3, 9, 0, 1]), 6)] == [(0, 2), (2, 1), (3, 2)]
