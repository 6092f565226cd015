"""Masking quality at character level: interval merging, overlap, scores per task."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskweave.functions.spans import settled
from maskweave.functions.text import label_list
from maskweave.operators.ranking import first_n_per_key

# The named label sets and thresholds of the sample configuration.
PRESETS = [
    (
        "general",
        ["person", "full_name", "email", "phone_number", "account_number", "api_key", "city"],
        0.5,
    ),
    ("recall", None, 0.3),
    ("precision", None, 0.7),
    ("small", None, 0.4),
]


def merge_intervals(spans: DataFrame, key: list[str]) -> DataFrame:
    """Union of the half-open ranges per key; touching ranges become one.

    Ranges are cut to one per start first, so the window per key is bounded by the length of
    the text the ranges lie in.
    """
    starts = spans.where(F.col("end") > F.col("start")).groupBy(*key, "start").agg(
        F.max("end").alias("end")
    )
    w = Window.partitionBy(*key).orderBy("start")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = starts.withColumn(
        "__new", F.when(F.col("start") <= reach, F.lit(0)).otherwise(F.lit(1))
    )
    return (
        opened.withColumn(
            "__group", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
        )
        .groupBy(*key, "__group")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("__group")
    )


def _edge(at: Column, gold: int, pred: int) -> Column:
    return F.struct(
        F.greatest(at, F.lit(0)).cast("bigint").alias("at"),
        F.lit(gold).alias("gold"),
        F.lit(pred).alias("pred"),
    )


def _both_edges(s: Column, side: str) -> Column:
    g, p = (1, 0) if side == "gold" else (0, 1)
    return F.array(_edge(s["start"], g, p), _edge(s["end"], -g, -p))


def _covered(events: DataFrame, key: list[str], kept: list[str]) -> DataFrame:
    """Sweep over edge events.  Each text also has one event at its length that carries
    ``meta``; whatever lies beyond it does not count."""
    points = events.groupBy(*key, "at").agg(
        F.sum("gold").alias("gold"),
        F.sum("pred").alias("pred"),
        F.first("meta", ignorenulls=True).alias("meta"),
    )
    whole = Window.partitionBy(*key)
    w = whole.orderBy("at")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    size = F.max(F.when(F.col("meta").isNotNull(), F.col("at"))).over(whole)
    stretches = points.select(
        *key,
        "meta",
        F.when(F.col("at") < size, F.lead("at").over(w) - F.col("at")).alias("len"),
        (F.sum("gold").over(so_far) > 0).alias("in_gold"),
        (F.sum("pred").over(so_far) > 0).alias("in_pred"),
        size.alias("size"),
    )

    def chars(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("len"))), F.lit(0)).cast("bigint")

    sums = stretches.groupBy(*key).agg(
        F.first("meta", ignorenulls=True).alias("meta"),
        chars(F.col("in_gold") & F.col("in_pred")).alias("tp_chars"),
        chars(F.col("in_gold")).alias("gold_chars"),
        chars(F.col("in_pred")).alias("pred_chars"),
        F.max("size").alias("size"),
    )
    return sums.select(
        *key,
        *[F.col(f"meta.{c}").alias(c) for c in kept],
        "tp_chars",
        "gold_chars",
        "pred_chars",
        (F.col("size") - F.col("gold_chars")).alias("nonpii_chars"),
    )


def overlap_chars(
    docs: DataFrame, gold: DataFrame, pred: DataFrame, key: list[str], n_chars: str = "n_chars"
) -> DataFrame:
    """Per text: characters covered by gold, by pred, by both, and by no gold.

    A sweep over range ends: +1 where a range opens and -1 where it closes, summed in position
    order, tells for each stretch whether each side covers it.  Linear in the ranges, one
    shuffle by text; no pair of ranges is ever formed.
    """

    def edges(spans: DataFrame, side: str) -> DataFrame:
        fit = spans.where((F.col("end") > F.col("start")) & (F.col("end") > 0))
        both = _both_edges(F.struct("start", "end"), side)
        return fit.select(*key, F.explode(both).alias("x"), F.lit(None).alias("meta"))

    kept = [c for c in docs.columns if c not in key]
    ends = docs.select(
        *key, _edge(F.col(n_chars), 0, 0).alias("x"), F.struct(*kept).alias("meta")
    )
    events = ends.unionByName(edges(gold, "gold")).unionByName(edges(pred, "pred"))
    return _covered(events.select(*key, "x.*", "meta"), key, kept)


def overlap_in_rows(
    rows: DataFrame, key: list[str], kept: list[str], gold: str, pred: str, n_chars: str = "n_chars"
) -> DataFrame:
    """:func:`overlap_chars` for rows that hold both span arrays: nothing leaves the row."""

    def part(side: str, field: str) -> Column:
        return F.transform(side, lambda s: s[field].cast("bigint"))

    ends = [part(side, field) for side in (gold, pred) for field in ("start", "end")]
    size = F.greatest(F.col(n_chars).cast("bigint"), F.lit(0))
    counted = settled(rows, {"__c": _covered_chars()(*ends, size), "__n": size})
    return counted.select(
        *key,
        *kept,
        F.col("__c.both").alias("tp_chars"),
        F.col("__c.gold").alias("gold_chars"),
        F.col("__c.pred").alias("pred_chars"),
        (F.col("__n") - F.col("__c.gold")).alias("nonpii_chars"),
    )


def _union(starts: np.ndarray, stops: np.ndarray) -> int:
    """Positions that at least one of the ranges covers."""
    if not len(starts):
        return 0
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], stops[order]
    reach = np.maximum.accumulate(stops)
    before = np.concatenate(([starts[0]], reach[:-1]))
    return int(np.maximum(stops - np.maximum(starts, before), 0).sum())


@functools.cache
def _covered_chars():
    def ranges(starts, stops, size: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.array(x or [], dtype=np.int64) for x in (starts, stops))
        fit = b > a
        return np.clip(a[fit], 0, size), np.clip(b[fit], 0, size)

    @F.arrow_udf("struct<gold:bigint,pred:bigint,both:bigint>")
    def count(ga: pa.Array, gb: pa.Array, qa: pa.Array, qb: pa.Array, size: pa.Array) -> pa.Array:
        out = []
        for gs, ge, ps, pe, n in zip(*(x.to_pylist() for x in (ga, gb, qa, qb, size))):
            g, p = ranges(gs, ge, n or 0), ranges(ps, pe, n or 0)
            both = [np.concatenate(x) for x in zip(g, p)]
            in_gold, in_pred = _union(*g), _union(*p)
            out.append({"gold": in_gold, "pred": in_pred, "both": in_gold + in_pred - _union(*both)})
        return pa.array(out, pa.struct([(c, pa.int64()) for c in ("gold", "pred", "both")]))

    return count


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def rates(df: DataFrame) -> DataFrame:
    """Precision, recall, F1, F2 and false-positive rate from the four character sums."""
    p = _ratio(F.col("tp_chars"), F.col("pred_chars"))
    r = _ratio(F.col("tp_chars"), F.col("gold_chars"))
    with_pr = df.withColumns({"precision": p, "recall": r})
    p, r = F.col("precision"), F.col("recall")
    return with_pr.withColumns(
        {
            "f1": _ratio(2 * p * r, p + r),
            "f2": _ratio(5 * p * r, 4 * p + r),
            "fpr": _ratio(F.col("pred_chars") - F.col("tp_chars"), F.col("nonpii_chars")),
        }
    )


def masking_score(per_text: DataFrame, task: str) -> DataFrame:
    """Micro-averaged score per task: sums first, then ratios."""
    sums = per_text.groupBy(task).agg(
        *[F.sum(c).alias(c) for c in ("tp_chars", "gold_chars", "pred_chars", "nonpii_chars")],
        F.count("*").alias("texts"),
    )
    return rates(sums)


def masking_score_macro(scores: DataFrame, expected_tasks: int) -> DataFrame:
    """Mean over tasks, and whether every expected task is in."""
    return scores.agg(
        F.avg("f2").alias("avg_f2"),
        F.avg("f1").alias("avg_f1"),
        F.avg("precision").alias("avg_precision"),
        F.avg("recall").alias("avg_recall"),
        (F.count("*") == expected_tasks).alias("complete"),
    )


def task_labels(gold: DataFrame, task: str) -> DataFrame:
    """Distinct labels of each whole task."""
    return gold.select(task, "label").distinct()


def sample_per_task(df: DataFrame, task: str, uid: str, n: int, seed: int = 13) -> DataFrame:
    """``n`` rows per task (all if n <= 0), the same ones for the same seed."""
    draw = F.md5(F.concat_ws(":", F.col(uid).cast("string"), F.lit(str(seed))))
    return first_n_per_key(df, [task], [draw, F.col(uid)], n)


# --- presets ---------------------------------------------------------------------------------


def preset_table(spark, presets=PRESETS) -> DataFrame:
    return spark.createDataFrame(
        presets, "name string, labels array<string>, threshold double"
    )


def choose_preset(
    presets: DataFrame,
    name: str,
    labels: str | None = None,
    threshold: float | None = None,
) -> tuple[list[str] | None, float]:
    """Labels and threshold of a named preset; explicit values override.

    An unknown name is an error that lists the known ones.
    """
    if threshold is not None and not 0.0 <= threshold <= 1.0:
        threshold = None
    row = presets.where(F.col("name") == name).first()
    if row is None:
        known = [r["name"] for r in presets.select("name").orderBy("name").limit(50).collect()]
        raise ValueError(f"unknown preset {name!r} (available: {', '.join(known)})")
    own = None
    if labels is not None:
        own = [x.strip() for x in labels.split(",") if x.strip()] or None
    if threshold is None:
        threshold = 0.5 if row["threshold"] is None else row["threshold"]
    return own or row["labels"], threshold


def preset_filter(
    spans: DataFrame, presets: DataFrame, override: float | None = None, by: str = "preset"
) -> DataFrame:
    """Keep scored spans that the preset named in column ``by`` would report.

    An override outside [0, 1] is ignored; a name without a preset is an error.
    """
    p = presets.select(
        F.col("name").alias(by),
        F.col("labels").alias("__labels"),
        F.col("threshold").alias("__t"),
        F.lit(True).alias("__known"),
    )
    named = spans.join(p, by, "left")
    known = F.when(F.col("__known"), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("unknown preset "), F.coalesce(F.col(by), F.lit("null")))).cast("boolean")
    )
    wanted = F.col("__labels").isNull() | F.array_contains("__labels", F.col("label"))
    given = override is not None and 0.0 <= override <= 1.0
    limit = F.lit(override) if given else F.coalesce("__t", F.lit(0.5))
    kept = named.where(known & wanted & (F.col("score") >= limit))
    return kept.drop("__labels", "__t", "__known")


def split_labels(df: DataFrame, column: str, out: str = "labels") -> DataFrame:
    return df.withColumn(out, label_list(F.col(column)))
