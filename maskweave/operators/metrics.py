"""Counters over traffic: histograms, capped counts, two-key counts, windows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.functions.patterns import LABEL_CAP, LATENCY_BOUNDS
from maskweave.session import staged


def histogram(df: DataFrame, value: str, by: str, bounds=LATENCY_BOUNDS) -> DataFrame:
    """Cumulative buckets per group: (by, le, n, total, observations); le is null for +Inf.

    All buckets are counted in one pass and turned into rows after the aggregation.
    """
    counts = df.groupBy(by).agg(
        F.array(
            *[F.count_if(F.col(value) <= b) for b in bounds], F.count(value)
        ).alias("__n"),
        F.sum(value).alias("total"),
        F.count(value).alias("observations"),
    )
    limits = F.array(*[F.lit(float(b)) for b in bounds], F.lit(None).cast("double"))
    return counts.select(
        by, F.posexplode("__n").alias("__i", "n"), "total", "observations"
    ).select(by, F.get(limits, F.col("__i")).alias("le"), "n", "total", "observations")


def capped_counts(
    df: DataFrame, label: Column, order: Column, cap: int = LABEL_CAP
) -> DataFrame:
    """Counts per label where only the first ``cap`` labels seen keep their name.

    The named labels are a top-``cap`` by first sight, so the lookup side has at most ``cap``
    rows whatever the data.
    """
    per = df.groupBy(label.alias("label")).agg(
        F.count("*").alias("n"), F.min(order).alias("first_seen")
    )
    named = per.orderBy("first_seen", "label").limit(cap).select("label", F.lit(True).alias("named"))
    folded = per.join(named, "label", "left").select(
        F.when(F.col("named"), F.col("label")).otherwise(F.lit("other")).alias("label"), "n"
    )
    return folded.groupBy("label").agg(F.sum("n").alias("n"))


# Request paths and the route name each counts under.
ROUTES = {
    "/v1/chat/completions": "openai",
    "/v1/messages": "anthropic",
    "/teach": "admin",
    "/unteach": "admin",
    "/terms": "admin",
    "/suggestions": "admin",
    "/healthz": "health",
    "/metrics": "metrics",
}


def route(path: Column) -> Column:
    """Fixed route name of a request path; anything else is ``other``."""
    names = F.create_map(*[F.lit(x) for kv in ROUTES.items() for x in kv])
    return F.coalesce(F.element_at(names, path), F.lit("other"))


def traffic_matrix(df: DataFrame, route_name: Column, status: Column) -> DataFrame:
    return df.groupBy(route_name.alias("route"), status.alias("status")).agg(
        F.count("*").alias("requests")
    )


def windowed_counts(
    df: DataFrame, ts: str, label: str, width: str = "5 minutes", late: str | None = None
) -> DataFrame:
    """Counts per time window and label; works on streams (``late`` sets the watermark)."""
    src = df.withWatermark(ts, late) if late else df
    return (
        src.groupBy(F.window(ts, width).alias("w"), label)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), label, "n")
    )


# --- most frequent values -------------------------------------------------------------------------

SKETCH_COUNTERS = 4096


def _heavy(values: DataFrame, by: list[str], counters: int) -> DataFrame:
    """(by.., value, n): every value that can be among the ``counters`` most frequent of the table's groups.

    A frequent-items sketch for each slice of the input: at most ``counters`` values, and when one more
    comes all counts are lowered by the median, so that low ones go.  A value lost from a slice has
    at most ``lost`` occurrences there; the sketches are merged by adding both.
    """
    names = [*by, "value"]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, int] = {}
        lost = 0
        for batch in batches:
            keys = zip(*[c.to_pylist() for c in batch.columns])
            for key, n in Counter(keys).items():
                counts[key] = counts.get(key, 0) + n
            if len(counts) > 2 * counters:
                # Everything at or below the cut goes; the rest keeps its exact count.
                cut = sorted(counts.values(), reverse=True)[counters]
                lost += cut
                counts = {k: n for k, n in counts.items() if n > cut}
        # The last row says how much this slice may have lost of any value.
        none = (None,) * len(names)
        rows = [*((*k, n, 0, 0) for k, n in counts.items()), (*none, 0, TaskContext.get().partitionId(), lost)]
        types = [pa.string()] * len(names) + [pa.int64()] * 3
        arrays = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
        yield pa.RecordBatch.from_arrays(arrays, [*names, "n", "slice", "lost"])

    strings = values.select(*[F.col(c).cast("string").alias(c) for c in names])
    return strings.mapInArrow(
        sketch, ", ".join(f"{c} string" for c in names) + ", n bigint, slice bigint, lost bigint"
    )


def top_values(values: DataFrame, k: int, *by: str, counters: int = SKETCH_COUNTERS) -> DataFrame:
    """(by.., value, n): the ``k`` most frequent values, ties to the smaller value.

    Two passes.  Mergeable sketches of bounded size bound the counts of all values from below and above; a
    second pass counts exactly those values whose upper bound reaches the k-th lower bound.  Only these
    are shuffled, so a column of mostly distinct values costs little; should the sketches tell nothing
    (no value stands out), all values are counted, exactly too.
    """
    names = [*by, "value"]
    parts = staged(_heavy(values, list(by), counters), "value-sketches")
    # Occurrences a value may have lost, over all slices.
    total_lost = parts.agg(F.coalesce(F.sum("lost"), F.lit(0))).first()[0]
    merged = parts.where("n > 0").groupBy(*names).agg(F.sum("n").alias("low"))
    kth = merged.orderBy(F.desc("low")).limit(k).agg(F.min("low"), F.count("*")).first()
    strings = values.select(*[F.col(c).cast("string").alias(c) for c in names])
    if total_lost == 0:
        exact = merged.select(*names, F.col("low").alias("n"))
    elif kth[1] == k and kth[0] > total_lost:
        candidates = merged.where(F.col("low") + total_lost >= kth[0]).select(*[F.col(c).alias(f"__{c}") for c in names])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in names])
        exact = strings.join(candidates, same, "left_semi").groupBy(*names).agg(F.count("*").alias("n"))
    else:
        exact = strings.groupBy(*names).agg(F.count("*").alias("n"))
    return exact.orderBy(F.desc("n"), *names).limit(k)


def redactions_rollup(spans: DataFrame, *by: str) -> DataFrame:
    """Redactions by every prefix of ``by``, down to the total: (by.., level, redactions, distinct_values).

    ``level`` counts the columns summed over, which tells a null of the data from a subtotal.
    """
    bits = F.grouping_id()
    return spans.rollup(*by).agg(
        F.bit_count(bits).cast("int").alias("level"),
        F.count("*").alias("redactions"),
        F.countDistinct("value").alias("distinct_values"),
    )
