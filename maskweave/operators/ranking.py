"""Running sums and ranks that survive one key holding a large share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(
    df: DataFrame,
    keys: list[str],
    block: Column,
    order: list[str],
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
) -> DataFrame:
    """Add running aggregates over all rows of the key up to and including the current one.

    ``block`` cuts each key into consecutive runs of the order (it must never decrease along
    ``order``).  Rows are windowed per (key, block); the totals of earlier blocks come from a
    second window over one row per block.  A plain window per key would put a whole key in
    one task.
    """
    sums, maxima = sums or {}, maxima or {}
    cut = df.withColumn("__block", block)
    local = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    rows = cut.select(
        "*",
        *[F.sum(c).over(local).alias(f"__l_{n}") for n, c in sums.items()],
        *[F.max(c).over(local).alias(f"__l_{n}") for n, c in maxima.items()],
    )
    totals = cut.groupBy(*keys, "__block").agg(
        *[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()],
        *[F.max(c).alias(f"__t_{n}") for n, c in maxima.items()],
    )
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = totals.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col("__block").alias("__k_block"),
        *[F.sum(f"__t_{n}").over(before).alias(f"__o_{n}") for n in sums],
        *[F.max(f"__t_{n}").over(before).alias(f"__o_{n}") for n in maxima],
    )
    same = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys],
        F.col("__block") == F.col("__k_block"),
    )
    return rows.join(offsets, same, "left").select(
        *[F.col(c) for c in df.columns],
        *[(F.coalesce(F.col(f"__o_{n}"), F.lit(0)) + F.col(f"__l_{n}")).alias(n) for n in sums],
        *[F.greatest(F.col(f"__o_{n}"), F.col(f"__l_{n}")).alias(n) for n in maxima],
    )


def numbered(
    df: DataFrame, keys: list[str], block: Column, order: list[str], name: str = "n"
) -> DataFrame:
    """Row number 1, 2, 3, ... within the key."""
    return running(df, keys, block, order, sums={name: F.lit(1).cast("bigint")})


def first_n_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key, cut down per slice of the key before they meet."""
    if n <= 0:
        return df
    sliced = df.withColumn("__slice", F.pmod(F.xxhash64(*order), F.lit(64)))
    w1 = Window.partitionBy(*keys, "__slice").orderBy(*order)
    w2 = Window.partitionBy(*keys).orderBy(*order)
    few = sliced.withColumn("__rn", F.row_number().over(w1)).where(F.col("__rn") <= n)
    return (
        few.withColumn("__rn", F.row_number().over(w2))
        .where(F.col("__rn") <= n)
        .drop("__rn", "__slice")
    )
