"""Batch twin of the streaming restore: per-chunk output of whole chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.functions.patterns import MAX_PENDING
from maskweave.operators.ranking import running
from maskweave.operators.vault import restore_by_join

BLOCK_CHARS = 1 << 16
STREAMS_PER_ORDER_BLOCK = 1 << 14

# An opened placeholder at the end of the text: the last "<<" with no ">>" behind it.
_OPEN = r"(?s)<<(?!<)(?:(?!<<|>>).)*\z"


def _held(text: Column) -> Column:
    # Only the last MAX_PENDING + 2 characters can matter.
    tail = F.substring(text, F.greatest(F.length(text) - MAX_PENDING - 1, F.lit(1)), F.lit(1 << 30))
    opened = F.regexp_extract(tail, _OPEN, 0)
    return (
        F.when(F.octet_length(opened).between(1, MAX_PENDING), opened)
        .when(F.endswith(text, F.lit("<")), F.lit("<"))
        .otherwise(F.lit(""))
    )


def emitted_chunks(
    chunks: DataFrame,
    key: list[str],
    chunk_no: str = "chunk_no",
    text: str = "text",
    is_end: str | None = None,
) -> DataFrame:
    """(key.., chunk_no, emitted): what leaves after each chunk, placeholders never cut.

    What a chunk holds back depends on at most the ``MAX_PENDING`` characters before it, so a
    stream is cut into blocks of ``BLOCK_CHARS`` characters; each block also gets the chunks just
    before it to start from the right pending text.  A stream of any length spreads over tasks,
    and the array folded at a time is bounded by the block.  The text still held at the end goes
    out with every chunk that ``is_end`` flags and with the last one.
    """
    # A stream cut off before its end still gives up what it holds, with its last chunk.
    last = chunks.groupBy(*key).agg(F.max(chunk_no).alias("__last"))
    flagged = F.coalesce(is_end, F.lit(False)) if is_end is not None else F.lit(False)
    chunks = chunks.join(last, key).withColumn(
        "__end_flag", flagged | (F.col(chunk_no) == F.col("__last"))
    )
    size = F.length(text).cast("bigint")
    placed = running(
        chunks.select(*key, chunk_no, text, "__end_flag"),
        key,
        F.floor(F.col(chunk_no) / STREAMS_PER_ORDER_BLOCK),
        [chunk_no],
        sums={"__end": size},
    )
    own = F.floor((F.col("__end") - size) / BLOCK_CHARS)
    reach = F.floor((F.col("__end") + MAX_PENDING + 2) / BLOCK_CHARS)
    copies = placed.select(
        *key,
        chunk_no,
        text,
        "__end_flag",
        own.alias("__own"),
        F.explode(F.sequence(own, F.greatest(own, reach))).alias("__block"),
    )
    grouped = copies.groupBy(*key, "__block").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col(chunk_no).alias("no"),
                    F.col(text).alias("text"),
                    (F.col("__own") == F.col("__block")).alias("mine"),
                    F.col("__end_flag").alias("ends"),
                )
            )
        ).alias("__rows")
    )

    def step(acc: Column, c: Column) -> Column:
        whole = F.concat(acc["pending"], c["text"])
        held = _held(whole)
        ready = F.substring(whole, F.lit(1), F.length(whole) - F.length(held))
        out = F.when(c["ends"], whole).otherwise(ready)
        row = F.struct(c["no"].alias("no"), out.alias("out"), c["mine"].alias("mine"))
        left = F.when(c["ends"], F.lit("")).otherwise(held)
        return F.struct(left.alias("pending"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    zero = F.struct(
        F.lit("").alias("pending"),
        F.array()
        .cast("array<struct<no:bigint,out:string,mine:boolean>>")
        .alias("rows"),
    )
    folded = grouped.select(
        *key, F.explode(F.aggregate("__rows", zero, step, lambda acc: acc["rows"])).alias("r")
    ).where(F.col("r.mine"))
    return folded.select(*key, F.col("r.no").alias(chunk_no), F.col("r.out").alias("emitted"))


def restore_chunks(
    chunks: DataFrame,
    vault: DataFrame,
    conv: str,
    key: list[str],
    chunk_no: str = "chunk_no",
    is_end: str | None = None,
) -> DataFrame:
    """Restored output per chunk.  ``key`` names one stream and includes ``conv``."""
    out = emitted_chunks(chunks, key, chunk_no, is_end=is_end)
    names = [k for k in key if k != conv]
    tagged = out.withColumn("__seg", F.struct(*names, chunk_no))
    return restore_by_join(tagged, vault, conv, "__seg", "emitted").drop("__seg")
