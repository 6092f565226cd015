"""Pieces the operators share: reading, the train/held-out fold, bounded work inside a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text worked on at a time inside an Arrow batch; bounds memory, changes no result.
CHUNK_BYTES = 1_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % 3


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows nothing may be learned from; a null id is not one of them (nor is it trained on)."""
    return F.coalesce(fold(doc_id) == 1, F.lit(False))


def unused(df: DataFrame, base: str) -> str:
    """A column name that does not clash with the caller's columns."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def chunked(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[list[str]]:
    """The texts of an Arrow array (null as empty) in runs of about ``limit`` bytes; a text is
    never cut, and only one run at a time becomes Python strings."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(texts):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield [t or "" for t in texts.slice(first, last - first).to_pylist()]
        first = last


class Numbering(dict):
    """Numbers distinct keys in order of arrival; ``fresh`` holds those not yet looked after."""

    def __init__(self):
        self.fresh: list = []

    def __missing__(self, key):
        n = self[key] = len(self)
        self.fresh.append(key)
        return n

    def restart(self) -> None:
        self.clear()
        self.fresh = []


def spread_out(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of every range, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
