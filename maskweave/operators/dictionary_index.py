"""Dictionary detector for policies of any size: an inverted index of rare grams, and a join.

Every form is indexed under one of its grams (six folded characters, or all of a shorter form): the
one that the fewest forms share, so that a gram in a text leads to few forms.  Texts send the
grams they hold, with their positions, through an equi-join with the index; what meets is a
candidate, goes back to its text and is compared there, character by character, with the word edges.

Nothing that grows with the policy is collected or broadcast.  Two tables of fixed size help:
counts of the forms' grams by hash, to choose by, and a Bloom filter of the indexed grams, to drop
nearly all grams of a text before the shuffle.  Beyond their capacity they choose or drop less
well; the spans stay the same.  Copies of a text make one group of candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.functions import spans as S
from maskweave.functions.patterns import GLOBAL_SCOPE
from maskweave.functions.text import ascii_lower
from maskweave.operators.dictionary_match import CANDIDATE, at_edges, fold_text

GRAM = 6
COUNTERS = 1 << 20
# Blocks of 64 bits; four bits of one block for each gram.
MAX_FILTER_BLOCKS = 1 << 20
GRAMS_PER_BLOCK = 5
FORM_COLUMNS = ["scope", "form", "label", "whole_word", "ord", "form_no"]

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def gram_hashes(folded: str, n: int) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` characters, by position."""
    codes = np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    count = len(codes) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.full(count, n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = h * _MULTIPLIER + codes[i : i + count] + np.uint64(1)
        h ^= h >> np.uint64(31)
        h *= _MIX
        h ^= h >> np.uint64(29)
    return h


def filter_bits(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, mask) of each hash."""
    mask = np.zeros(len(hashes), dtype=np.uint64)
    for shift in (40, 46, 52, 58):
        mask |= np.left_shift(np.uint64(1), (hashes >> np.uint64(shift)) & np.uint64(63))
    return (hashes % np.uint64(blocks)).astype(np.int64), mask


def _gram_counts(forms: DataFrame) -> np.ndarray:
    """How often grams of each hash class occur in the forms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.empty(0, dtype=np.uint64)]
            for form in batch.column(0).to_pylist():
                folded = fold_text(form)
                found.append(np.unique(gram_hashes(folded, min(GRAM, len(folded)))))
            slot, n = np.unique(np.concatenate(found) % np.uint64(COUNTERS), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(n)], ["slot", "n"])

    sums = forms.select("form").mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    table = sums.toArrow()  # at most COUNTERS rows
    counts = np.zeros(COUNTERS, dtype=np.int64)
    counts[table.column("slot").to_numpy()] = table.column("n").to_numpy()
    return counts


def gram_index(forms: DataFrame) -> DataFrame:
    """(gram, at, size, and the form's columns): every form under its rarest gram."""
    context = forms.sparkSession.sparkContext
    sent = context.broadcast(_gram_counts(forms))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        for batch in batches:
            grams, places, sizes = [], [], []
            for form in batch.column(1).to_pylist():
                folded = fold_text(form)
                h = gram_hashes(folded, min(GRAM, len(folded)))
                at = int(counts[(h % np.uint64(COUNTERS)).astype(np.int64)].argmin())
                grams.append(h[at].astype(np.int64))
                places.append(at)
                sizes.append(len(folded))
            columns = [pa.array(np.array(x, dtype=np.int64)) for x in (grams, places, sizes)]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns], ["gram", "at", "size", *FORM_COLUMNS])

    types = dict(forms.dtypes)
    schema = "gram bigint, at bigint, size bigint, " + ", ".join(f"{c} {types[c]}" for c in FORM_COLUMNS)
    return forms.select(*FORM_COLUMNS).mapInArrow(choose, schema)


def _filter_words(index: DataFrame, n_forms: int) -> np.ndarray:
    blocks = max(1, min(MAX_FILTER_BLOCKS, -(-n_forms // GRAMS_PER_BLOCK)))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            block, mask = filter_bits(h, blocks)
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(mask.view(np.int64))], ["block", "mask"])

    merged = (
        index.select("gram").mapInArrow(mark, "block bigint, mask bigint").groupBy("block").agg(F.bit_or("mask").alias("mask"))
    )
    table = merged.toArrow()  # at most MAX_FILTER_BLOCKS rows
    words = np.zeros(blocks, dtype=np.uint64)
    words[table.column("block").to_numpy()] = table.column("mask").to_numpy().view(np.uint64)
    return words


def _text_grams(rows: DataFrame, lengths: list[int], words: np.ndarray) -> DataFrame:
    """(k1, k2, scope_key, gram, place) of the grams in each text that may be indexed."""
    sent = rows.sparkSession.sparkContext.broadcast(words)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                folded = fold_text(batch.column(3)[row].as_py())
                for n in lengths:
                    h = gram_hashes(folded, n)
                    block, mask = filter_bits(h, len(bits))
                    place = np.flatnonzero(bits[block] & mask == mask)
                    if not len(place):
                        continue
                    same = [pa.repeat(batch.column(i)[row], len(place)) for i in range(3)]
                    yield pa.RecordBatch.from_arrays(
                        [*same, pa.array(h[place].view(np.int64)), pa.array(place.astype(np.int64))],
                        ["k1", "k2", "scope_key", "gram", "place"],
                    )

    return rows.mapInArrow(send, "k1 bigint, k2 bigint, scope_key string, gram bigint, place bigint")


def _verified(texts: Column, found: Column) -> Column:
    """Candidates whose form stands at their place, with whole words at word edges."""

    @F.pandas_udf(CANDIDATE)
    def check(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, candidates in zip(texts, found):
            good = []
            folded = fold_text(text) if candidates is not None and len(candidates) else ""
            for c in candidates if candidates is not None else ():
                form, start = c["form"], c["start"]
                end = start + len(form)
                if not folded.startswith(fold_text(form), start):
                    continue
                if c["whole_word"] and not at_edges(text, start, end, form[0], form[-1]):
                    continue
                neg = -len(form.encode())
                good.append((start, neg, c["whole_word"], c["ord"], c["form_no"], end, c["label"]))
            out.append(good)
        return pd.Series(out)

    return check(texts, found)


def with_indexed_spans(
    df: DataFrame, forms: DataFrame, text: str = "text", scope: str | None = None, out: str = "dictionary_spans"
) -> DataFrame:
    """Add the dictionary layer by joining the texts' grams with the forms' index.

    ``df`` is read twice: its text and scope for the grams, then whole, where the candidates of
    its text come back to each row.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    who = ascii_lower(F.col(scope)) if scope else F.lit(None).cast("string")
    # Two hashes of (scope, text): candidates of a text that shares them with another are
    # compared with the text like all others.
    keys = {"__k1": F.xxhash64(F.lit(1), who, whole), "__k2": F.xxhash64(F.lit(2), whole, who)}

    index = gram_index(forms)
    size = F.least(F.length("form"), F.lit(GRAM)).alias("n")
    n_forms, lengths = forms.agg(F.count("*"), F.sort_array(F.collect_set(size))).first()
    words = _filter_words(index, n_forms)
    texts = df.select(keys["__k1"].alias("k1"), keys["__k2"].alias("k2"), who.alias("scope_key"), whole.alias("t"))
    grams = _text_grams(texts, lengths, words)
    meets = grams.join(index, "gram").where(
        (F.col("place") >= F.col("at"))
        & (F.col("scope_key").isNull() | F.col("scope").isin(GLOBAL_SCOPE) | (F.col("scope") == F.col("scope_key")))
    )
    candidate = F.struct(
        (F.col("place") - F.col("at")).alias("start"), "form", "label", "whole_word", "ord", "form_no"
    )
    by_text = (
        meets.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), candidate.alias("c"))
        .groupBy("__k1", "__k2")
        .agg(F.collect_set("c").alias("__found"))
    )
    joined = df.withColumns(keys).join(by_text, ["__k1", "__k2"], "left").drop("__k1", "__k2")
    checked = joined.withColumn("__cand", _verified(whole, F.col("__found"))).drop("__found")
    best = S.leftmost_longest("__cand", f"coalesce(`{text}`, '')")
    return S.settled(checked, {out: best}).drop("__cand")
