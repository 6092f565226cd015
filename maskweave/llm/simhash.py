"""SimHash near-duplicates, linked through Golay-code keys.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits.  Each segment is a word of the
perfect (23, 12) Golay code's space: its keys are the nearest codeword and, where that is three
bits away, also the codewords four bits away that flipping one bit can lead to.  Of two words at
most one bit apart, each one's nearest codeword is then among the keys of the other.

Three errors in three segments leave, by pigeonhole, either a segment without error beside one
with at most one (keys: the clean segment whole with each codeword of the other), or exactly one
error in every segment, so that one half of each is clean (keys: a choice of halves, whole).  That
makes some forty keys of over 30 bits for a fingerprint, and two linked ones share at least one.

Within a bucket of equal keys fingerprints are compared by real distance in a search that takes
every reached one off the list, so a dense bucket costs little more than its size and yields at
most one link per fingerprint.  Buckets above ``SPLIT_ROWS`` are cut into blocks and every two
blocks meet in a task of their own.  Only distinct fingerprints take part; copies follow through
their fingerprint.

Defined results: a text without words (null and empty included) has fingerprint zero, which links
like any other; fewer than three words are one shingle; repeated rows share fingerprint and
component; the component id is the smallest id reachable, null only if all of them are; extra
columns pass through ``with_fingerprint``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, permutations, product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.llm.common import chunked, unused
from maskweave.llm.components import components
from maskweave.session import staged

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
# (lowest bit, width) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
# Rows of a bucket compared in one task.
SPLIT_ROWS = 16_384
# Bytes of shingle hashes expanded into bits at a time.
HASH_BLOCK = 65_536


def shingle_hashes(text: str | None) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    n = SHINGLE_WORDS
    if len(words) < n:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(n))))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles], np.uint64)


def fingerprint(text: str | None) -> int:
    """Bit b is one if more than half of the shingle hashes have it."""
    h = shingle_hashes(text)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), HASH_BLOCK):
        block = h[a : a + HASH_BLOCK].astype("<u8")
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    set_bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprints(text: Column) -> Column:
    """The fingerprint of each text as a signed long."""

    @F.arrow_udf("bigint")
    def fingerprint_of(texts: pa.Array) -> pa.Array:
        each = (fingerprint(t) for part in chunked(texts) for t in part)
        values = np.fromiter(each, np.uint64, len(texts))
        return pa.array(values.view(np.int64))

    return fingerprint_of(text)


@cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """(nearest codeword, distance to it) of each 23-bit word.

    The code is cyclic with generator x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
    """
    generator = 0b101011100011
    codewords = np.zeros(1, np.uint32)
    for k in range(12):
        codewords = np.concatenate((codewords, codewords ^ np.uint32(generator << k)))
    nearest = np.zeros(1 << 23, np.uint32)
    distance = np.zeros(1 << 23, np.uint8)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            error = np.uint32(sum(1 << b for b in bits))
            nearest[codewords ^ error] = codewords
            distance[codewords ^ error] = weight
    return nearest, distance


def segment_keys(
    words: np.ndarray, width: int
) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Nearest codeword of each word, and (rows, codewords) lists of the further keys.

    A word three bits from its codeword has other codewords four bits away; flipping any one bit
    of it leads either nearer or into the ball of one of those.
    """
    nearest, distance = _golay()
    near = nearest[words]
    far = np.flatnonzero(distance[words] == 3)
    around = np.stack([nearest[words[far] ^ np.uint32(1 << b)] for b in range(width)], axis=1)
    around.sort(axis=1)
    new = np.ones(around.shape, bool)
    new[:, 1:] = around[:, 1:] != around[:, :-1]
    new &= around != near[far][:, None]
    return near, [(far[new[:, c]], around[new[:, c], c]) for c in range(width)]


def bucket_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every bucket key of the fingerprints (unsigned)."""
    parts = [
        ((prints >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.uint32)
        for low, width in SEGMENTS
    ]
    keyed = [segment_keys(p, width) for p, (_, width) in zip(parts, SEGMENTS)]
    everyone = np.arange(len(prints))
    rows, keys = [], []
    for n, (clean, other) in enumerate(permutations(range(len(SEGMENTS)), 2)):
        exact = (np.int64(n) << 46) | (parts[clean].astype(np.int64) << 23)
        near, more = keyed[other]
        for r, codeword in [(everyone, near), *more]:
            rows.append(r)
            keys.append(exact[r] | codeword.astype(np.int64))
    for n, choice in enumerate(product((0, 1), repeat=len(SEGMENTS)), start=n + 1):
        key = np.zeros(len(prints), np.int64)
        for upper, part, (_, width) in zip(choice, parts, SEGMENTS):
            half = width // 2
            key = (key << 11) | ((part >> half) if upper else (part & ((1 << half) - 1))).astype(np.int64)
        rows.append(everyone)
        keys.append((np.int64(n) << 46) | key)
    return np.concatenate(rows), np.concatenate(keys)


def bucket_links(prints: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints: (from, to) row numbers."""
    left = np.arange(len(prints))
    sources, targets = [], []
    while len(left):
        queue, left = [left[:1]], left[1:]
        while queue and len(left):
            for at in queue.pop():
                near = np.bitwise_count(prints[left] ^ prints[at]) <= limit
                if near.any():
                    reached = left[near]
                    left = left[~near]
                    sources.append(np.full(len(reached), at))
                    targets.append(reached)
                    queue.append(reached)
                if not len(left):
                    break
    none = np.empty(0, np.int64)
    return (np.concatenate(sources), np.concatenate(targets)) if sources else (none, none)


def solved(rows: np.ndarray) -> pd.DataFrame:
    """Links within each run of equal (key, low, high) of rows (key, low, high, fp)."""
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if len(rows):
        values = np.ascontiguousarray(rows[:, 3])
        edge = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
        starts = np.concatenate(([0], edge))
        sizes = np.diff(np.concatenate((starts, [len(rows)])))
        two = starts[sizes == 2]
        apart = np.bitwise_count((values[two] ^ values[two + 1]).view(np.uint64))
        close = two[apart <= MAX_BITS]
        a.append(values[close])
        b.append(values[close + 1])
        for start, size in zip(starts[sizes > 2], sizes[sizes > 2]):
            part = values[start : start + size]
            i, j = bucket_links(part.view(np.uint64))
            a.append(part[i])
            b.append(part[j])
    return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})


def links(prints: DataFrame, fp: str = "fp") -> DataFrame:
    """(a, b): links that join the distinct fingerprints of ``prints`` as all links would."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            values = b[fp].to_numpy(np.int64)
            for k in range(0, len(values), 20_000):
                part = values[k : k + 20_000]
                rows, found = bucket_keys(part.view(np.uint64))
                yield pd.DataFrame({"key": found, "fp": part[rows]})

    keyed = prints.select(fp).mapInPandas(keys, "key bigint, fp bigint")
    rows = staged(keyed, "golay-keys")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(SPLIT_ROWS)).cast("int")
    shared = rows.join(sizes.select("key", blocks.alias("blocks")), "key")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    cut = shared.withColumn("own", own).select(
        "key",
        "fp",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
        "own",
    )
    meeting = cut.select(
        "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp"
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.empty((0, 4), np.int64)
        for frame in batches:
            rows = np.concatenate((held, frame.to_numpy(np.int64)))
            if len(rows):
                # The last group may go on in the next batch; a group has at most two blocks.
                last = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))
                done = last[-1] + 1 if len(last) else 0
                held = rows[done:]
                yield solved(rows[:done])
        yield solved(held)

    sorted_groups = meeting.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return sorted_groups.mapInPandas(search, "a bigint, b bigint")


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """Add ``out``, the fingerprint as a signed long; a column of that name is replaced."""
    return df.withColumn(out, fingerprints(F.col(text)))


def hex_form(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def roots(prints: DataFrame, fp: str = "fp") -> DataFrame:
    """(fp, root) of every distinct fingerprint that has a link."""
    distinct = prints.select(fp).distinct()
    found = components(links(distinct, fp))
    return found.select(F.col("node").alias(fp), "root")


def named_classes(rows: DataFrame, fp: str, doc_id: str) -> DataFrame:
    """(fp, root, least id of the fingerprint) of every distinct fingerprint."""
    classes = staged(rows.groupBy(fp).agg(F.min(doc_id).alias("least")), "classes")
    linked = classes.join(roots(classes, fp), fp, "left")
    return linked.select(fp, F.coalesce("root", fp).alias("root"), "least")


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: (doc_id, fp, component_id)."""
    rows = with_fingerprint(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__t")), "__t")
    rows = staged(rows.drop("__t"), "fingerprints")
    placed = staged(named_classes(rows, "fp", "doc_id"), "placed")
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(smallest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    found = near_duplicates(docs)
    return found.select("doc_id", hex_form(F.col("fp")).alias("fingerprint"), "component_id")


def without_near_copies(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``df`` with one left of every component: the one with the smallest id (a null id
    comes last), and of several such rows any one."""
    fp, row = unused(df, "__fp"), unused(df, "__row")
    marked = with_fingerprint(df, text, fp).withColumn(row, F.monotonically_increasing_id())
    marked = staged(marked, "marked")  # written, so the row numbers hold
    narrow = marked.select(
        F.col(fp).alias("fp"), F.col(doc_id).alias("id"), F.col(row).alias("row")
    )
    placed = named_classes(narrow, "fp", "id").select("fp", "root")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    # Once by fingerprint, so that copies are combined before the join.
    heads = narrow.groupBy("fp").agg(first).join(placed, "fp")
    kept = heads.groupBy("root").agg(F.min("first").alias("first"))
    kept = kept.select(F.col("first.row").alias(row))
    return marked.join(kept, row, "left_semi").drop(fp, row).select(df.columns)
