"""Byte-level BPE as a monoid: encodings of neighbouring halves are joined up a tree.

A sequence of tokens is the encoding of its bytes exactly when every two neighbours, encoded
together, give themselves back: merges go by lowest rank and then leftmost, so the first merge
across a token boundary would also be the first one in that pair alone.  Joining two encodings
therefore only has to re-encode a window around the seam and widen it until the pairs at both
ends of the window are stable; all tokens outside are then proved right.  Decoding is a plain
concatenation, so it is the same tree with nothing to repair.

Defined results: a null text encodes like an empty one (no tokens); texts of any length are
encoded whole; extra columns pass through; rows are independent, so repeated rows and empty
tables need no care.  An id outside the vocabulary is an error, a null list decodes to null.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave.llm.common import Numbering, chunked, spread_out, unused

# Pieces of at most this many bytes are merged directly; longer ones are halved.
LEAF_BYTES = 64
# Ids concatenated at a time by the decoder.
LEAF_IDS = 4096
# Stands for the rank of a pair that is no token.
UNMERGED = 1 << 60
# Rows decoded at a time.
DECODE_ROWS = 256
# Distinct pieces remembered within a task.
MEMO_PIECES = 200_000
# A vocabulary file larger than this is refused, so the broadcast is bounded.
MAX_VOCABULARY_BYTES = 64 * 1024 * 1024


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The rank file at ``path`` as a broadcast of its bytes."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary file larger than {MAX_VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Codec:
    """Encoder and decoder over one rank table and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF_BYTES):
        self.ranks = ranks
        self.tokens = {n: t for t, n in ranks.items()}
        self.findall = regex.compile(pattern).findall
        self.leaf = max(1, leaf)
        self._stable: dict[tuple[int, int], bool] = {}
        self._numbers = Numbering()
        self._flat = np.empty(0, np.int32)
        self._starts = np.empty(0, np.int64)
        self._lengths = np.empty(0, np.int64)

    # -- one piece

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern; a piece that is itself a token stays whole."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self._tree(piece)

    def _tree(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf:
            return self._merged(data)
        middle = len(data) // 2
        return self.join(self._tree(data[:middle]), self._tree(data[middle:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring encodings' bytes."""
        if not left or not right:
            return left or right
        i, j = 1, 1
        while True:
            window = b"".join(map(self.tokens.__getitem__, left[-i:] + right[:j]))
            middle = self._merged(window)
            left_ok = i == len(left) or self.stable(left[-i - 1], middle[0])
            right_ok = j == len(right) or self.stable(middle[-1], right[j])
            if left_ok and right_ok:
                return left[: len(left) - i] + middle + right[j:]
            if not left_ok:
                i = min(2 * i, len(left))
            if not right_ok:
                j = min(2 * j, len(right))

    def stable(self, a: int, b: int) -> bool:
        """Whether two neighbouring tokens, encoded together, stay as they are."""
        known = self._stable.get((a, b))
        if known is None:
            if len(self._stable) >= MEMO_PIECES:
                self._stable.clear()
            known = self._merged(self.tokens[a] + self.tokens[b]) == [a, b]
            self._stable[a, b] = known
        return known

    def _merged(self, data: bytes) -> list[int]:
        """Merges of lowest rank first, leftmost among equals."""
        if len(data) > 2 * LEAF_BYTES:
            return self._merged_long(data)
        rank_of, ranks = self.ranks.get, self.ranks
        parts = [data[k : k + 1] for k in range(len(data))]
        # Rank of the pair that starts at each part; only the neighbours of a merge change.
        pairs = [rank_of(data[k : k + 2], UNMERGED) for k in range(len(data) - 1)]
        while pairs:
            best = min(pairs)
            if best == UNMERGED:
                break
            at = pairs.index(best)
            token = parts[at] + parts[at + 1]
            parts[at : at + 2] = [token]
            del pairs[at]
            if at:
                pairs[at - 1] = rank_of(parts[at - 1] + token, UNMERGED)
            if at < len(pairs):
                pairs[at] = rank_of(token + parts[at + 1], UNMERGED)
        return [ranks[p] for p in parts]

    def _merged_long(self, data: bytes) -> list[int]:
        """The same merges with a heap over a linked list, for wide windows."""
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap: list[tuple[int, int, int]] = []

        def offer(k: int) -> None:
            if k >= 0 and end[k] < n:
                r = ranks.get(data[k : end[end[k]]])
                if r is not None:
                    heapq.heappush(heap, (r, k, end[end[k]]))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, k, stop = heapq.heappop(heap)
            if not alive[k] or end[k] >= n or end[end[k]] != stop:
                continue
            gone = end[k]
            alive[gone] = False
            end[k] = stop
            if stop < n:
                before[stop] = k
            offer(k)
            offer(before[k])
        out, k = [], 0
        while k < n:
            out.append(ranks[data[k : end[k]]])
            k = end[k]
        return out

    # -- texts

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.findall(text):
            out += self.encode_piece(piece.encode())
        return out

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of tokens of each text, all ids in order); each distinct piece is encoded once."""
        if len(self._numbers) > MEMO_PIECES:
            self._numbers.restart()
            self._flat, self._starts, self._lengths = self._flat[:0], self._starts[:0], self._lengths[:0]
        number = self._numbers.__getitem__
        counts = np.empty(len(texts), np.int64)
        seen: list[int] = []
        for k, t in enumerate(texts):
            pieces = self.findall(t)
            counts[k] = len(pieces)
            seen.extend(map(number, pieces))
        self._learn()
        which = np.array(seen, np.int64)
        lengths = self._lengths[which]
        ids = self._flat[spread_out(self._starts[which], lengths)]
        upto = np.concatenate(([0], np.cumsum(lengths)))
        bounds = upto[np.concatenate(([0], np.cumsum(counts)))]
        return np.diff(bounds), ids

    def _learn(self) -> None:
        fresh, self._numbers.fresh = self._numbers.fresh, []
        if not fresh:
            return
        coded = [self.encode_piece(p.encode()) for p in fresh]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter((x for c in coded for x in c), np.int32, int(lengths.sum()))
        starts = len(self._flat) + np.cumsum(lengths) - lengths
        self._flat = np.concatenate((self._flat, flat))
        self._starts = np.concatenate((self._starts, starts))
        self._lengths = np.concatenate((self._lengths, lengths))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.tokens.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def _encoded(codec: Codec, texts: pa.Array) -> Iterator[pa.ListArray]:
    """Token ids of a batch, a run of its texts at a time: what is ready leaves the worker before
    the next run is encoded, so that memory does not follow the size of an Arrow batch."""
    for part in chunked(texts):
        counts, ids = codec.encode_many(part)
        offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))


def _decoded(codec: Codec, ids: pa.ListArray) -> Iterator[pa.Array]:
    """The bytes of each list of a batch, ``DECODE_ROWS`` rows at a time."""
    for first in range(0, len(ids), DECODE_ROWS):
        part = ids.slice(first, DECODE_ROWS)
        flat = part.flatten().to_numpy(zero_copy_only=False)
        sizes = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        stops = np.cumsum(sizes)
        yield pa.array(
            [
                codec.decode(flat[stop - size : stop].tolist()) if known else None
                for known, size, stop in zip(part.is_valid().to_pylist(), sizes, stops)
            ],
            pa.binary(),
        )


def encoded(text: Column, vocab: Broadcast, pattern: str) -> Column:
    """Token ids of each text, as array<int>."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(parse_ranks(vocab.value), pattern)
        for batch in batches:
            yield from _encoded(codec, batch)

    return encode(text)


def round_trip(text: Column, vocab: Broadcast, pattern: str) -> Column:
    """struct(ids, decoded): each text encoded and its ids decoded, in one pass."""

    @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(parse_ranks(vocab.value), pattern)
        for batch in batches:
            for coded in _encoded(codec, batch):
                for first in range(0, len(coded), DECODE_ROWS):
                    ids = coded.slice(first, DECODE_ROWS)
                    yield pa.StructArray.from_arrays([ids, *_decoded(codec, ids)], ["ids", "decoded"])

    return both(text)


def token_counts(text: Column, vocab: Broadcast, pattern: str) -> Column:
    """Number of tokens of each text, without shipping the ids."""

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(parse_ranks(vocab.value), pattern)
        for batch in batches:
            counts = [codec.encode_many(texts)[0] for texts in chunked(batch)]
            yield pa.array(np.concatenate(counts) if counts else [], pa.int64())

    return count(text)


def decoded(ids: Column, vocab: Broadcast) -> Column:
    """The bytes of each list of ids."""

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(parse_ranks(vocab.value), "")
        for batch in batches:
            yield from _decoded(codec, batch)

    return decode(ids)


def encode(df: DataFrame, vocab: Broadcast, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``, the token ids of ``text``; a column of that name is replaced."""
    return df.withColumn(out, encoded(F.col(text), vocab, pattern))


def decode(df: DataFrame, vocab: Broadcast, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``, the bytes of ``ids``; a column of that name is replaced."""
    return df.withColumn(out, decoded(F.col(ids), vocab))


def digest(df: DataFrame, vocab: Broadcast, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, then decoded."""
    rows = df.select("doc_id", round_trip(F.col("text"), vocab, pattern).alias("both"))
    return rows.select(
        "doc_id",
        F.size("both.ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("both.ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("both.decoded"), 256).alias("decoded_sha256"),
    )


def with_round_trip(df: DataFrame, vocab: Broadcast, pattern: str, text: str = "text") -> DataFrame:
    """Add ``ids``, ``n_tokens`` and ``round_trip``, whether decoding gives the text back; columns
    of those names are replaced."""
    both = unused(df, "__both")
    coded = df.withColumn(both, round_trip(F.col(text), vocab, pattern))
    original = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    return coded.withColumns(
        {
            "ids": F.col(f"{both}.ids"),
            "n_tokens": F.size(f"{both}.ids").cast("bigint"),
            "round_trip": F.col(f"{both}.decoded") == original,
        }
    ).drop(both)
