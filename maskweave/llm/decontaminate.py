"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Benchmark items are cut into windows of ``WINDOW`` characters, one every ``STRIDE`` characters (a shorter
item is one window), so every quote of ``WINDOW + STRIDE - 1`` = 124 characters holds a whole window.  A text is contaminated if some stretch of it is within ``EDIT_RATE`` edits of a
whole window.  Such a stretch shares at least ``m - q + 1 - k q`` q-grams with the window (m its
length, k the edits), and all of them lie on at most k + 1 neighbouring diagonals.  So the shared
q-grams are counted in diagonal bands that overlap by k, bands that reach the bound are kept, and
each is verified by aligning the window within the band.  The filter loses nothing.  All verified
stretches are kept; those of one item that overlap or touch become one region, whose edits are the
most that one of its windows took.

Characters are compared in lower case, every white space as a blank; offsets are those of the
text itself (code points, end exclusive).  Detection is a column of the row that holds the text:
no shuffle.  The benchmark reaches the tasks in blocks of at most ``BLOCK_CHARS`` characters, one
pass per block, so no broadcast grows with it.

Defined results: null and empty texts and items match nothing; an item shorter than ``EXACT_CHARS`` is
found verbatim only, one shorter than a q-gram not at all; repeated
rows give repeated results; an empty benchmark leaves every text clean; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.llm.common import chunked, spread_out, unused

Q = 12
WINDOW = 100
STRIDE = 25
# Shorter items get no edits.
EXACT_CHARS = 40
EDIT_RATE = 0.05
# Characters of benchmark searched for in one pass.
BLOCK_CHARS = 4_000_000
# Bytes of text searched at a time.
SEARCH_BYTES = 500_000
# Size of the first, approximate membership test (bits of the index).
SIEVE_BITS = 22
BAND = 16
# Bands aligned at a time.
ALIGN_ROWS = 512
# Places of shared grams held at a time.
POSTINGS = 2_000_000
HITS_TYPE = "array<struct<item_id:bigint,start:bigint,end:bigint,edits:int>>"

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BREAK = 0x110000  # stands between texts; no character has this code


def _fold_table() -> np.ndarray:
    table = np.arange(0x110001, dtype=np.uint32)
    for c in range(0x3001):
        ch = chr(c)
        if ch.isspace():
            table[c] = 32
        elif len(ch.lower()) == 1:
            table[c] = ord(ch.lower())
    return table


def codes(text: str, table: np.ndarray) -> np.ndarray:
    """Normalised code points, one for each character of the text."""
    return table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def gram_hashes(c: np.ndarray) -> np.ndarray:
    """Hash of the Q characters at each position (Q = 12: built from runs of 1, 2, 4 and 8)."""
    if len(c) < Q:
        return np.empty(0, np.uint64)
    h = c.astype(np.uint64) + np.uint64(1)
    runs = {1: h}
    for n, factor in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9), (4, 0xD6E8FEB86659FD93)):
        h = runs[n]
        runs[2 * n] = h[:-n] * np.uint64(factor) + (h[n:] ^ (h[n:] >> np.uint64(29)))
    out = runs[8][: len(c) - Q + 1] * _MULT + runs[4][8 : len(c) - Q + 9]
    return out ^ (out >> np.uint64(32))


def edit_budget(length: int) -> int:
    """Edits allowed for a window, where its q-gram bound stays positive."""
    k = int(length * EDIT_RATE) if length >= EXACT_CHARS else 0
    while k and length - Q + 1 - k * Q < 1:
        k -= 1
    return k


class Index:
    """Windows of one benchmark block and where their q-grams are."""

    def __init__(self, items: list[tuple[int, str]]):
        self.table = _fold_table()
        self.items: list[int] = []
        self.windows: list[np.ndarray] = []
        for item, text in items:
            c = codes(text or "", self.table)
            if len(c) < Q:
                continue
            starts = list(range(0, max(1, len(c) - WINDOW + 1), STRIDE))
            if len(c) > WINDOW and starts[-1] != len(c) - WINDOW:
                starts.append(len(c) - WINDOW)
            for s in starts:
                self.items.append(item)
                self.windows.append(c[s : s + WINDOW])
        sizes = np.array([len(w) for w in self.windows], np.int64)
        self.budget = np.array([edit_budget(int(n)) for n in sizes], np.int64)
        self.bound = sizes - Q + 1 - self.budget * Q
        grams = [gram_hashes(w) for w in self.windows]
        h = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        window = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        offset = np.concatenate([np.arange(len(g)) for g in grams]) if grams else window
        order = np.argsort(h, kind="stable")
        self.window, self.offset = window[order], offset[order]
        self.grams, self.first = np.unique(h[order], return_index=True)
        self.count = np.diff(np.concatenate((self.first, [len(h)])))
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[self._slot(self.grams)] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text number, item, start, end, edits): every region of each item in each text."""
        if not len(self.grams):
            return []
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(sizes + 1) - (sizes + 1)
        c = np.empty(int(sizes.sum()) + len(texts), np.uint32)
        for t, b, n in zip(texts, begins, sizes):
            c[b : b + n] = codes(t, self.table)
            c[b + n] = _BREAK
        h = gram_hashes(c)
        near = np.flatnonzero(self.sieve[self._slot(h)])
        at = np.searchsorted(self.grams, h[near])
        at[at == len(self.grams)] = 0
        hit = self.grams[at] == h[near]
        pos, at = near[hit], at[hit]
        bands = len(c) // BAND + 2 + WINDOW // BAND
        # Shared grams are counted for so many at a time: a run of one character meets every place
        # of such a run in the benchmark.
        work = np.cumsum(self.count[at]) // POSTINGS
        counted = [
            self._counted(pos[part], at[part], bands)
            for part in np.split(np.arange(len(pos)), np.flatnonzero(np.diff(work)) + 1)
        ]
        key, which = np.unique(np.concatenate([k for k, _ in counted]), return_inverse=True)
        shared = np.zeros(len(key), np.int64)
        np.add.at(shared, which, np.concatenate([n for _, n in counted]))
        window, band = np.divmod(key, bands)
        kept = shared >= self.bound[window]
        return self._verified(c, begins, window[kept], band[kept] * BAND - WINDOW)

    def _counted(self, pos: np.ndarray, at: np.ndarray, bands: int) -> tuple[np.ndarray, np.ndarray]:
        """(window and band as one key, shared grams) of some grams of the texts."""
        post = spread_out(self.first[at], self.count[at])
        window = self.window[post]
        diagonal = np.repeat(pos, self.count[at]) - self.offset[post] + WINDOW  # never negative
        band, rest = np.divmod(diagonal, BAND)
        overlap = (rest <= self.budget[window]) & (band > 0)
        key = np.concatenate((window * bands + band, (window * bands + band - 1)[overlap]))
        return np.unique(key, return_counts=True)

    def _verified(self, c, begins, windows, diagonals):
        """Regions (text, item, start, end, edits) of the bands whose alignment meets the budget."""
        found: list[tuple[int, int, int, int, int]] = []
        sizes = np.array([len(self.windows[w]) for w in windows], np.int64)
        for m in np.unique(sizes):
            rows = np.flatnonzero(sizes == m)
            for a in range(0, len(rows), ALIGN_ROWS):
                part = rows[a : a + ALIGN_ROWS]
                of = windows[part]
                k = self.budget[of]
                low = diagonals[part] - k
                spots = low[:, None] + np.arange(BAND + int(m) + 3 * int(k.max()) + 1)
                inside = (spots >= 0) & (spots < len(c))
                regions_ = np.where(inside, c[np.clip(spots, 0, len(c) - 1)], _BREAK)
                patterns = np.stack([self.windows[w] for w in of])
                start, end, edits = aligned(patterns, regions_)
                for w, s, e, cost in zip(of[edits <= k], *(x[edits <= k] for x in (low + start, low + end, edits))):
                    text = int(np.searchsorted(begins, s, side="right")) - 1
                    found.append(
                        (text, self.items[w], int(s - begins[text]), int(e - begins[text]), int(cost))
                    )
        return merged(found)


def merged(found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Stretches (text, item, start, end, edits), with those of one item that overlap or touch as one."""
    out: list[tuple[int, int, int, int, int]] = []
    for text, item, start, end, edits in sorted(found):
        if out and out[-1][:2] == (text, item) and start <= out[-1][3]:
            _, _, first, last, most = out.pop()
            start, end, edits = first, max(last, end), max(most, edits)
        out.append((text, item, start, end, edits))
    return out


def aligned(patterns: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, edits) of the best stretch of each region for its whole pattern.

    Column by column with free ends in the region, which is one band wide; ties go to the
    earliest end.  Nothing is aligned across a text break.
    """
    rows, m = patterns.shape
    steps = np.arange(m + 1)
    cost = np.tile(steps, (rows, 1))
    origin = np.zeros((rows, m + 1), np.int64)
    best = np.full(rows, m + 1)
    first, last = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    new, came = np.empty_like(cost), np.empty_like(origin)
    for j in range(regions.shape[1]):
        across = cost[:, :-1] + (patterns != regions[:, j, None])
        skip = cost[:, 1:] + 1
        new[:, 0], came[:, 0] = 0, j + 1
        np.minimum(across, skip, out=new[:, 1:])
        came[:, 1:] = np.where(across <= skip, origin[:, :-1], origin[:, 1:])
        # Leaving out pattern characters runs down the column: a running minimum.
        level = new - steps
        low = np.minimum.accumulate(level, axis=1)
        source = np.maximum.accumulate(np.where(level == low, steps, 0), axis=1)
        cost = low + steps
        origin = np.take_along_axis(came, source, axis=1)
        broken = regions[:, j] == _BREAK
        if broken.any():
            cost[broken], origin[broken] = steps, j + 1
        better = cost[:, m] < best
        best[better], last[better] = cost[better, m], j + 1
        first[better] = origin[better, m]
    return first, last, best


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Index]:
    """Search indexes over all items, each of at most about BLOCK_CHARS characters."""
    items = benchmark.select(
        F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text")
    ).where("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    n = -(-total // BLOCK_CHARS) or 1
    for b in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield Index([(r["item_id"], r["text"]) for r in part.toLocalIterator()])


def regions(text: Column, index: Broadcast) -> Column:
    """Contaminated regions of each text, for one benchmark block."""

    @F.arrow_udf(HITS_TYPE)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        searcher: Index = index.value
        kind = pa.list_(
            pa.struct(
                [("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]
            )
        )
        for batch in batches:
            out: list[list[dict]] = []
            for texts in chunked(batch, SEARCH_BYTES):
                mine: list[list[dict]] = [[] for _ in texts]
                for t, item, start, end, edits in sorted(searcher.search(texts)):
                    mine[t].append({"item_id": item, "start": start, "end": end, "edits": edits})
                out += mine
            yield pa.array(out, kind)

    return find(text)


def with_contamination(
    df: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "contamination"
) -> DataFrame:
    """Add ``out``, an array of (item_id, start, end, edits); a column of that name is replaced."""
    sent = df.sparkSession.sparkContext.broadcast
    found = [regions(F.col(text), sent(index)) for index in blocks(benchmark)]
    return df.withColumn(out, F.concat(*found) if len(found) > 1 else found[0])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each region of an item in a document row: doc_id, item_id, start, end, edits."""
    rows = with_contamination(docs.select("doc_id", "text"), benchmark, out="__hits")
    return rows.select("doc_id", F.inline("__hits"))


def clean_rows(df: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` without a contaminated region, columns as they are."""
    mark = unused(df, "__hits")
    return with_contamination(df, benchmark, text, mark).where(F.size(mark) == 0).drop(mark)
