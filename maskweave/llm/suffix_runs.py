"""Exact substring dedup by a distributed merge sort of suffixes that keeps common prefixes.

A byte goes if a ``LENGTH``-byte string over it also starts anywhere else.  Not every suffix has to
be sorted: each window of LENGTH bytes names one of its positions, the one whose ``GRAM``-byte
string has the smallest hash (the leftmost of equals).  Equal windows name the same place, so
comparing the suffixes at named positions (anchors) finds every repeated window:

1. anchors whose gram hash occurs once in the whole table are done: none of their windows repeat;
2. of the others each task sorts the suffixes (the LENGTH bytes after the anchor), front-codes them
   (shared prefix length and rest), and sends sorted runs, dealt by gram hash;
3. runs are merged with loser trees: a candidate knows its common prefix with the last output, so a
   larger one wins without a look at the bytes, and equal ones are compared from there on;
4. in a group of equal grams the merged prefix lengths, and those of the bytes before the anchors,
   tell for which offsets a window of a member equals one of another member.  Per member that is
   one range, whose bytes go.

Grams that occur more than ``HOT_ROWS`` times would make one group too large for a task; the
windows at their anchors are counted by a 128-bit hash instead, which combines on the map side.

Defined results: null and empty texts have no byte; texts shorter than LENGTH lose nothing;
matches never cross rows; repeated rows match each other and lose everything that long; every row
of the input gives one row; texts of any length are read whole; extra columns are not read.
The row numbers come from the scan, so the input must be a table or another stable source.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENGTH = 200
GRAM = 64
# Window starts a single anchor can stand for, and so the bytes before it that matter.
REACH = LENGTH - GRAM
HOT_ROWS = 32_768
# Bytes of text hashed at a time, and the longest piece of one text among them.
CHUNK = 1_000_000
PIECE = 500_000
# Suffixes of a run, and the bytes of contexts a merging task should get.
RUN_ROWS = 20_000
MERGE_BYTES = 32 * 1024 * 1024
SMALL_GROUP = 6

_ODD = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
_POSITION_BITS = 21


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = CHUNK + LENGTH + 1
    out = []
    for base in (_ODD, pow(_ODD, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes at each position of a chunk."""
    if len(data) < length:
        return np.empty(0, np.uint64)
    power, inverse = _powers()
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    h = (sums[length:] - sums[:-length]) * inverse[: n - length + 1]
    h ^= h >> np.uint64(33)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def _pieces(data: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Chunks of (text number, offset, bytes); pieces of a text overlap by LENGTH - 1."""
    chunk, size = [], 0
    for k, b in enumerate(data):
        for at in range(0, max(1, len(b) - LENGTH + 1), PIECE):
            part = b[at : at + PIECE + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            if chunk and size + len(part) > CHUNK:
                yield chunk
                chunk, size = [], 0
            chunk.append((k, at, part))
            size += len(part)
    if chunk:
        yield chunk


def anchors(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, gram hash) of every anchor of the texts."""
    texts, places, hashes = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for chunk in _pieces(data):
        joined = np.frombuffer(b"".join(p for _, _, p in chunk), np.uint8)
        sizes = np.array([len(p) for _, _, p in chunk], np.int64)
        ends = np.cumsum(sizes)
        h = window_hashes(joined, GRAM)
        low = np.uint64((1 << _POSITION_BITS) - 1)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        span, width = 1, REACH + 1
        while 2 * span <= width:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < width:
            key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
        # Windows that end behind their text do not count.
        room = np.repeat(ends, sizes)[: len(key)] - np.arange(len(key))
        named = (key[room >= LENGTH] & low).astype(np.int64)
        named = named[np.concatenate(([True], named[1:] != named[:-1]))] if len(named) else named
        piece = np.searchsorted(ends, named, side="right")
        start = ends - sizes
        texts.append(np.array([k for k, _, _ in chunk], np.int64)[piece])
        places.append(named - start[piece] + np.array([a for _, a, _ in chunk], np.int64)[piece])
        hashes.append(h[named])
    text, place, gram = np.concatenate(texts), np.concatenate(places), np.concatenate(hashes)
    # Overlapping pieces name some positions twice.
    order = np.lexsort((place, text))
    text, place, gram = text[order], place[order], gram[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (place[1:] != place[:-1])
    return text[new], place[new], gram[new]


# -- sorted, front-coded runs


def _prefix(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before (0 for the first)."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        out[1:] = np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))
    return out


def _rest(rows: np.ndarray, shared: np.ndarray, sizes: np.ndarray) -> bytes:
    spots = np.arange(rows.shape[1])
    return rows[(spots >= shared[:, None]) & (spots < sizes[:, None])].tobytes()


def front_coded(data: list[bytes], rids: np.ndarray, text: np.ndarray, place: np.ndarray) -> dict:
    """One sorted run of the suffixes at (text, place) with the bytes before them, reversed."""
    m = len(text)
    after, before = np.zeros((m, LENGTH), np.uint8), np.zeros((m, REACH), np.uint8)
    n_after, n_before = np.empty(m, np.int64), np.empty(m, np.int64)
    for k, (t, p) in enumerate(zip(text.tolist(), place.tolist())):
        a, b = data[t][p : p + LENGTH], data[t][max(0, p - REACH) : p][::-1]
        after[k, : len(a)] = np.frombuffer(a, np.uint8)
        before[k, : len(b)] = np.frombuffer(b, np.uint8)
        n_after[k], n_before[k] = len(a), len(b)
    order = np.lexsort((n_after, after.view(f"S{LENGTH}").reshape(-1)))
    after, n_after, before, n_before = after[order], n_after[order], before[order], n_before[order]
    shared, shared_before = _prefix(after, n_after), _prefix(before, n_before)
    return {
        "shared": shared.astype(np.uint8).tobytes(),
        "size": n_after.astype(np.uint8).tobytes(),
        "rest": _rest(after, shared, n_after),
        "shared_before": shared_before.astype(np.uint8).tobytes(),
        "size_before": n_before.astype(np.uint8).tobytes(),
        "rest_before": _rest(before, shared_before, n_before),
        "rid": rids[text[order]].astype("<i8").tobytes(),
        "place": place[order].astype("<i4").tobytes(),
    }


RUN_FIELDS = ["shared", "size", "rest", "shared_before", "size_before", "rest_before", "rid", "place"]
RUN_TYPE = "part int, " + ", ".join(f"{f} binary" for f in RUN_FIELDS)


class Run:
    """Reads a front-coded run: its present suffix and that suffix's common prefix with the last."""

    def __init__(self, fields: dict):
        self.shared, self.size = fields["shared"], fields["size"]
        self.rest, self.rest_before = fields["rest"], fields["rest_before"]
        self.shared_before, self.size_before = fields["shared_before"], fields["size_before"]
        self.rid = np.frombuffer(fields["rid"], "<i8").tolist()
        self.place = np.frombuffer(fields["place"], "<i4").tolist()
        self.at, self.spot, self.spot_before = -1, 0, 0
        self.suffix: bytes | None = b""
        self.before = b""
        self.step()

    def step(self) -> int:
        """Go to the next suffix; returns its common prefix with the one left behind."""
        self.at += 1
        if self.at >= len(self.rid):
            self.suffix = None
            return 0
        shared, stop = self.shared[self.at], self.spot + self.size[self.at] - self.shared[self.at]
        self.suffix = self.suffix[:shared] + self.rest[self.spot : stop]
        self.spot = stop
        kept = self.shared_before[self.at]
        stop = self.spot_before + self.size_before[self.at] - kept
        self.before = self.before[:kept] + self.rest_before[self.spot_before : stop]
        self.spot_before = stop
        return shared


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two byte strings that share ``known`` bytes."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    size = n - known
    differing = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return known + size - (differing.bit_length() + 7) // 8


def merged(runs: list[Run]) -> Iterator[tuple[int, Run]]:
    """(common prefix with the last output, run at its present suffix), in suffix order.

    A loser tree: every inner node holds a run that lost there, with its common prefix to the
    winner it lost to.  All prefixes met on the way up belong to the last output, so the longer
    one wins unseen; only equal ones are compared, from that length on.
    """
    count = len(runs)
    losers: list[tuple[int, int]] = [(-1, 0)] * max(1, count)  # run number, prefix

    def play(a: int, pa_: int, b: int, pb: int):
        """Winner and its prefix, loser and the loser's prefix with the winner."""
        x, y = runs[a].suffix, runs[b].suffix
        if y is None:
            return a, pa_, b, 0
        if x is None:
            return b, pb, a, 0
        if pa_ != pb:
            return (a, pa_, b, pb) if pa_ > pb else (b, pb, a, pa_)
        n = common_prefix(x, y, pa_)
        first_wins = (a < b) if n == len(x) == len(y) else x[n:] < y[n:]
        return (a, pa_, b, n) if first_wins else (b, pb, a, n)

    def start(node: int) -> tuple[int, int]:
        if node >= count:
            return node - count, 0
        a, pa_ = start(2 * node)
        b, pb = start(2 * node + 1)
        win, pw, lose, pl = play(a, pa_, b, pb)
        losers[node] = (lose, pl)
        return win, pw

    if not count:
        return
    win, prefix = start(1) if count > 1 else (0, 0)
    while runs[win].suffix is not None:
        yield prefix, runs[win]
        prefix = runs[win].step()
        node = (win + count) // 2
        while node:
            other, p = losers[node]
            win, prefix, lose, pl = play(win, prefix, other, p)
            losers[node] = (lose, pl)
            node //= 2


# -- groups of equal grams


def group_ranges(prefixes: list[int], befores: list[bytes], sizes: list[int]) -> list[tuple[int, int] | None]:
    """For each member of a group the smallest and largest offset (anchor minus window start) at
    which its window equals one of another member; None if there is none.

    ``prefixes[i]`` is the common prefix of suffixes i - 1 and i, which are in suffix order.
    """
    m = len(befores)
    if m <= SMALL_GROUP:
        out: list[tuple[int, int] | None] = [None] * m
        for i in range(m):
            right = LENGTH
            for j in range(i + 1, m):
                right = min(right, prefixes[j])
                low, high = LENGTH - right, common_prefix(befores[i], befores[j])
                if low <= high:
                    for k in (i, j):
                        old = out[k]
                        out[k] = (low, high) if old is None else (min(low, old[0]), max(high, old[1]))
        return out
    right = np.array(prefixes, np.int64)
    right[0] = 0
    order = sorted(range(m), key=befores.__getitem__)
    left = np.array(
        [0] + [common_prefix(befores[a], befores[b]) for a, b in zip(order, order[1:])], np.int64
    )
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    # Classes of equal windows only change at these offsets.
    cuts = np.unique(np.concatenate(([0, REACH + 1], LENGTH - right, left + 1)))
    cuts = cuts[(cuts >= 0) & (cuts <= REACH + 1)]
    low, high = np.full(m, REACH + 1), np.full(m, -1)
    for o, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        same_right = np.cumsum(right < LENGTH - o)
        same_left = np.cumsum(left < o)[place]
        _, which, count = np.unique(same_right * (m + 1) + same_left, return_inverse=True, return_counts=True)
        again = count[which] > 1
        low[again] = np.minimum(low[again], o)
        high[again] = np.maximum(high[again], stop - 1)
    return [(a, b) if b >= 0 else None for a, b in zip(low.tolist(), high.tolist())]


def repeated_ranges(runs: list[Run]) -> tuple[list[int], list[int], list[int]]:
    """(rid, start, end) of the ranges that repeat, over all groups of the merged runs."""
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    prefixes: list[int] = []
    befores: list[bytes] = []
    sizes: list[int] = []
    where: list[tuple[int, int]] = []

    def close() -> None:
        if len(where) > 1:
            for (rid, p), found in zip(where, group_ranges(prefixes, befores, sizes)):
                if found is not None:
                    out[0].append(rid)
                    out[1].append(p - found[1])
                    out[2].append(p - found[0] + LENGTH)
        for x in (prefixes, befores, sizes, where):
            x.clear()

    for prefix, run in merged(runs):
        if prefix < GRAM:
            close()
        prefixes.append(prefix)
        befores.append(run.before)
        sizes.append(len(run.suffix))
        where.append((run.rid[run.at], run.place[run.at]))
    close()
    return out


# -- Spark


def _numbered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(rid, doc_id, data), dealt by rid; every later step reads this one exchange again."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(doc_id).alias("doc_id"),
        F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("data"),
    )
    return rows.repartition("rid")


def _find_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rids = b["rid"].to_numpy(np.int64)
        text, place, gram = anchors(b["data"].tolist())
        yield pd.DataFrame({"rid": rids[text], "place": place.astype(np.int32), "gram": gram.view(np.int64)})


def _send_runs(parts: int):
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data, rids = b["data"].tolist(), b["rid"].to_numpy(np.int64)
            sizes = b["at"].map(len).to_numpy(np.int64)
            text = np.repeat(np.arange(len(b)), sizes)
            place = np.fromiter((x["place"] for row in b["at"] for x in row), np.int64, int(sizes.sum()))
            gram = np.fromiter((x["gram"] for row in b["at"] for x in row), np.int64, int(sizes.sum()))
            part = (gram.view(np.uint64) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            for p in range(parts):
                for a in range(edges[p], edges[p + 1], RUN_ROWS):
                    rows = order[a : min(a + RUN_ROWS, edges[p + 1])]
                    run = front_coded(data, rids, text[rows], place[rows])
                    yield pd.DataFrame({"part": [p], **{f: [run[f]] for f in RUN_FIELDS}})

    return send


def _merge_runs(frame: pd.DataFrame) -> pd.DataFrame:
    runs = [Run({f: row[f] for f in RUN_FIELDS}) for _, row in frame.iterrows()]
    rid, start, end = repeated_ranges(runs)
    return pd.DataFrame({"rid": rid, "start": start, "end": end}, dtype=np.int64)


def _hash_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import xxhash

    for b in batches:
        for rid, data, at in zip(b["rid"], b["data"], b["at"]):
            starts = sorted(
                {s for x in at for s in range(max(0, x["place"] - REACH), x["place"] + 1) if s + LENGTH <= len(data)}
            )
            for a in range(0, len(starts), 50_000):
                part = starts[a : a + 50_000]
                digests = b"".join(xxhash.xxh3_128_digest(data[s : s + LENGTH]) for s in part)
                pair = np.frombuffer(digests, "<i8").reshape(-1, 2)
                yield pd.DataFrame({"w1": pair[:, 0], "w2": pair[:, 1], "rid": rid, "start": part})


def repeated(rows: DataFrame) -> DataFrame:
    """(rid, start, end): ranges, overlapping, of all bytes that repeat in (rid, doc_id, data)."""
    # Nothing is selected from ``rows``: with the same columns everywhere it is one exchange.
    found = rows.mapInPandas(_find_anchors, "rid bigint, place int, gram bigint")
    counts = found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    shared = found.join(counts, "gram")
    place = F.struct("place", "gram")

    def at_texts(condition: str) -> DataFrame:
        # One group per row of the table: bounded by the anchors of one text.
        at = shared.where(condition).groupBy("rid").agg(F.collect_list(place).alias("at"))
        return rows.join(at, "rid")

    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    runs = at_texts(f"n <= {HOT_ROWS}").mapInPandas(_send_runs(parts), RUN_TYPE)
    normal = runs.groupBy("part").applyInPandas(_merge_runs, "rid bigint, start bigint, end bigint")
    windows = at_texts(f"n > {HOT_ROWS}").mapInPandas(
        _hash_windows, "w1 bigint, w2 bigint, rid bigint, start bigint"
    )
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1")
    hot = windows.join(twice.drop("n"), ["w1", "w2"]).select(
        "rid", "start", (F.col("start") + LENGTH).alias("end")
    )
    return normal.unionByName(hot)


def _kept(data: Column, ranges: Column) -> Column:
    """struct(n_removed, n_spans, removed ranges, kept bytes)."""
    kind = "struct<n_removed:bigint,n_spans:bigint,removed:array<struct<start:bigint,end:bigint>>,kept:binary>"

    @F.arrow_udf(kind)
    def cut(data: pa.Array, ranges: pa.Array) -> pa.Array:
        out = []
        for d, r in zip(data, ranges):
            b, rows = d.as_py(), r.values
            spans: list[list[int]] = []
            if rows is not None and len(rows):
                both = np.stack(
                    [rows.field("start").to_numpy(zero_copy_only=False), rows.field("end").to_numpy(zero_copy_only=False)], axis=1
                )
                both = both[np.lexsort((both[:, 1], both[:, 0]))]
                reach = np.maximum.accumulate(both[:, 1])
                new = np.flatnonzero(both[1:, 0] > reach[:-1]) + 1
                starts = both[np.concatenate(([0], new)), 0]
                ends = reach[np.concatenate((new - 1, [len(reach) - 1]))]
                spans = [[int(s), int(e)] for s, e in zip(starts, ends)]
            pieces, at = [], 0
            for s, e in spans:
                pieces.append(b[at:s])
                at = e
            pieces.append(b[at:])
            out.append(
                {
                    "n_removed": sum(e - s for s, e in spans),
                    "n_spans": len(spans),
                    "removed": [{"start": s, "end": e} for s, e in spans],
                    "kept": b"".join(pieces),
                }
            )
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        return pa.array(
            out,
            pa.struct(
                [("n_removed", pa.int64()), ("n_spans", pa.int64()), ("removed", pa.list_(span)), ("kept", pa.binary())]
            ),
        )

    return cut(data, ranges)


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, removed, kept) of every row."""
    rows = _numbered(docs, doc_id, text)
    ranges = repeated(rows).groupBy("rid").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    joined = rows.join(ranges, "rid", "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    cut = joined.select("doc_id", "data", _kept(F.col("data"), F.coalesce("ranges", none)).alias("cut"))
    return cut.select("doc_id", F.length("data").cast("bigint").alias("n_bytes"), "cut.*")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    return deduplicated(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
