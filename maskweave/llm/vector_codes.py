"""Vector codes: every part of a vector becomes the index of its nearest codebook entry.

Components become integers floor(256 x), vectors are cut into ``PARTS`` equal consecutive parts,
and every part position has a codebook of at most 64 entries: first the parts of the smallest ids,
then, in ``ROUNDS`` rounds, the floored means of the parts assigned to them.

The nearest entry is found by slicing and intersecting bitmasks.  For each dimension of a part the
entries' coordinates are sorted, and position i of that order carries a 64-bit mask of the entries
before it.  A radius that some entry is known to lie within (the nearest by one coordinate) selects a
range per dimension; the two masks at its ends differ in the entries of the range, and the ranges of all
dimensions ANDed leave the entries inside the box.  Every entry within the radius is among these
candidates, so the least distance over them is exact.

A round is one pass over the table: tasks add up their parts per entry (sums as signed limbs of
40 bits, so no size of component overflows) and Spark adds the tasks' sums.  The driver sees codebooks
only, as many numbers as 64 vectors have, and they travel to the tasks as one broadcast.

Defined results: rows whose vector is null or holds a null or non-finite component are left out; rows
with a null id are kept and come last in the order that picks the first entries, where repeated ids
are ordered by vector; fewer than 64 rows give fewer entries; vectors of each dimension have
codebooks of their own; a dimension that is no multiple of the parts is padded with zeros, so
an empty vector has parts without components; ties go to the lower index; an error or sum of errors
that is more than a long holds is the largest long; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.operators.ranking import first_n_per_key
from maskweave.session import staged

PARTS = 16
ENTRIES = 64  # one bit each in a 64-bit mask
ROUNDS = 2
SCALE = 256
LIMB = 40
BLOCK_ROWS = 4096
LARGEST = (1 << 63) - 1


# --- integers -----------------------------------------------------------------------------


def safe_bound(width: int, parts: int = PARTS) -> int:
    """Components up to this size cannot overflow a 64-bit sum of squared differences."""
    return math.isqrt((1 << 62) // max(1, width * parts)) // 2


def _exact(x: float) -> int:
    return int(x) * SCALE if abs(x) >= 1 << 53 else math.floor(x * SCALE)


def integers(vectors: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """(rows, parts, width) of floor(256 x), padded with zeros; Python integers where a component
    is too large for exact 64-bit distances."""
    rows, dim = vectors.shape
    width = -(-dim // parts)
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors.astype(np.float64) * SCALE)
    if scaled.size and np.abs(scaled).max() > safe_bound(width, parts):
        whole = np.array([[_exact(float(x)) for x in row] for row in vectors], dtype=object)
    else:
        whole = scaled.astype(np.int64)
    out = np.zeros((rows, parts * width), dtype=whole.dtype)
    out[:, :dim] = whole
    return out.reshape(rows, parts, width)


# --- nearest entries ------------------------------------------------------------------------


class Slices:
    """The entries of one part position, sorted by each coordinate, with prefix masks."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        k, width = entries.shape
        bits = np.left_shift(np.uint64(1), np.arange(k, dtype=np.uint64))
        self.order = [np.argsort(entries[:, d], kind="stable") for d in range(width)]
        self.sorted = [entries[o, d] for d, o in enumerate(self.order)]
        self.prefix = []
        for o in self.order:
            masks = np.zeros(k + 1, dtype=np.uint64)
            masks[1:] = np.bitwise_or.accumulate(bits[o])
            self.prefix.append(masks)
        self.all = np.bitwise_or.reduce(bits)

    def candidates(self, points: np.ndarray) -> np.ndarray:
        """A mask for each point that holds every nearest entry."""
        masks = np.full(len(points), self.all, dtype=np.uint64)
        radius = _root_above(self._reachable(points))
        for d, (values, prefix) in enumerate(zip(self.sorted, self.prefix)):
            low = np.searchsorted(values, points[:, d] - radius, side="left")
            high = np.searchsorted(values, points[:, d] + radius, side="right")
            masks &= prefix[high] ^ prefix[low]
        return masks

    def _reachable(self, points: np.ndarray) -> np.ndarray:
        """Squared distance to an entry that is near by one coordinate, the least over them."""
        least = np.array([LARGEST] * len(points), dtype=points.dtype) if self.sorted else _zeros(points)
        for d, (values, order) in enumerate(zip(self.sorted, self.order)):
            at = np.minimum(np.searchsorted(values, points[:, d]), len(values) - 1)
            found = _squares(points, self.entries[order[at]])
            least = found if d == 0 else np.minimum(least, found)
        return least

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each point, ties to the lower index."""
        masks = np.ascontiguousarray(self.candidates(points)).astype("<u8")
        bits = np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        who, which = np.nonzero(bits)
        far = _squares(points[who], self.entries[which])
        starts = np.searchsorted(who, np.arange(len(points)))
        least = np.minimum.reduceat(far, starts) if len(far) else far
        best = np.flatnonzero(far == least[who])
        _, first = np.unique(who[best], return_index=True)
        return which[best[first]], least


def _zeros(points: np.ndarray) -> np.ndarray:
    return np.zeros(len(points), dtype=points.dtype)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.shape[1] == 0:
        return _zeros(a)
    d = a - b
    return (d * d).sum(axis=1)


def _root_above(squares: np.ndarray) -> np.ndarray:
    """An integer not below the square root."""
    if squares.dtype == object:
        return np.array([math.isqrt(s) + 1 for s in squares], dtype=object)
    return np.sqrt(squares.astype(np.float64)).astype(np.int64) + 1


class Codebooks:
    """The codebooks of one dimension: ``entries`` is (parts, k, width)."""

    def __init__(self, entries: np.ndarray):
        parts, _, width = entries.shape
        if entries.dtype == object and all(abs(x) <= safe_bound(width, parts) for x in entries.flat):
            entries = entries.astype(np.int64)
        self.entries = entries
        self.slices = [Slices(e) for e in entries]

    def assign(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared distances), both (rows, parts), of (rows, parts, width) integers."""
        if points.dtype != self.entries.dtype:
            points = points.astype(object)
        each = [s.nearest(points[:, p]) for p, s in enumerate(self.slices)]
        return np.stack([c for c, _ in each], axis=1), np.stack([e for _, e in each], axis=1)

    def fingerprint(self) -> str:
        text = ",".join(str(x) for x in self.entries.flat)
        return hashlib.sha256(text.encode()).hexdigest()


# --- Spark --------------------------------------------------------------------------------


def usable(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, label, v) of the rows that take part."""
    v = F.col(embedding).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), v.alias("v"))
    return rows.where(F.col(embedding).isNotNull() & finite)


def _blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors) of an Arrow list column, in blocks of one dimension."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        for a in range(0, len(rows), BLOCK_ROWS):
            part = rows[a : a + BLOCK_ROWS]
            yield part, values[starts[part][:, None] + np.arange(dim)[None, :]]


def _limbs(total: int) -> list[int]:
    sign, rest, out = (1 if total >= 0 else -1), abs(int(total)), []
    while True:
        out.append(sign * (rest & ((1 << LIMB) - 1)))
        rest >>= LIMB
        if not rest:
            return out


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> dict[int, Codebooks]:
    """By dimension: the parts of the smallest ids, in order."""
    order = [F.col("vec_id").isNull(), F.col("vec_id"), F.col("v")]
    few = first_n_per_key(rows.select("vec_id", "v", F.size("v").alias("dim")), ["dim"], order, entries)
    by_dim: dict[int, list] = {}
    for r in few.orderBy("dim", *order).collect():
        by_dim.setdefault(r["dim"], []).append(r["v"])
    return {
        dim: Codebooks(integers(np.array(v, dtype=np.float64).reshape(len(v), dim), parts).swapaxes(0, 1))
        for dim, v in by_dim.items()
    }


def refined(rows: DataFrame, books: dict[int, Codebooks], parts: int) -> dict[int, Codebooks]:
    """One round: entries become the floored means of their parts; unused ones stay."""
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        counts: dict[int, np.ndarray] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, vectors in _blocks(batch.column(0)):
                dim = vectors.shape[1]
                points = integers(vectors, parts)
                codes, _ = known[dim].assign(points)
                if dim not in sums:
                    shape = known[dim].entries.shape
                    sums[dim] = np.zeros(shape, dtype=object)
                    counts[dim] = np.zeros(shape[:2], dtype=np.int64)
                for p in range(parts):
                    block = np.zeros(sums[dim].shape[1:], dtype=points.dtype)
                    np.add.at(block, codes[:, p], points[:, p])
                    sums[dim][p] += block
                    counts[dim][p] += np.bincount(codes[:, p], minlength=len(block))
        out = []
        for dim, n in counts.items():
            for p, e in zip(*np.nonzero(n)):
                limbs = [_limbs(x) for x in sums[dim][p, e]]
                for i in range(max((len(x) for x in limbs), default=1)):
                    row = [x[i] if i < len(x) else 0 for x in limbs]
                    out.append((dim, p, e, i, int(n[p, e]) if i == 0 else 0, row))
        columns = list(zip(*out)) if out else [[]] * 6
        types = [pa.int32()] * 4 + [pa.int64(), pa.list_(pa.int64())]
        arrays = [pa.array([x if isinstance(x, list) else int(x) for x in c], t) for c, t in zip(columns, types)]
        yield pa.RecordBatch.from_arrays(arrays, ["dim", "part", "entry", "limb", "n", "sums"])

    partial = rows.select("v").mapInArrow(
        add_up, "dim int, part int, entry int, limb int, n bigint, sums array<bigint>"
    )
    width = max((b.entries.shape[2] for b in books.values()), default=0)
    totals = partial.groupBy("dim", "part", "entry", "limb").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums")
    )
    fresh = {dim: b.entries.astype(object) for dim, b in books.items()}
    found: dict[tuple, list] = {}
    # As many rows as codebooks have entries.
    for r in totals.collect():
        n_and_sums = found.setdefault((r["dim"], r["part"], r["entry"]), [0, [0] * width])
        n_and_sums[0] += r["n"]
        for i, x in enumerate(r["sums"]):
            n_and_sums[1][i] += (x or 0) << (LIMB * r["limb"])
    for (dim, p, e), (n, s) in found.items():
        fresh[dim][p, e] = [x // n for x in s[: fresh[dim].shape[2]]]
    sent.unpersist()
    return {dim: Codebooks(entries) for dim, entries in fresh.items()}


def encoded(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, dict[int, Codebooks]]:
    """((vec_id, label, dim, code, error) of every usable row, codebooks by dimension)."""
    if not 1 <= entries <= ENTRIES:
        raise ValueError("a codebook has 1 to 64 entries")
    rows = usable(vectors, vec_id, embedding, label)
    books = first_codebooks(rows, parts, entries)
    for _ in range(rounds):
        books = refined(rows, books, parts)
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            n = batch.num_rows
            dims, codes, errors = np.zeros(n, np.int32), np.empty(n, object), np.zeros(n, np.int64)
            for who, vectors in _blocks(batch.column(2)):
                found, far = known[vectors.shape[1]].assign(integers(vectors, parts))
                dims[who] = vectors.shape[1]
                codes[who] = [bytes(c).hex() for c in found.astype(np.uint8)]
                errors[who] = [min(int(e), LARGEST) for e in far.sum(axis=1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(dims), pa.array(codes, pa.string()), pa.array(errors)],
                ["vec_id", "label", "dim", "code", "error"],
            )

    types = dict(rows.dtypes)
    schema = f"vec_id {types['vec_id']}, label {types['label']}, dim int, code string, error bigint"
    return rows.mapInArrow(encode, schema), books


def _fingerprint(books: dict[int, Codebooks]) -> Column:
    pairs = [F.lit(x) for dim, b in sorted(books.items()) for x in (dim, b.fingerprint())]
    return F.element_at(F.create_map(*pairs), F.col("dim")) if pairs else F.lit(None).cast("string")


def digest(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256)."""
    rows, books = encoded(vectors)
    coded = staged(rows, "vector-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)"))
    by_label = coded.groupBy("label").agg(total.cast("bigint").alias("label_error"))
    named = by_label.withColumnRenamed("label", "__label")
    return coded.join(named, F.col("label").eqNullSafe(F.col("__label"))).select(
        "vec_id", "code", "error", "label_error", _fingerprint(books).alias("codebooks_sha256")
    )
