"""Approximate nearest neighbours by vantage-point trees, one per shard.

Vectors are scaled to length one, where the largest cosine is the smallest Euclidean distance.
The rows are dealt into shards by a hash of the id; each shard's task builds a tree that splits
at the median distance from a vantage point.  All queries of a block go down a tree together: at
a node each first visits the side it lies on, then the other side unless the triangle inequality
rules it out.  ``relax`` widens that rule: with factor one a side is left out only if it cannot
hold a nearer vector (exact search), with a smaller factor the current radius counts that much
less.  Final scores are cosines in double precision on the original vectors.

Vectors of one direction (to seven digits) are one point of the tree, so a vector shared by a third of the
rows costs one comparison.  Every vector of a direction that is found gets its exact score, so ties and near
ties are settled by score and id alone; of rows with equal vectors the smallest ids are enough for any
answer.  Components are scaled by a power of two first, which changes no cosine and keeps squares of
huge and tiny ones in range.  Queries meet the shards through a shuffle, in blocks, so nothing is
broadcast or collected whole.

Defined results: rows whose id or vector is null, whose vector is empty, has length zero or holds
a null or non-finite component take no part; vectors of different dimension are never compared;
repeated rows of one id count once (the first vector by value); a query's own id is no candidate;
fewer candidates than k give fewer rows; ties go to the smaller id; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 5
# Rows of a shard; bounds a task's tree whatever the size of the table.
SHARD_ROWS = 16_384
# Queries searched together in one task.
QUERY_BLOCK = 16_384
LEAF = 128
# Share of the current radius that pruning respects; 1.0 is exact.
RELAX = 0.8
# Directions kept while searching beyond k, so that rounding cannot displace an answer before rescoring.
SPARE = 3
# Vectors whose unit vectors agree on this grid are one direction.
GRID = 1e7
# Scored pairs held at a time.
PAIRS = 1_000_000


class Tree:
    """A vantage-point tree over unit vectors (rows of ``points``)."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.leaf = leaf
        self.root = self._build(np.arange(len(points)), 0)

    def _build(self, rows: np.ndarray, depth: int):
        if len(rows) <= self.leaf:
            return rows
        vantage = rows[(depth * 7919) % len(rows)]
        d = _distances(self.points[rows], self.points[vantage])
        radius = float(np.median(d))
        inside = d <= radius
        if inside.all() or not inside.any():
            return rows  # no split by distance; a wide leaf is still right
        return (
            self.points[vantage],
            radius,
            self._build(rows[inside], depth + 1),
            self._build(rows[~inside], depth + 1),
        )

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, relax: float):
        """(distances, rows) of the k nearest points of each query but row ``own`` (-1: none)."""
        self.best = np.full((len(queries), k), np.inf)
        self.rows = np.full((len(queries), k), -1)
        self.queries, self.own, self.relax = queries, own, relax
        if len(self.points):
            self._visit(self.root, np.arange(len(queries)))
        return self.best, self.rows

    def _visit(self, node, who: np.ndarray) -> None:
        if not len(who):
            return
        if isinstance(node, np.ndarray):
            self._scan(node, who)
            return
        vantage, radius, near, far = node
        d = _distances(self.queries[who], vantage)
        inside = d <= radius
        self._visit(near, who[inside])
        self._visit(far, who[~inside])
        gap = np.abs(d - radius)
        open_ = gap <= self.relax * self.best[who, -1] + 1e-12
        self._visit(far, who[inside & open_])
        self._visit(near, who[~inside & open_])

    def _scan(self, rows: np.ndarray, who: np.ndarray) -> None:
        k = self.best.shape[1]
        for a in range(0, len(who), 1024):
            part = who[a : a + 1024]
            dots = self.queries[part] @ self.points[rows].T
            d = np.sqrt(np.maximum(2.0 - 2.0 * dots, 0.0))
            d[self.own[part][:, None] == rows[None, :]] = np.inf
            every = np.concatenate((self.best[part], d), axis=1)
            which = np.concatenate((self.rows[part], np.broadcast_to(rows, d.shape)), axis=1)
            top = np.argpartition(every, k - 1, axis=1)[:, :k]
            every = np.take_along_axis(every, top, axis=1)
            order = np.argsort(every, axis=1)
            self.best[part] = np.take_along_axis(every, order, axis=1)
            self.rows[part] = np.take_along_axis(np.take_along_axis(which, top, axis=1), order, axis=1)


def _distances(points: np.ndarray, vantage: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (points @ vantage), 0.0))


def _unit(v: np.ndarray) -> np.ndarray:
    big = np.abs(v).max(axis=1, keepdims=True)
    v = v / big  # squares of huge or tiny components stay in range
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _scaled(v: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest component near one."""
    _, exponent = np.frexp(np.abs(v).max(axis=1, keepdims=True))
    return np.ldexp(v, -exponent)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of corresponding rows, the same to the bit for equal pairs."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v): one double vector of each id that takes part."""
    v = F.col(embedding).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(vec_id).alias("id"), v.alias("v")).where(
        F.col(vec_id).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    )
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def nearest(
    vectors: DataFrame,
    is_query,
    k: int = K,
    relax: float = RELAX,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every row where ``is_query(id)``."""
    rows = usable(vectors, vec_id, embedding)
    n = vectors.count()
    shards = max(1, -(-n // shard_rows))
    candidates = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    asked = rows.where(is_query(F.col("id")))
    blocks = max(1, -(-asked.count() // query_block))
    block = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(blocks)).cast("int")
    # Each block of queries meets each shard in one task.
    queries = asked.withColumn("block", block).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )
    shared = candidates.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    id_type = dict(rows.dtypes)["id"]

    def search(points: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []})]
        dims = asking["v"].map(len)
        for dim in dims.unique():
            q = asking[dims == dim]
            p = points[points["v"].map(len) == dim].sort_values("id")
            if len(q) and len(p):
                out.append(_found(p, q, k, relax))
        return pd.concat(out)

    found = (
        shared.groupBy("shard", "block")
        .cogroup(queries.groupBy("shard", "block"))
        .applyInPandas(search, f"query_id {id_type}, vec_id {id_type}, score double")
    )
    # Every shard sends at most k rows of a query, so a query's group is bounded by k x shards;
    # the window keeps k of each task's rows before it shuffles.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _found(p: pd.DataFrame, q: pd.DataFrame, k: int, relax: float) -> pd.DataFrame:
    vectors, asking = (_scaled(np.stack(x["v"].to_numpy())) for x in (p, q))
    ids, query_ids = p["id"].to_numpy(), q["id"].to_numpy()
    # Equal vectors are one class; ``members`` lists their rows by rising id.
    distinct, label = _classes(vectors)
    members, first, sizes = _lists(label, len(distinct))
    # Classes of one direction are one point of the tree.
    unit = _unit(distinct)
    directions, which_way = _classes(np.round(unit * GRID).astype(np.int64))
    classes, first_class, n_classes = _lists(which_way, len(directions))
    # A direction with nobody but the query itself is no candidate.
    rows_there = np.bincount(which_way[label], minlength=len(directions))
    row_of = pd.Series(np.arange(len(ids)), index=ids)
    own_row = row_of.reindex(query_ids).to_numpy()
    own = np.full(len(asking), -1)
    mine = np.flatnonzero(~np.isnan(own_row.astype(np.float64)))
    own_way = which_way[label[own_row[mine].astype(np.int64)]]
    own[mine] = np.where(rows_there[own_way] == 1, own_way, -1)
    _, hits = Tree(unit[classes[first_class]]).search(_unit(asking), own, k + SPARE, relax)
    # At most k + 1 members of a class can be among the k answers (one may be the query).
    take = np.minimum(sizes, k + 1)
    rows_kept = np.bincount(which_way, weights=take, minlength=len(directions))
    work = np.cumsum(np.where(hits >= 0, rows_kept[hits], 0).sum(axis=1))
    out = [pd.DataFrame({"query_id": query_ids[:0], "vec_id": ids[:0], "score": np.empty(0)})]
    for part in np.split(np.arange(len(asking)), np.flatnonzero(np.diff(work // PAIRS)) + 1):
        who, column = np.nonzero(hits[part] >= 0)
        who = part[who]
        way = hits[part][hits[part] >= 0]
        who, step = _repeated(who, n_classes[way])
        point = classes[np.repeat(first_class[way], n_classes[way]) + step]
        score = _cosines(asking[who], distinct[point])
        score = np.repeat(score, take[point])
        who, step = _repeated(who, take[point])
        row = members[np.repeat(first[point], take[point]) + step]
        keep = ids[row] != query_ids[who]
        who, row, score = who[keep], row[keep], score[keep]
        order = np.lexsort((ids[row], -score, who))
        who, row, score = who[order], row[order], score[order]
        kept = np.arange(len(who)) - np.searchsorted(who, who) < k
        out.append(pd.DataFrame({"query_id": query_ids[who[kept]], "vec_id": ids[row[kept]], "score": score[kept]}))
    return pd.concat(out[1:] or out)


def _classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, label = np.unique(rows, axis=0, return_inverse=True)
    return distinct, label.reshape(-1)


def _lists(label: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(members class by class in order, where each class begins, sizes)"""
    members = np.argsort(label, kind="stable")
    return members, np.searchsorted(label[members], np.arange(n)), np.bincount(label, minlength=n)


def _repeated(rows: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row so many times, and the number of each repetition from zero."""
    ends = np.cumsum(times)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(rows, times), np.arange(total) - np.repeat(ends - times, times)


def digest(embeddings: DataFrame) -> DataFrame:
    """Answers for the rows whose id is divisible by 50."""
    return nearest(embeddings, lambda i: i % 50 == 0).select("query_id", "rank", "vec_id", "score")
