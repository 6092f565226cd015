"""Conversation prefix trie from composable fingerprints of turn sequences.

A conversation c is rebuilt from the first h turns of its base conversation c - c % 100 and its
own turns after the first h (h = crc32 of c's decimal form, modulo 6).  Every distinct sequence of the
first d rebuilt turns is a node at depth d; the conversations that start with it are its members.

No rebuilt text or sequence is ever made.  A turn becomes four residues modulo a prime, and a run
of turns the sums of t_j B^j over its positions, a monoid: runs are joined by shifting the later one
by a power of B.  The fingerprint of a rebuilt prefix is the base's head product combined
with the product of the own suffix, all from running products of the stored turns:
head(m) + B^(m-h) (own(i) - own(h)).  Running products come from one range-partitioned sort by
(conversation, turn): a task multiplies along its rows, and what a task's first conversation owes to
earlier tasks is composed from one state of each partition.  So a conversation of any length is many tasks.

Equality is proven, not assumed: a turn is referred to by two 64-bit content hashes, which are checked
to stand for one (role, text) each, and all members of a node must agree on the reference of their
last turn and on the parent's fingerprint.  By induction their sequences are equal; should a
fingerprint ever collide, the whole is done again with other bases.

Sums over a subtree need no walk: each node belongs to its smallest member.  With T(c) the weight of
all nodes that belong to c, a node's subtree weighs the sum of T over its members less the nodes
above it that belong to the same owner; its leaves are the members that own one.

Defined results: rows with a null conv_id belong to no conversation; a null role or text is empty;
rows of one turn number (nulls first) are ordered by role, then by content hash; repeated rows are
turns like any other; an absent base gives no turns; a conversation without a rebuilt turn is a
member of the root alone; an empty table has no node; long texts are hashed whole; extra columns are
not read.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.operators.ranking import running
from maskweave.session import staged

PRIME = (1 << 31) - 1
LANES = 4
GROUP = 100
MAX_HEAD = 5
ATTEMPTS = 8
# Conversation ids joined in one row before a node's ids are hashed.
IDS_PER_CHUNK = 4096
DEPTH_BLOCK = 4096

NODE = ["d", "f", "g"]


def bases(seed: int) -> list[int]:
    rng = random.Random(seed)
    return [rng.randrange(1 << 20, PRIME - 1) for _ in range(LANES)]


def head_size(conv: Column) -> Column:
    return F.crc32(conv.cast("string")) % (MAX_HEAD + 1)


# --- turns ----------------------------------------------------------------------------------


def referenced(conversations: DataFrame, seed: int, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turn, role, text, h1, h2) of every turn of a conversation."""
    who, what = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("bigint").alias("conv_id"),
        F.col(turn).alias("turn"),
        who.alias("role"),
        what.alias("text"),
    )
    return rows.withColumns(
        {
            "h1": F.xxhash64(F.lit(2 * seed), "role", "text"),
            "h2": F.xxhash64(F.lit(2 * seed + 1), "text", "role"),
        }
    )


def ambiguous_references(turns: DataFrame) -> int:
    """How many references stand for more than one (role, text)."""
    distinct = turns.select("h1", "h2", "role", "text").distinct()
    return distinct.groupBy("h1", "h2").count().where(F.col("count") > 1).count()


class Powers:
    """B^0, B^1, ... of each lane, as far as asked for."""

    def __init__(self, of: list[int]):
        self.table = np.array([[1, b] for b in of], dtype=np.int64)

    def at(self, exponents: np.ndarray) -> np.ndarray:
        """(n, lanes)"""
        need = int(exponents.max()) if len(exponents) else 0
        while self.table.shape[1] <= need:
            n = self.table.shape[1]
            step = self.table[:, n - 1] * self.table[:, 1] % PRIME
            self.table = np.concatenate((self.table, self.table * step[:, None] % PRIME), axis=1)
        return self.table[:, exponents].T


def _residues(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Four residues of a turn, (n, lanes)."""
    halves = [h1.view(np.uint64), h2.view(np.uint64)]
    parts = [(h >> np.uint64(s)) & np.uint64(PRIME) for h in halves for s in (0, 32)]
    return np.stack(parts, axis=1).astype(np.int64) % PRIME


def positions(turns: DataFrame, of: list[int]) -> DataFrame:
    """Turns with their position in the conversation (from 1) and running products.

    ``w`` is the product up to and including the turn, ``v`` the one before it.
    """
    order = ["conv_id", "turn", "role", "h1", "h2", "row"]
    placed = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = placed.select(F.spark_partition_id().alias("part"), "conv_id", "h1", "h2", "chars")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(of)
        conv, place, product = None, 0, np.zeros(LANES, dtype=np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids, h1, h2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            start = np.ones(n, dtype=bool)
            start[1:] = ids[1:] != ids[:-1]
            start[0] = conv is None or ids[0] != conv
            rows = np.arange(n)
            run = np.maximum.accumulate(np.where(start, rows, -1))  # -1: still the last batch's
            at = np.where(run < 0, place + rows + 1, rows - run + 1)
            terms = _residues(h1, h2) * powers.at(at) % PRIME
            before = np.concatenate((np.zeros((1, LANES), dtype=np.int64), np.cumsum(terms, axis=0)))
            offset = np.where((run < 0)[:, None], -product[None, :], before[np.maximum(run, 0)])
            w = (before[1:] - offset) % PRIME
            v = (w - terms) % PRIME
            conv, place, product = ids[-1], int(at[-1]), w[-1]
            lanes = [pa.array(x[:, k].astype(np.int32)) for x in (w, v) for k in range(LANES)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(at.astype(np.int64)), *lanes],
                [*batch.schema.names, "pos", *_lanes("w"), *_lanes("v")],
            )

    lanes = ", ".join(f"{c} int" for c in (*_lanes("w"), *_lanes("v")))
    local = rows.mapInArrow(
        multiply, f"part int, conv_id bigint, h1 bigint, h2 bigint, chars bigint, pos bigint, {lanes}"
    )
    return _composed(staged(local, "trie-products"), of)


def _lanes(name: str) -> list[str]:
    return [f"{name}{k}" for k in range(LANES)]


def _composed(local: DataFrame, of: list[int]) -> DataFrame:
    """Positions and products of whole conversations from those within each partition.

    Only the first conversation of a partition can have begun in an earlier one, so one state of
    each partition (that of its last conversation) is all that is needed to go on.
    """
    state = F.struct("pos", *_lanes("w"))
    ends = local.groupBy("part").agg(
        F.min("conv_id").alias("first"),
        F.max("conv_id").alias("last"),
        F.max_by(state, F.struct("conv_id", "pos")).alias("state"),
    )
    owed, conv, place, product = [], None, 0, [0] * LANES
    for r in ends.orderBy("part").collect():
        n, w = r["state"]["pos"], [r["state"][c] for c in _lanes("w")]
        goes_on = r["first"] == conv
        if goes_on:
            shift = [pow(b, place, PRIME) for b in of]
            owed.append((r["part"], conv, place, *product, *shift))
        if goes_on and r["last"] == conv:
            product = [(p + s * x) % PRIME for p, s, x in zip(product, shift, w)]
            place += n
        else:
            conv, place, product = r["last"], n, w
    names = ["part", "conv_id", "o", *_lanes("p"), *_lanes("s")]
    schema = ", ".join(f"{c} {'int' if c == 'part' else 'bigint'}" for c in names)
    earlier = local.sparkSession.createDataFrame(owed, schema)
    joined = local.join(earlier, ["part", "conv_id"], "left")

    def whole(name: str, k: int) -> Column:
        shifted = F.coalesce(f"s{k}", F.lit(1).cast("bigint")) * F.col(f"{name}{k}")
        return ((F.coalesce(f"p{k}", F.lit(0).cast("bigint")) + shifted) % PRIME).alias(f"{name}{k}")

    return joined.select(
        "conv_id",
        (F.coalesce("o", F.lit(0).cast("bigint")) + F.col("pos")).alias("pos"),
        "h1",
        "h2",
        "chars",
        *[whole(n, k) for n in ("w", "v") for k in range(LANES)],
    )


# --- rebuilt prefixes -------------------------------------------------------------------------


def _packed(lanes: list[Column]) -> list[Column]:
    """Two numbers that hold four residues."""
    return [lanes[i] * F.lit(1 << 31) + lanes[i + 1] for i in (0, 2)]


def rebuilt(turns: DataFrame, of: list[int]) -> tuple[DataFrame, DataFrame]:
    """(one row for each rebuilt turn, one row for each conversation with its rebuilt length)."""
    h = head_size(F.col("conv_id"))
    head_row = F.struct("pos", "h1", "h2", "chars", *_lanes("w"), *_lanes("v"))
    own = turns.groupBy("conv_id").agg(
        F.max("pos").alias("n_own"),
        *[F.coalesce(F.max(F.when(F.col("pos") == h, F.col(f"w{k}"))), F.lit(0)).alias(f"own{k}") for k in range(LANES)],
    )
    heads = (
        turns.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") <= MAX_HEAD))
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.sort_array(F.collect_list(head_row)).alias("head"))
    )
    with_base = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % GROUP, "h": h})
    sized = with_base.join(heads, "base", "left").withColumn(
        "m", F.least("h", F.coalesce(F.size("head"), F.lit(0)).cast("bigint"))
    )
    sized = sized.withColumn("m", F.greatest("m", F.lit(0).cast("bigint"))).withColumn(
        "size", F.col("m") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0).cast("bigint"))
    )
    convs = staged(sized.drop("base"), "trie-conversations")

    from_head = convs.where(F.col("m") > 0).select(
        "conv_id", "size", F.explode(F.slice("head", F.lit(1), F.col("m").cast("int"))).alias("t")
    )
    heads_out = from_head.select(
        "conv_id",
        F.col("t.pos").alias("d"),
        *[c.alias(n) for c, n in zip(_packed([F.col(f"t.w{k}") for k in range(LANES)]), "fg")],
        *[c.alias(n) for c, n in zip(_packed([F.col(f"t.v{k}") for k in range(LANES)]), ("pf", "pg"))],
        "t.h1",
        "t.h2",
        "t.chars",
        (F.col("t.pos") == F.col("size")).alias("is_last"),
    )

    def combined(name: str, k: int) -> Column:
        """head(m) + B^(m-h) (own(i) - own(h))"""
        head = F.coalesce(F.get("head", (F.col("m") - 1).cast("int"))[f"w{k}"], F.lit(0).cast("bigint"))
        inverse = pow(of[k], -1, PRIME)
        shifts = F.array(*[F.lit(pow(inverse, e, PRIME)).cast("bigint") for e in range(MAX_HEAD + 1)])
        shift = F.get(shifts, (F.col("h") - F.col("m")).cast("int"))
        return (head + shift * F.pmod(F.col(f"{name}{k}") - F.col(f"own{k}"), F.lit(PRIME))) % PRIME

    suffix = turns.where(F.col("pos") > h).join(convs, "conv_id")
    d = F.col("pos") - F.col("h") + F.col("m")
    suffix_out = suffix.select(
        "conv_id",
        d.alias("d"),
        *[c.alias(n) for c, n in zip(_packed([combined("w", k) for k in range(LANES)]), "fg")],
        *[c.alias(n) for c, n in zip(_packed([combined("v", k) for k in range(LANES)]), ("pf", "pg"))],
        "h1",
        "h2",
        "chars",
        (d == F.col("size")).alias("is_last"),
    )
    return staged(heads_out.unionByName(suffix_out), "trie-prefixes"), convs.select("conv_id", "size")


def grouped(prefixes: DataFrame) -> DataFrame:
    """One row for each (depth, fingerprint), with what its members must agree on."""
    same = ["pf", "pg", "h1", "h2"]
    agree = [F.min(c) == F.max(c) for c in same]
    return prefixes.groupBy(*NODE).agg(
        F.count("*").alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        F.min("pf").alias("pf"),
        F.min("pg").alias("pg"),
        F.min("chars").alias("chars"),
        (agree[0] & agree[1] & agree[2] & agree[3]).alias("agreed"),
    )


# --- the trie ---------------------------------------------------------------------------------


def _hashed_ids(ends: DataFrame) -> DataFrame:
    """(node, sha256 of its conv_ids in order, comma-joined) for rows (node, conv_id)."""
    key = f"{', '.join(f'{c} bigint' for c in NODE)}"
    order = [*NODE, "conv_id"]

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of ids of one node, at most IDS_PER_CHUNK of them in a row."""
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            n = batch.num_rows
            if not n:
                continue
            new = np.ones(n, dtype=bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:3]])
            starts = [s for a, b in _runs(np.flatnonzero(new), n) for s in range(a, b, IDS_PER_CHUNK)]
            text = [",".join(map(str, cols[3][a:b].tolist())) for a, b in _runs(np.array(starts), n)]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c[starts]) for c in cols], pa.array(text, pa.string())], [*order, "ids"]
            )

    def hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            out = []
            keys = zip(*[batch.column(i).to_pylist() for i in range(3)])
            for at, ids in zip(keys, batch.column(4).to_pylist()):
                if at == node:
                    digest.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = at, hashlib.sha256(ids.encode())
            yield _hash_rows(out)
        if node is not None:
            yield _hash_rows([(*node, digest.hexdigest())])

    spread = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = spread.mapInArrow(join_ids, f"{key}, conv_id bigint, ids string")
    # One task hashes a node's ids, in their order: it reads one row for each chunk of them.
    dealt = chunks.repartition(*NODE).sortWithinPartitions(*order)
    return dealt.mapInArrow(hash_ids, f"{key}, ends_sha256 string")


def _runs(starts: np.ndarray, n: int) -> list[tuple[int, int]]:
    return list(zip(starts.tolist(), [*starts[1:].tolist(), n]))


def _hash_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 4
    types = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [*NODE, "ends_sha256"])


def trie(
    conversations: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    first_seed: int = 1,
) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    for seed in range(first_seed, first_seed + ATTEMPTS):
        of = bases(seed)
        turns = referenced(conversations, seed, conv_id, turn, role, text)
        if ambiguous_references(turns):
            continue
        narrow = turns.select(
            "conv_id",
            "turn",
            "role",
            "h1",
            "h2",
            F.length("text").cast("bigint").alias("chars"),
            F.monotonically_increasing_id().alias("row"),
        )
        prefixes, convs = rebuilt(positions(staged(narrow, "trie-turns"), of), of)
        nodes = staged(grouped(prefixes), "trie-nodes")
        if nodes.where(~F.col("agreed")).isEmpty():
            return _rows(prefixes, convs, nodes)
    raise RuntimeError(f"fingerprints collided in {ATTEMPTS} attempts")


def _rows(prefixes: DataFrame, convs: DataFrame, nodes: DataFrame) -> DataFrame:
    whole = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).first()
    spark = prefixes.sparkSession
    children = (
        nodes.where(F.col("d") > 1)
        .groupBy((F.col("d") - 1).alias("d"), F.col("pf").alias("f"), F.col("pg").alias("g"))
        .agg(F.count("*").alias("n_children"))
    )
    zero = F.lit(0).cast("bigint")
    weighed = nodes.join(children, NODE, "left").select(
        *NODE,
        "pf",
        "pg",
        "conv_id",
        "n_convs",
        F.coalesce("n_children", zero).alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("weight"),
    )
    parents = nodes.select(
        (F.col("d") + 1).alias("d"), F.col("f").alias("pf"), F.col("g").alias("pg"), F.col("conv_id").alias("up")
    )
    full = staged(weighed.join(parents, ["d", "pf", "pg"], "left"), "trie-weighed")

    owned = full.groupBy("conv_id").agg(
        F.sum("weight").alias("owned"), F.max((F.col("n_children") == 0).cast("bigint")).alias("leaves")
    )
    below = prefixes.join(owned, "conv_id").groupBy(*NODE).agg(
        F.sum("owned").alias("owned"), F.sum("leaves").alias("n_leaves")
    )
    block = F.floor(F.col("d") / DEPTH_BLOCK)
    along = running(
        full.select(*NODE, "conv_id", "weight"), ["conv_id"], block, ["d"], sums={"so_far": F.col("weight")}
    ).select(*NODE, (F.col("so_far") - F.col("weight")).alias("above"))
    last = prefixes.where("is_last").select(*NODE, "conv_id")
    turnless = convs.where(F.col("size") == 0).select(
        zero.alias("d"), zero.alias("f"), zero.alias("g"), "conv_id"
    )
    ends = staged(_hashed_ids(last.unionByName(turnless)), "trie-ends")

    inner = (
        full.join(below, NODE)
        .join(along, NODE)
        .select(
            *NODE,
            "conv_id",
            F.when(F.col("d") == 1, F.lit(whole["least"])).otherwise(F.col("up")).cast("bigint").alias("parent_conv_id"),
            "n_convs",
            "n_children",
            "n_leaves",
            (F.col("owned") - F.col("above")).alias("saved_tokens"),
        )
    )
    totals = full.agg(
        F.coalesce(F.sum((F.col("d") == 1).cast("bigint")), zero).alias("n_children"),
        F.greatest(F.coalesce(F.sum((F.col("n_children") == 0).cast("bigint")), zero), F.lit(1)).alias("n_leaves"),
        F.coalesce(F.sum("weight"), zero).alias("saved_tokens"),
    )
    root = totals.select(
        *[zero.alias(c) for c in NODE],
        F.lit(whole["least"]).cast("bigint").alias("conv_id"),
        F.lit(None).cast("bigint").alias("parent_conv_id"),
        F.lit(whole["n"]).cast("bigint").alias("n_convs"),
        "n_children",
        "n_leaves",
        "saved_tokens",
    ).where(F.lit(whole["n"]) > 0)
    return (
        inner.unionByName(root)
        .join(ends, NODE, "left")
        .select(
            "conv_id",
            F.col("d").alias("depth"),
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )
