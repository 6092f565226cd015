"""Delta scan: detect each distinct text once, reuse stored spans, propose new terms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.functions.patterns import SUGGESTION_LIMIT
from maskweave.functions.text import ascii_lower, segment_hash
from maskweave.operators.policy import allowed_terms, entry_keys, hidden_forms, scope_keys
from maskweave.operators.ranking import running
from maskweave.session import staged

CACHE_SCHEMA = (
    "seg_hash string, policy_version string, "
    "spans array<struct<start:bigint,end:bigint,label:string>>"
)


def with_hash(df: DataFrame, text: str = "text", scope: str | None = None) -> DataFrame:
    """Add ``seg_hash``; a null text hashes like an empty one."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn("seg_hash", segment_hash(whole, F.col(scope) if scope else None))


def cache_rows(detected: DataFrame, policy_version: str | Column) -> DataFrame:
    """Cache rows hold offsets and labels only, never any text."""
    version = F.lit(policy_version) if isinstance(policy_version, str) else policy_version
    bare = F.transform(
        "spans",
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")),
    )
    return detected.select("seg_hash", version.alias("policy_version"), bare.alias("spans"))


def delta_scan(
    segments: DataFrame,
    cache: DataFrame,
    policy_version: str,
    detect: Callable[[DataFrame], DataFrame],
    carry: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """(segments with cached-or-new spans, new cache rows).

    ``segments`` carries ``seg_hash``; the columns of ``carry``, which the hash must cover (such as the
    scope of ``with_hash``), reach ``detect`` beside ``seg_hash`` and ``text``.  Segments meet the cache
    first; only the texts it does not have under this policy version are cut to one for each hash and
    detected, and where it has them all nothing is.  Both joins have a side with one row for each
    hash, so a text that makes up much of the data is split by Spark's skew handling.
    """
    known = cache.where(F.col("policy_version") == policy_version).dropDuplicates(["seg_hash"])
    looked_up = segments.join(known.select("seg_hash", F.col("spans").alias("__known")), "seg_hash", "left")
    missing = looked_up.where(F.col("__known").isNull())
    hit = F.col("__known").isNotNull().alias("hit")
    if missing.isEmpty():
        nothing = segments.sparkSession.createDataFrame([], CACHE_SCHEMA)
        return looked_up.select(*segments.columns, F.col("__known").alias("spans"), hit), nothing
    fresh = missing.groupBy("seg_hash").agg(
        F.coalesce(F.any_value("text"), F.lit("")).alias("text"), *[F.any_value(c).alias(c) for c in carry]
    )
    # Written once: whoever stores the cache rows does not detect again.
    new_rows = staged(cache_rows(detect(fresh), policy_version), "new-spans")
    found = new_rows.select("seg_hash", F.col("spans").alias("__new"))
    both = looked_up.join(found, "seg_hash", "left")
    return both.select(*segments.columns, F.coalesce("__known", "__new").alias("spans"), hit), new_rows


def first_seen(segments: DataFrame, order: list[str]) -> DataFrame:
    """The first position of every distinct text."""
    return segments.groupBy("seg_hash").agg(F.min(F.struct(*order)).alias("first"))


def lookups(segments: DataFrame) -> DataFrame:
    """Cache lookups of one pass over ``segments``: each distinct text misses once."""
    by_hash = segments.groupBy("seg_hash").agg(F.count("*").alias("n"))
    return by_hash.agg(
        F.sum("n").alias("lookups"),
        F.sum(F.col("n") - 1).alias("hits"),
        F.count("*").alias("misses"),
    )


def resent_history(
    segments: DataFrame, conv: str = "conv_id", turn: str = "turn", block_size: int = 4096
) -> DataFrame:
    """Work of request *k* of a conversation, which resends turns 0..k.

    Only turn *k* can be new: the rest went out with request *k - 1*.  So segment and character
    counts are running sums and no (request, turn) pairs are built.
    """
    order = [conv, turn]
    firsts = first_seen(segments, order).select(
        F.col(f"first.{conv}").alias(conv), F.col(f"first.{turn}").alias(turn), F.lit(1).alias("new")
    )
    sized = segments.select(conv, turn, F.length("text").cast("bigint").alias("chars"))
    sums = running(
        sized.join(firsts, [conv, turn], "left"),
        [conv],
        F.floor(F.col(turn) / block_size),
        [turn],
        sums={"segments": F.lit(1).cast("bigint"), "chars_sent": F.col("chars")},
    )
    miss = F.coalesce("new", F.lit(0)).cast("bigint")
    return sums.select(
        conv,
        turn,
        "segments",
        (F.col("segments") - miss).alias("hits"),
        miss.alias("misses"),
        "chars_sent",
        (miss * F.col("chars")).alias("chars_scanned"),
    )


def suggestions(
    spans: DataFrame,
    policy: DataFrame,
    scope: str | None = None,
    order: tuple[str, ...] = ("seg_no",),
    limit: int = SUGGESTION_LIMIT,
) -> DataFrame:
    """(scope, term, last_seen): candidates to teach, the ``limit`` most recent ones.

    ``spans`` has ``seg_hash``, the order columns, ``start``, ``source`` and ``value``.
    Copies of a text count at its first place only, since a cached text is not scanned again.
    """
    request = F.col(scope) if scope else F.lit(None).cast("string")
    found = spans.where(F.col("source") != "dictionary").withColumn("__scope", request)
    # First place of the text, then last sighting over all texts; both combine early.
    by_text = found.groupBy("__scope", "seg_hash", "value").agg(
        F.min(F.struct(*order)).alias("place"), F.max("start").alias("start")
    )
    seen = by_text.groupBy("__scope", "value").agg(
        F.max(F.struct("place", "start")).alias("last_seen")
    )
    known_forms = (
        hidden_forms(policy)
        .select(F.lower("form").alias("__known"), F.explode(entry_keys(F.col("scope"))).alias("__key"))
        .distinct()
    )
    allow = (
        allowed_terms(policy)
        .select("allowed", F.explode(entry_keys(F.col("scope"))).alias("__key"))
        .distinct()
    )
    keyed = seen.withColumn("__keys", scope_keys(F.col("__scope")))
    # One equality on (value, key) for each key a request may see: its own, and the global one.
    new = keyed
    for n in (0, 1):
        mine = F.get(F.col("__keys"), F.lit(n))
        new = new.join(
            known_forms, (F.lower("value") == F.col("__known")) & (mine == F.col("__key")), "left_anti"
        ).join(
            allow,
            (ascii_lower(F.col("value")) == F.col("allowed")) & (mine == F.col("__key")),
            "left_anti",
        )
    return (
        new.orderBy(F.col("last_seen").desc(), F.col("__scope"), F.col("value"))
        .limit(limit)
        .select(F.col("__scope").alias("scope"), F.col("value").alias("term"), "last_seen")
    )


def suggestions_over_scopes(queue: DataFrame) -> DataFrame:
    """One row per term across scopes, at its oldest place in the queue."""
    return queue.groupBy("term").agg(F.min("last_seen").alias("last_seen"))


def suggestions_of(queue: DataFrame, scope: str | None) -> DataFrame:
    """The queue of exactly one scope (case-sensitive; None: traffic without a scope)."""
    return queue.where(F.col("scope").eqNullSafe(F.lit(scope)))
