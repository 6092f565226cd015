"""The policy: taught terms (deny) and exceptions (allow), per scope.

Policy rows have the columns of ``POLICY_SCHEMA``.  ``ord`` is the position in the list and
decides label ties.
"""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave.functions.patterns import GLOBAL_SCOPE
from maskweave.functions.spans import settled
from maskweave.functions.text import ascii_lower
from maskweave.operators.ranking import running

POLICY_SCHEMA = (
    "ord bigint, list string, term string, label string, scope string, "
    "aliases array<string>, source string, whole_word boolean"
)
_ENTRY = (
    "struct<term:string,label:string,scope:string,aliases:array<string>,"
    "source:string,whole_word:boolean>"
)
STORE_SCHEMA = f"deny array<{_ENTRY}>, allow array<{_ENTRY}>"
LOG_SCHEMA = (
    "seq bigint, op string, term string, label string, scope string, whole_word boolean"
)


# --- reading -------------------------------------------------------------------------


def policy_from_stores(stores: DataFrame, shard: Column | None = None) -> DataFrame:
    """Policy rows of parsed store documents; missing fields take their defaults.

    A policy too large for one document may be split over several; ``shard`` orders them.
    """
    base = (F.lit(0) if shard is None else shard).cast("bigint") * F.lit(1 << 32)
    both = stores.select(
        base.alias("base"),
        F.explode(
            F.array(
                F.struct(F.lit("deny").alias("list"), F.col("deny").alias("entries")),
                F.struct(F.lit("allow").alias("list"), F.col("allow").alias("entries")),
            )
        ).alias("side"),
    )
    rows = both.select("base", F.col("side.list").alias("list"), F.posexplode("side.entries"))
    return rows.select(
        (F.col("base") + F.col("pos")).cast("bigint").alias("ord"),
        "list",
        F.col("col.term").alias("term"),
        F.col("col.label").alias("label"),
        F.coalesce("col.scope", F.lit(GLOBAL_SCOPE)).alias("scope"),
        F.coalesce("col.aliases", F.array().cast("array<string>")).alias("aliases"),
        F.coalesce("col.source", F.lit("")).alias("source"),
        F.coalesce("col.whole_word", F.lit(False)).alias("whole_word"),
    )


def policy_from_json(docs: DataFrame, column: str, shard: Column | None = None) -> DataFrame:
    """Policy rows of a column of JSON store documents.  An unreadable one is an error: an
    empty policy in its place would protect nothing and say nothing."""
    parsed = docs.withColumn(
        "__store", F.from_json(F.col(column), STORE_SCHEMA, {"mode": "FAILFAST"})
    )
    return policy_from_stores(parsed.selectExpr("*", "__store.deny", "__store.allow"), shard)


# Stored entries come before every event of a log.
_BEFORE_LOG = -(1 << 61)

COMPACT_ROWS = 10_000
COMPACT_ROW_BYTES = 4096


def compact(policy: DataFrame) -> DataFrame:
    """A small policy as local rows, so that each use of it does not derive it again.

    At most ``COMPACT_ROWS`` rows of ``COMPACT_ROW_BYTES`` bytes reach the driver; a policy with
    more rows or a longer one is returned as it is.
    """
    size = F.octet_length(F.to_json(F.struct(*policy.columns)))
    few = (
        policy.withColumn("__fits", size <= COMPACT_ROW_BYTES)
        .select(*[F.when(F.col("__fits"), F.col(c)).alias(c) for c in policy.columns], "__fits")
        .limit(COMPACT_ROWS + 1)
        .toArrow()
    )
    if few.num_rows > COMPACT_ROWS or pc.any(pc.invert(few.column("__fits"))).as_py():
        return policy
    return policy.sparkSession.createDataFrame(few.drop_columns(["__fits"]), policy.schema)


# --- teaching ------------------------------------------------------------------------


def policy_state(log: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Current policy: a stored policy (``base``, none by default) and the teach/unteach log on it.

    Keys compare ASCII-case-insensitively.  A re-teach updates label and matching mode but
    keeps spelling, position, aliases and source; an unteach (of one scope, or of all when its
    scope is null) forgets everything before it.  Stored entries count as taught, in their order,
    before the log began; allow entries stay as they are.
    """
    none = F.array().cast("array<string>")
    events = log.select("seq", "op", "term", "label", "scope", "whole_word").withColumns(
        {"aliases": none, "source": F.lit("user")}
    )
    if base is not None:
        stored = base.where(F.col("list") == "deny")
        events = events.unionByName(
            stored.select(
                (F.col("ord") + F.lit(_BEFORE_LOG)).alias("seq"),
                F.lit("teach").alias("op"),
                "term",
                "label",
                "scope",
                "whole_word",
                F.coalesce("aliases", none).alias("aliases"),
                "source",
            )
        )
    keyed = events.withColumn("kt", ascii_lower("term")).withColumn("ks", ascii_lower("scope"))
    gone = keyed.where(F.col("op") == "unteach")
    gone_all = (
        gone.where(F.col("ks").isNull())
        .groupBy(F.col("kt"))
        .agg(F.max("seq").alias("cut_all"))
    )
    gone_one = (
        gone.where(F.col("ks").isNotNull()).groupBy("kt", "ks").agg(F.max("seq").alias("cut_one"))
    )
    start = F.lit(2 * _BEFORE_LOG)
    live = (
        keyed.where(F.col("op") == "teach")
        .join(gone_all, "kt", "left")
        .join(gone_one, ["kt", "ks"], "left")
        .where(
            F.col("seq") > F.greatest(F.coalesce("cut_all", start), F.coalesce("cut_one", start))
        )
    )
    state = live.groupBy("kt", "ks").agg(
        F.min("seq").alias("ord"),
        F.min_by("term", "seq").alias("term"),
        F.max_by("label", "seq").alias("label"),
        F.min_by("scope", "seq").alias("scope"),
        F.min_by("aliases", "seq").alias("aliases"),
        F.min_by("source", "seq").alias("source"),
        F.max_by("whole_word", "seq").alias("whole_word"),
    ).select(
        "ord",
        F.lit("deny").alias("list"),
        "term",
        "label",
        "scope",
        "aliases",
        "source",
        "whole_word",
    )
    if base is None:
        return state
    return state.unionByName(base.where(F.col("list") == "allow").select(state.columns))


EVENT_BLOCKS = 256


def unteach_effect(log: DataFrame, blocks: int = EVENT_BLOCKS) -> DataFrame:
    """For each unteach event, whether it removed anything.

    An unteach of all scopes closes an epoch of its term: every event of one scope finds the one that
    closes its epoch by a running minimum from the end (an as-of lookup; no event meets more than one).
    Within an epoch, a scope's unteach removed something if it is the first after the last teach
    before it; the closing event did if some scope's last event in the epoch is a teach.

    The order is cut at quantiles of ``seq``, whatever its unit, so that a term with a large share of
    all events is spread over that many blocks.
    """
    keyed = log.withColumn("kt", ascii_lower("term")).withColumn("ks", ascii_lower("scope"))
    cuts = keyed.agg(F.percentile_approx("seq", [i / blocks for i in range(1, blocks)], 10_000)).first()[0]
    bounds = F.array(*[F.lit(b).cast("bigint") for b in sorted(set(cuts or []))])

    def block(seq: Column) -> Column:
        return F.size(F.filter(bounds, lambda b: b <= seq))

    everywhere = (F.col("op") == "unteach") & F.col("ks").isNull()
    events = keyed.select(
        "seq", "op", "kt", "ks", (-F.col("seq")).alias("back"), F.when(everywhere, -F.col("seq")).alias("closes")
    )
    dated = running(events, ["kt"], -block(F.col("seq")), ["back"], maxima={"closed": F.col("closes")})
    scoped = dated.where(F.col("ks").isNotNull()).select(
        "seq",
        "op",
        "kt",
        "ks",
        (-F.col("closed")).alias("epoch"),
        F.when(F.col("op") == "teach", F.col("seq")).alias("taught_at"),
    )
    epoch = ["kt", "ks", "epoch"]
    seen = running(scoped, epoch, block(F.col("seq")), ["seq"], maxima={"last_teach": F.col("taught_at")})
    removed_one = (
        seen.where((F.col("op") == "unteach") & F.col("last_teach").isNotNull())
        .groupBy(*epoch, "last_teach")
        .agg(F.min("seq").alias("seq"))
        .select("seq")
    )
    last = scoped.groupBy(*epoch).agg(F.max_by("op", "seq").alias("op"))
    removed_all = last.where((F.col("op") == "teach") & F.col("epoch").isNotNull()).select(F.col("epoch").alias("seq"))
    effective = removed_one.unionByName(removed_all).distinct().withColumn("changed", F.lit(True))
    return (
        keyed.where(F.col("op") == "unteach")
        .select("seq", "term", "scope")
        .join(effective, "seq", "left")
        .select("seq", "term", "scope", F.coalesce("changed", F.lit(False)).alias("changed"))
    )


# --- lookups -------------------------------------------------------------------------


def hidden_forms(policy: DataFrame) -> DataFrame:
    """Every surface form to hide: each deny term and each of its aliases."""
    rows = policy.where(F.col("list") == "deny").select(
        "ord",
        "label",
        ascii_lower("scope").alias("scope"),
        "whole_word",
        F.posexplode(F.concat(F.array("term"), "aliases")).alias("form_no", "form"),
    )
    return rows.where(F.col("form") != "").withColumn("form_no", F.col("form_no").cast("bigint"))


def distinct_forms(forms: DataFrame, *by: str) -> DataFrame:
    """One form per lower-cased spelling (and per ``by``).

    The longest spelling comes first, then list order, but a form matched anywhere replaces
    one matched at word edges only: it is the stricter protection.
    """
    best = F.min(
        F.struct(
            "whole_word",
            (-F.octet_length("form")).alias("neg_bytes"),
            "ord",
            "form_no",
            "form",
            "label",
        )
    ).alias("best")
    picked = forms.groupBy(*by, F.lower("form").alias("form_key")).agg(best)
    return picked.select(
        *by,
        "form_key",
        F.col("best.form").alias("form"),
        F.col("best.label").alias("label"),
        F.col("best.whole_word").alias("whole_word"),
        F.col("best.ord").alias("ord"),
        F.col("best.form_no").alias("form_no"),
    )


def scope_keys(scope: Column) -> Column:
    """Entry-side keys a request scope may see: itself and global; without a scope, all.

    Turns "entry is global, or equals the request scope, or there is no scope" into an
    equality that Spark can hash, with ``entry_keys`` on the other side.
    """
    named = F.array_distinct(F.array(ascii_lower(scope), F.lit(GLOBAL_SCOPE)))
    return F.when(scope.isNull(), F.array(F.lit("*"))).otherwise(named)


def entry_keys(scope: Column) -> Column:
    return F.array(ascii_lower(scope), F.lit("*"))


def forms_by_request_scope(scopes: DataFrame, forms: DataFrame) -> DataFrame:
    """The forms each request scope sees (``scopes`` has one column, ``request_scope``)."""
    asked = scopes.select("request_scope").distinct().select(
        "request_scope", F.explode(scope_keys(F.col("request_scope"))).alias("__key")
    )
    entries = forms.select("*", F.explode(entry_keys(F.col("scope"))).alias("__key"))
    return distinct_forms(asked.join(entries, "__key").drop("__key"), "request_scope")


def policy_terms(policy: DataFrame) -> DataFrame:
    return policy.where(F.col("list") == "deny").select("ord", "term", "label", "scope")


def policy_version(policy: DataFrame, lanes: int = 5) -> DataFrame:
    """Fingerprint of every match-relevant field of the whole policy, as one row.

    Each row hashes on its own and the hashes are added up in ``lanes`` numbers, so the
    policy is never gathered in one place; ``ord`` is part of the row, so order counts.
    """
    row = F.sha2(
        F.concat_ws(
            "\u0001",
            F.col("list"),
            F.col("ord").cast("string"),
            *[F.coalesce(F.col(c), F.lit("\u0003")) for c in ("term", "label", "scope")],
            F.coalesce(F.array_join("aliases", "\u0002", "\u0003"), F.lit("\u0003")),
            F.col("whole_word").cast("string"),
        ),
        256,
    )
    sums = [
        F.sum(F.conv(F.substring("__h", 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)"))
        for i in range(lanes)
    ]
    text = F.concat_ws(
        "-", F.count("*").cast("string"), *[F.coalesce(s, F.lit(0)).cast("string") for s in sums]
    )
    return policy.select(row.alias("__h")).agg(F.sha2(text, 256).alias("policy_version"))


def allowed_terms(policy: DataFrame) -> DataFrame:
    return policy.where(F.col("list") == "allow").select(
        ascii_lower("term").alias("allowed"), ascii_lower("scope").alias("scope")
    )


def without_allowed(spans: DataFrame, policy: DataFrame, scope: str | None = None) -> DataFrame:
    """Drop spans whose exact text is allowed in the scope of their row."""
    request = F.col(scope) if scope else F.lit(None).cast("string")
    allow = (
        allowed_terms(policy)
        .select("allowed", F.explode(entry_keys(F.col("scope"))).alias("__key"))
        .distinct()
    )
    keyed = spans.withColumn("__keys", scope_keys(request)).withColumn(
        "__value", ascii_lower("value")
    )
    # One equality on (value, key) for each key a request may see: its own, and the global one.
    for n in (0, 1):
        mine = F.get(F.col("__keys"), F.lit(n))
        keyed = keyed.join(
            allow, (F.col("__value") == F.col("allowed")) & (mine == F.col("__key")), "left_anti"
        )
    return keyed.drop("__keys", "__value")


MAX_LITERAL_TERMS = 500
ALLOW_CHUNK_ROWS = 250_000


def _flag_column(sent: Broadcast, values: Column, keys: Column) -> Column:
    @F.pandas_udf("array<boolean>")
    def flag(values: pd.Series, keys: pd.Series) -> pd.Series:
        table = sent.value
        return pd.Series(
            [
                None if vs is None else [any(v in table.get(k, ()) for k in ks) for v in vs]
                for vs, ks in zip(values, keys)
            ]
        )

    return flag(values, keys)


def _allowed_flags(allow: DataFrame, values: Column, keys: Column) -> Column:
    """For each value whether an entry seen under one of the keys allows it.

    The entries reach the tasks in broadcast chunks of about ``ALLOW_CHUNK_ROWS`` rows, one
    Arrow pass each over the values alone.
    """
    context = allow.sparkSession.sparkContext
    rows = allow.distinct()
    chunks = max(1, -(-rows.count() // ALLOW_CHUNK_ROWS))
    slot = F.pmod(F.xxhash64("allowed"), F.lit(chunks))
    flags = []
    for i in range(chunks):
        table: dict[str, set[str]] = {"*": set()}
        for term, entry_scope in rows.where(slot == i).select("allowed", "scope").toLocalIterator():
            table.setdefault(entry_scope, set()).add(term)
            table["*"].add(term)
        flags.append(_flag_column(context.broadcast(table), values, keys))
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x | y), flags)


def drop_allowed(
    df: DataFrame,
    policy: DataFrame,
    key: list[str],
    spans: str = "spans",
    scope: str | None = None,
    max_terms: int = MAX_LITERAL_TERMS,
) -> DataFrame:
    """Remove allowed texts from an array of spans; rows stay where they are.

    A short allow-list travels in the plan, a longer one as broadcast sets.  ``key`` is not
    needed any more.
    """
    allow = allowed_terms(policy)
    head = allow.limit(max_terms + 1).collect()
    request = F.col(scope) if scope else F.lit(None).cast("string")
    if not head:
        return df
    values = F.transform(spans, lambda s: ascii_lower(s["value"]))
    if len(head) <= max_terms:
        by_scope: dict[str, list[str]] = {"*": []}
        for term, entry_scope in head:
            by_scope.setdefault(entry_scope, []).append(term)
            by_scope["*"].append(term)
        table = F.from_json(F.lit(json.dumps(by_scope)), "map<string,array<string>>")
        none = F.array().cast("array<string>")
        terms = F.flatten(
            F.transform(scope_keys(request), lambda k: F.coalesce(F.element_at(table, k), none))
        )
        ready = settled(df, {"__terms": terms})
        flags = F.transform(values, lambda v: F.array_contains(F.col("__terms"), v))
    else:
        ready = df.withColumn("__terms", _allowed_flags(allow, values, scope_keys(request)))
        flags = F.col("__terms")
    kept = F.filter(
        F.zip_with(spans, flags, lambda s, f: F.struct(s.alias("s"), f.alias("f"))), lambda x: ~x["f"]
    )
    left = F.when(F.size(spans) > 0, F.transform(kept, lambda x: x["s"])).otherwise(F.col(spans))
    return settled(ready, {"__left": left}).drop("__terms", spans).withColumnRenamed("__left", spans)


def empty_policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], POLICY_SCHEMA)
