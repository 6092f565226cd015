"""Fail-closed checks on redacted output, scope resolution and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.functions.patterns import GLOBAL_SCOPE, MAX_BODY_BYTES
from maskweave.functions.spans import settled
from maskweave.functions.text import ascii_lower, stripped
from maskweave.operators.dictionary import with_dictionary_spans
from maskweave.operators.policy import drop_allowed, hidden_forms


def malformed(text: Column) -> Column:
    """An opened placeholder with no close anywhere."""
    return F.contains(text, F.lit("<<")) & ~F.contains(text, F.lit(">>"))


def with_residual(
    df: DataFrame,
    policy: DataFrame,
    key: list[str],
    text: str,
    scope: str | None = None,
    out: str = "residual",
) -> DataFrame:
    """Add the number of protected terms still visible in ``text``.

    Only the dictionary is checked: number patterns would trip over timestamps and ids.
    """
    hits = with_dictionary_spans(df, policy, text=text, scope=scope, key=key, out="__res")
    left = drop_allowed(hits, policy, key, spans="__res", scope=scope)
    return settled(left, {out: F.size("__res").cast("bigint")}).drop("__res")


# Joins decoded strings for one check; no form may contain it, and it is no word character.
_BETWEEN = "\u0000"


def audit(
    df: DataFrame,
    policy: DataFrame,
    key: list[str],
    body: str,
    strings: str | None = None,
    scope: str | None = None,
) -> DataFrame:
    """Add ``reason``: null for a clean row, else ``residual_term`` or ``malformed_placeholder``.

    ``body`` is the serialized output and gets both checks.  ``strings`` is an optional array of
    its decoded strings, which get the term check alone: a serializer escapes some characters,
    so a term holding one shows only after decoding.  Rows stay where they are.
    """
    done = with_residual(df, policy, key, body, scope)
    if strings:
        forms = hidden_forms(policy)
        if forms.where(F.contains("form", F.lit(_BETWEEN))).take(1):
            raise ValueError("a taught term must not contain the character U+0000")
        joined = settled(done, {"__joined": F.array_join(strings, _BETWEEN)})
        inner = with_residual(joined, policy, key, "__joined", scope, out="__inner")
        done = inner.withColumn("residual", F.col("residual") + F.col("__inner")).drop(
            "__joined", "__inner"
        )
    reason = F.when(F.col("residual") > 0, "residual_term").when(
        malformed(F.col(body)), "malformed_placeholder"
    )
    return done.withColumn("reason", reason).drop("residual")


CLEAN = "clean"


def with_outcome(audited: DataFrame) -> DataFrame:
    """Add ``outcome``, the reason or ``clean``: both halves in one pass."""
    return audited.withColumn("outcome", F.coalesce("reason", F.lit(CLEAN)))


def split_clean(audited: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean rows, quarantined rows).  Each runs what ``audited`` stands for; where both are read,
    write it first (as ``write_corpus`` does) or use ``with_outcome``."""
    clean = audited.where(F.col("reason").isNull()).drop("reason")
    return clean, audited.where(F.col("reason").isNotNull())


def strict(audited: DataFrame) -> DataFrame:
    """Fail the whole job on the first row that is not clean."""
    ok = F.when(F.col("reason").isNull(), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("output blocked: "), F.col("reason"))).cast("boolean")
    )
    return audited.where(ok).drop("reason")


def oversize(df: DataFrame, body: str, limit: int = MAX_BODY_BYTES) -> DataFrame:
    """Add ``reason`` = ``oversize`` for bodies over the byte limit."""
    return df.withColumn("reason", F.when(F.octet_length(body) > limit, "oversize"))


def blocked_by_reason(quarantine: DataFrame) -> DataFrame:
    return quarantine.where(F.col("reason").isNotNull()).groupBy("reason").agg(
        F.count("*").alias("blocked")
    )


def resolve_scopes(requests: DataFrame, scopes: DataFrame) -> DataFrame:
    """Add ``scope`` and ``reason`` from the token a request presents.

    ``requests`` has ``bearer`` (an Authorization header) and ``api_key``; ``scopes`` has
    (pos, scope, token_hash).  If both name a scope, the last configured one counts.  With no
    scopes configured every request passes without one.
    """
    if not scopes.take(1):
        none = F.lit(None).cast("string")
        return requests.withColumns({"scope": none, "reason": none})
    bearer = F.when(F.col("bearer").startswith("Bearer "), F.substring("bearer", 8, 1 << 30))
    tokens = scopes.groupBy("token_hash").agg(F.max(F.struct("pos", "scope")).alias("hit"))
    by_bearer = tokens.select(F.col("token_hash").alias("__b"), F.col("hit").alias("__bearer_hit"))
    by_key = tokens.select(F.col("token_hash").alias("__k"), F.col("hit").alias("__key_hit"))
    # The scope list is a configuration: Spark broadcasts it, and requests do not move.
    found = requests.join(by_bearer, F.sha2(bearer, 256) == F.col("__b"), "left").join(
        by_key, F.sha2("api_key", 256) == F.col("__k"), "left"
    )
    scope = F.greatest("__bearer_hit", "__key_hit")["scope"]
    return found.select(
        *requests.columns,
        scope.alias("scope"),
        F.when(scope.isNull(), "unauthorized_scope").alias("reason"),
    )


def scope_config_violations(config: DataFrame) -> DataFrame:
    """(entry_no, violation) for every faulty line of a ``scope=token`` configuration.

    ``config`` has (entry_no, entry).  A report names the entry and the scope, never the token.
    """
    at = F.instr("entry", "=")
    parts = config.select(
        "entry_no",
        (at > 0).alias("pair"),
        F.when(at > 0, stripped(F.substring("entry", F.lit(1), at - 1))).alias("scope"),
        F.when(at > 0, stripped(F.substring("entry", at + 1, F.length("entry")))).alias("token"),
    )
    whole = parts.where(F.col("pair") & (F.col("scope") != "") & (F.col("token") != ""))
    named = whole.withColumn("scope_key", ascii_lower("scope"))
    first_scope = named.groupBy("scope_key").agg(F.min("entry_no").alias("first_no"))
    token_key = F.sha2("token", 256)
    first_token = named.groupBy(token_key.alias("token_key")).agg(
        F.min("entry_no").alias("first_no")
    )
    report = [
        parts.where(~F.col("pair")).select("entry_no", F.lit("not scope=token").alias("violation")),
        parts.where(F.col("pair") & ((F.col("scope") == "") | (F.col("token") == ""))).select(
            "entry_no", F.lit("empty part").alias("violation")
        ),
        named.where(F.col("scope_key") == GLOBAL_SCOPE).select(
            "entry_no", F.lit("reserved scope").alias("violation")
        ),
        named.join(first_scope, "scope_key")
        .where(F.col("entry_no") > F.col("first_no"))
        .select("entry_no", F.lit("scope listed twice").alias("violation")),
        named.withColumn("token_key", token_key)
        .join(first_token, "token_key")
        .where(F.col("entry_no") > F.col("first_no"))
        .select("entry_no", F.lit("token shared").alias("violation")),
    ]
    out = report[0]
    for r in report[1:]:
        out = out.unionByName(r)
    return out


def unknown_scopes(policy: DataFrame, scopes: DataFrame) -> DataFrame:
    """Policy rows taught for a scope nobody can present: they would protect nothing."""
    known = scopes.select(ascii_lower("scope").alias("__known")).distinct()
    key = ascii_lower(F.col("scope"))
    return policy.where(key != GLOBAL_SCOPE).join(known, key == F.col("__known"), "left_anti")
