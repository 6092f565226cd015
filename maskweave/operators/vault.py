"""Placeholders: minting, redacting, restoring, sealing.

A vault belongs to one conversation.  Two forms: per row (the text is the conversation, all
work stays in the row) and per conversation (a narrow table of spans is shuffled, the text
is joined once, by segment).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.functions import spans as S
from maskweave.functions.patterns import PLACEHOLDER
from maskweave.functions.text import ascii_upper, inner_name, placeholder, stripped
from maskweave.operators.ranking import numbered
from maskweave.session import staged

SEGMENTS_PER_BLOCK = 1024

Key = str | list[str]


# A stored vault is partitioned by this column, so that a reader of few conversations reads few files.
VAULT_BUCKET = "bucket"
VAULT_BUCKETS = 64


def vault_bucket(conv: Column) -> Column:
    return F.pmod(F.xxhash64(conv), F.lit(VAULT_BUCKETS)).cast("int")


def _keys(conv: Key) -> list[str]:
    """Columns that name a vault: the conversation, or (request, conversation)."""
    return [conv] if isinstance(conv, str) else list(conv)


# --- one vault per row -----------------------------------------------------------------


_UPPER = "translate(s.label, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


def row_vault(spans: str) -> Column:
    """Distinct values of a row with their number per label, in order of first appearance.

    ``array<struct<value,label,n>>``.  The first label seen for a value stays with it.  Sorting
    finds first appearances and numbers them, so the work grows as n log n.
    """
    by_value = f"sort_array(transform({spans}, (s, i) -> struct(s.value AS value, i AS i, {_UPPER} AS label)))"
    firsts = "filter(z, (x, k) -> k = 0 OR z[k - 1].value <> x.value)"
    by_label = f"sort_array(transform({firsts}, f -> struct(f.label AS label, f.i AS i, f.value AS value)))"
    starts = "transform(y, f -> f.label)"
    begins = (
        f"map_from_arrays(array_distinct({starts}), "
        f"transform(array_distinct({starts}), l -> array_position({starts}, l)))"
    )
    numbered = (
        "transform(y, (f, k) -> struct(f.i AS i, f.value AS value, f.label AS label, "
        "k - b[f.label] + 2L AS n))"
    )
    return F.expr(
        f"""transform(sort_array(flatten(transform(array({by_value}), z ->
          flatten(transform(array({by_label}), y ->
            flatten(transform(array({begins}), b -> {numbered}))))))),
          v -> struct(v.value AS value, v.label AS label, v.n AS n))"""
    )


_CUT = "struct<start:bigint,end:bigint,placeholder:string>"


def row_cuts(by_value: str, names: str) -> Column:
    """Ranges to replace with their placeholder text, in text order.

    ``by_value`` holds (value, start, end) of the spans and ``names`` (value, placeholder) of the
    vault, both sorted by value: they are walked together.
    """
    cut = "struct(x.`start` AS `start`, x.`end` AS `end`, {n}[CAST({at} AS INT)].placeholder AS placeholder)"
    same = S.one(cut.format(n=names, at="acc.st.at"), f"array<{_CUT}>")
    following = S.one(cut.format(n=names, at="acc.st.at + 1"), f"array<{_CUT}>")
    step = f"""CASE WHEN acc.st.at >= 0 AND acc.st.value = x.value
      THEN struct(acc.st AS st, concat(acc.out, {same}) AS out)
      ELSE struct(struct(acc.st.at + 1 AS at, x.value AS value) AS st,
        concat(acc.out, {following}) AS out) END"""
    state = "struct<at:bigint,value:string>"
    fold = S.folded(by_value, "named_struct('at', -1L, 'value', '')", _CUT, step, state, short=True)
    return F.expr(f"sort_array(({fold}).out)")


def restore_map(vault: Column) -> Column:
    """Inner placeholder name to real value, of a per-row vault."""
    return F.map_from_arrays(
        F.transform(vault, lambda v: inner_name(v["label"], v["n"])),
        F.transform(vault, lambda v: v["value"]),
    )


def redact_rows(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Add ``vault`` and ``redacted``; every row is its own conversation."""
    with_vault = S.settled(df, {"vault": row_vault(spans)})
    name = "struct(v.value AS value, concat('<<', v.label, '_', v.n, '>>') AS placeholder)"
    place = "struct(s.value AS value, s.`start` AS `start`, s.`end` AS `end`)"
    sides = S.settled(
        with_vault,
        {
            "__names": F.expr(f"sort_array(transform(vault, v -> {name}))"),
            "__by_value": F.expr(f"sort_array(transform({spans}, s -> {place}))"),
        },
    )
    with_cuts = S.settled(sides, {"__cuts": row_cuts("__by_value", "__names")})
    done = S.settled(with_cuts, {"redacted": S.applied(text, "__cuts")})
    return done.drop("__cuts", "__names", "__by_value")


# --- one vault per conversation ----------------------------------------------------------


def assign_placeholders(
    spans: DataFrame, conv: Key = "conv_id", seg: str = "seg_no"
) -> DataFrame:
    """The vault table: one row per distinct value of a conversation.

    Values are first cut to one row each (combined before the shuffle), then numbered per
    label by first appearance.  Numbering works in blocks of segments, so neither a value
    nor a conversation that holds much of the data lands in one task.
    """
    keys = _keys(conv)
    first = spans.groupBy(*keys, F.col("value").alias("real")).agg(
        F.min(F.struct(F.col(seg).alias("seg"), "start", "label")).alias("first")
    )
    seen = first.select(
        *keys,
        "real",
        ascii_upper("first.label").alias("label"),
        F.col("first.seg").alias("seg"),
        F.col("first.start").alias("start"),
    )
    block = F.floor(F.col("seg") / SEGMENTS_PER_BLOCK)
    ranked = numbered(seen, [*keys, "label"], block, ["seg", "start"])
    return ranked.select(
        *keys,
        "real",
        "label",
        "n",
        placeholder(F.col("label"), F.col("n")).alias("placeholder"),
        inner_name(F.col("label"), F.col("n")).alias("inner"),
    )


def cuts_by_segment(
    spans: DataFrame, vault: DataFrame, conv: Key = "conv_id", seg: str = "seg_no"
) -> DataFrame:
    """Replacement list of each segment that has any, in text order.

    A segment that was sent more than once has each of its ranges once.
    """
    keys = _keys(conv)
    names = vault.select(*keys, F.col("real").alias("value"), "placeholder")
    return (
        spans.select(*keys, seg, "start", "end", "value")
        .join(names, [*keys, "value"])
        .groupBy(*keys, seg)
        .agg(F.sort_array(F.collect_set(F.struct("start", "end", "placeholder"))).alias("cuts"))
    )


def apply_cuts(
    segments: DataFrame, cuts: DataFrame, conv: Key = "conv_id", seg: str = "seg_no"
) -> DataFrame:
    none = F.array().cast("array<struct<start:bigint,end:bigint,placeholder:string>>")
    joined = segments.join(cuts, [*_keys(conv), seg], "left").withColumn("cuts", F.coalesce("cuts", none))
    return S.settled(joined, {"redacted": S.applied("text", "cuts")}).drop("cuts")


def redact_conversations(
    segments: DataFrame, spans: DataFrame, conv: Key = "conv_id", seg: str = "seg_no"
) -> tuple[DataFrame, DataFrame]:
    """(redacted segments, vault).  The narrow tables of spans and placeholders are written
    once, so detection and numbering run once however often they are read; the text itself is
    shuffled once, by segment.

    ``conv`` names the columns of one vault.  Requests that resend a conversation are vaults of
    their own: give (request, conversation) then.
    """
    narrow = staged(spans.select(*_keys(conv), seg, "start", "end", "label", "value"), "spans")
    vault = staged(assign_placeholders(narrow, conv, seg), "vault")
    return apply_cuts(segments, cuts_by_segment(narrow, vault, conv, seg), conv, seg), vault


# --- restoring -----------------------------------------------------------------------------


def tidy_inner(c: Column) -> Column:
    """Trimmed and upper-cased inside of a placeholder: replies may reformat it."""
    return F.upper(stripped(c))


def restored(text: Column, reals: Column) -> Column:
    """Replace each known placeholder by its value (``reals``: inner name to value).

    Unknown ones stay as written, and what was put in is not looked at again.
    """
    gaps = F.split(text, PLACEHOLDER, -1)
    tokens = S.all_matches(text, PLACEHOLDER)
    inners = F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(1))
    values = F.zip_with(
        tokens, inners, lambda t, i: F.coalesce(F.element_at(reals, tidy_inner(i)), t)
    )
    pieces = F.zip_with(gaps, values, lambda g, v: F.concat(g, F.coalesce(v, F.lit(""))))
    return F.when(F.contains(text, F.lit("<<")), F.array_join(pieces, "")).otherwise(text)


def restore_by_join(
    texts: DataFrame,
    vault: DataFrame,
    conv: Key = "conv_id",
    seg: str = "seg_no",
    text: str = "text",
) -> DataFrame:
    """Restore texts from a vault table; the join key always holds the conversation.

    Only the distinct placeholder names of each segment meet the vault, not the text.  A name
    that stands for several values of its vault is left as written: no guess is made.
    """
    keys = _keys(conv)
    names = F.array_distinct(
        F.transform(F.regexp_extract_all(F.col(text), F.lit(PLACEHOLDER), F.lit(1)), tidy_inner)
    )
    asked = texts.select(*keys, seg, F.explode(names).alias("inner")).distinct()
    sure = (
        vault.groupBy(*keys, "inner")
        .agg(F.min("real").alias("real"), F.max("real").alias("__other"))
        .where("real = __other")
        .drop("__other")
    )
    known = (
        asked.join(sure, [*keys, "inner"])
        .groupBy(*keys, seg)
        .agg(F.map_from_entries(F.collect_list(F.struct("inner", "real"))).alias("__reals"))
    )
    none = F.create_map().cast("map<string,string>")
    joined = texts.join(known, [*keys, seg], "left").withColumn(
        "__reals", F.coalesce("__reals", none)
    )
    done = restored(F.col(text), F.col("__reals"))
    return S.settled(joined, {"restored": done}).drop("__reals")


# --- sealing at rest -------------------------------------------------------------------------


def _associated(version: str, *context: str) -> Column:
    # JSON keeps the parts apart, and a null apart from an empty string.
    parts = F.array(F.lit(version), *[F.col(c).cast("string") for c in context])
    return F.to_json(parts)


def seal(
    df: DataFrame, column: str, key: bytes, context: list[str], version: str = "v1"
) -> DataFrame:
    """Encrypt ``column`` with AES-GCM under a fresh nonce per value.

    The version and the ``context`` columns are bound as associated data: a sealed value moved
    to another row does not open.  The key is an argument, never a column of the table.
    """
    sealed = F.call_function(
        "aes_encrypt",
        F.encode(F.col(column), "UTF-8"),
        F.lit(key),
        F.lit("GCM"),
        F.lit("DEFAULT"),
        F.lit(b""),
        _associated(version, *context),
    )
    return df.withColumn(column, sealed)


def unseal(
    df: DataFrame,
    column: str,
    key: bytes,
    context: list[str],
    version: str = "v1",
    strict: bool = True,
) -> DataFrame:
    """Decrypt a sealed column.  A wrong key and a tampered value look the same: an error, or
    null when not ``strict``.  A column that is still plain text passes through."""
    if dict(df.dtypes)[column] == "string":
        return df
    fn = "aes_decrypt" if strict else "try_aes_decrypt"
    plain = F.call_function(
        fn,
        F.col(column),
        F.lit(key),
        F.lit("GCM"),
        F.lit("DEFAULT"),
        _associated(version, *context),
    )
    return df.withColumn(column, F.decode(plain, "UTF-8"))
