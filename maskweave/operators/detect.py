"""Pattern detectors and the combined detection of one text.

Every function adds an ``array<span>`` column to the row that holds the text: narrow work,
no shuffle, no Python worker.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.functions import patterns as P
from maskweave.functions import spans as S
from maskweave.functions.text import ascii_lower


@dataclass(frozen=True)
class PatternDetector:
    """``worth_trying`` is a cheap SQL test on {t} that never rejects a text the pattern could
    match; ``valid`` is an SQL test on a matched value {v}."""

    label: str
    pattern: str
    worth_trying: str
    valid: str | None = None


_HAS_DIGIT = r"{t} RLIKE '(?U)\\d'"
_DIGITS = "regexp_replace({v}, '[^0-9]', '')"

# In tie order: at the same start and length the earlier detector wins.
EMAIL = PatternDetector("EMAIL", P.EMAIL_LINEAR, "contains({t}, '@')")
CARD = PatternDetector(
    "CARD",
    P.CARD,
    _HAS_DIGIT,
    f"length({_DIGITS}) BETWEEN 13 AND 19 AND luhn_check({_DIGITS})",
)
IP = PatternDetector("IP", P.IP, _HAS_DIGIT)
PHONE = PatternDetector(
    "PHONE", P.PHONE, _HAS_DIGIT, f"length({_DIGITS}) >= 7 AND NOT {{v}} RLIKE '{P.ISO_DATE}'"
)
BUILTIN = (EMAIL, CARD, IP, PHONE)


def with_pattern_spans(
    df: DataFrame,
    detectors: tuple[PatternDetector, ...] = BUILTIN,
    text: str = "text",
    out: str = "pattern_spans",
    validate: bool = True,
) -> DataFrame:
    """Add the unmerged spans of the pattern layer, in detector order."""
    t = f"coalesce(`{text}`, '')"
    tests = {d.worth_trying: f"__try_{i}" for i, d in enumerate(detectors)}
    tried = {name: F.expr(test.replace("{t}", t)) for test, name in tests.items()}
    guarded = S.settled(df, tried)
    hit = {d.label: f"__hit_{d.label}" for d in detectors}
    matches = {
        hit[d.label]: F.expr(
            f"CASE WHEN {tests[d.worth_trying]} "
            f"THEN regexp_extract_all({t}, {S.sql_text(d.pattern)}, 0) "
            "ELSE CAST(array() AS array<string>) END"
        )
        for d in detectors
    }
    found = S.settled(S.settled(guarded, matches), {
        f"__at_{d.label}": S.ranges(S.pieces(t, S.sql_text(d.pattern)), hit[d.label], short=True)
        for d in detectors
    })
    layers = []
    for d in detectors:
        at = f"__at_{d.label}"
        if validate and d.valid is not None:
            at = f"filter({at}, r -> {d.valid.replace('{v}', 'r.value')})"
        layers.append(
            f"transform({at}, r -> struct(r.`start` AS `start`, r.`end` AS `end`, "
            f"{S.sql_text(d.label)} AS label, 'regex' AS source, 0.0D AS score, r.value AS value))"
        )
    done = S.settled(found, {"__layer": F.expr(f"concat({', '.join(layers)})")})
    extra = [*tried, *matches, *[f"__at_{d.label}" for d in detectors]]
    return done.drop(*extra, out).withColumnRenamed("__layer", out)


def with_merged(df: DataFrame, *layers: str, out: str = "spans") -> DataFrame:
    """Concatenate detector layers and resolve their overlaps."""
    joined = S.settled(df, {"__all": F.concat(*[F.col(c) for c in layers])})
    done = S.settled(joined, {"__merged": S.merged("__all")}).drop("__all", *layers)
    return done.withColumnRenamed("__merged", out)


def detect_patterns(
    df: DataFrame,
    detectors: tuple[PatternDetector, ...] = BUILTIN,
    text: str = "text",
    out: str = "spans",
) -> DataFrame:
    """Pattern layer alone, merged."""
    return with_merged(with_pattern_spans(df, detectors, text), "pattern_spans", out=out)


def explode_spans(df: DataFrame, *keep: str, spans: str = "spans") -> DataFrame:
    """One row per span."""
    rows = df.select(*keep, F.explode(spans).alias("__s"))
    return rows.select(
        *keep,
        F.col("__s.start").alias("start"),
        F.col("__s.end").alias("end"),
        F.col("__s.label").alias("label"),
        F.col("__s.source").alias("source"),
        F.col("__s.score").alias("score"),
        F.col("__s.value").alias("value"),
    )


def score_at_least(spans: Column, threshold: float | None, default: float = 0.5) -> Column:
    """Keep spans scoring at least the threshold; one outside [0, 1] is ignored."""
    t = threshold if threshold is not None and 0.0 <= threshold <= 1.0 else default
    return F.filter(spans, lambda s: s["score"] >= F.lit(t))


def redaction_counts(spans: DataFrame) -> DataFrame:
    """Applied spans by upper-cased label."""
    from maskweave.functions.text import ascii_upper

    return spans.groupBy(ascii_upper(F.col("label")).alias("label")).agg(
        F.count("*").alias("redactions")
    )


def same_ascii(a: Column, b: Column) -> Column:
    return ascii_lower(a) == ascii_lower(b)
