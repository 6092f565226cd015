"""Personal data by weak supervision, in DataFrame and SQL functions only.

Base spans (e-mail, IP, card, phone) are fixed patterns with fixed checks and always stay.  More
candidates come from matches that fail a base check, from values assigned to secret-like names and
from phone numbers without a country code.  Five labelers vote for, against or not at all on every
candidate: the pattern's own check, plausibility, a gazetteer, the words before it and its edges.
Expectation-maximisation over the counts of vote patterns (a table whose size does not depend on
the data) estimates how reliable each labeler is; its posteriors train a final log-linear
classifier on votes, kind and length, and candidates it finds more likely than not become spans.

Positions are code points, end exclusive.  Everything happens in the row that holds the text; the
only shuffle is that of the pattern counts.

Defined results: a null text counts as empty and has no span; without candidates the classifier
adds nothing; texts of any length are searched whole in linear time (no pattern backtracks over a
run twice or recurses); rows are independent, so repeated rows repeat; extra columns pass through
``with_spans`` and ``redacted``; a clashing ``out`` column is replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.functions import spans as S
from maskweave.llm.common import unused
from maskweave.session import staged

# The possessive marks and \G keep the scans linear; they find what the plain patterns find:
# a match can only begin where a run of its first class begins or the last match ended.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[ -]?[0-9])++"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_SECRET = (
    r"(?i)(?:password|passwd|passphrase|secret|token|api[_-]?key|access[_-]?key)"
    r"[\"']?[ \t]{0,4}[=:][ \t]{0,4}[\"']?[^\s\"']{6,}+"
)
_SECRET_NAME = r"(?i)^[a-z_-]+[\"']?[ \t]{0,4}[=:][ \t]{0,4}[\"']?"
_LOCAL_PHONE = (
    r"(?<![0-9A-Za-z.+()/-])(?<![0-9)] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"
)

_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_DIGITS = "regexp_replace({v}, '[^0-9]', '')"

# Kind: (pattern, cheap test that never rejects a text with a match, check of a match).
BASE = {
    "email": (_EMAIL, "contains({t}, '@')", "true"),
    "ip": (_IP, "contains({t}, '.')", f"{{v}} RLIKE '^{_PART}(?:[.]{_PART}){{3}}$'"),
    "card": (_CARD, "true", f"length({_DIGITS}) BETWEEN 12 AND 19 AND luhn_check({_DIGITS})"),
    "phone": (_PHONE, "contains({t}, '+')", f"length({_DIGITS}) BETWEEN 9 AND 15"),
}
EXTRA = {
    "secret": (_SECRET, "({t} RLIKE '[=:]')"),
    "local": (_LOCAL_PHONE, "true"),
}
# Order of kinds among spans that start together, and the kind a candidate is reported as.
ORDER = ["email", "ip", "card", "phone", "secret"]
REPORTED = {"local": "phone"}

# Gazetteer, fixed values: top-level domains, country codes, card issuers' first digits and
# first characters of well-known keys.
_DOMAINS = "com|org|net|edu|gov|info|io|co|uk|de|fr|es|it|nl|eu|us|ca|ch|at|be"
_COUNTRY = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
_ISSUER = "3[0-9]|4|5[0-9]|6[0-9]|2[2-7]"
_KEY_STARTS = "AKIA|ghp_|sk-|xox|eyJ"
# Words that announce a kind, or speak against personal data.
_BEFORE = {
    "email": "mail|contact|write to|reach",
    "ip": "ip|host|server|address|addr",
    "card": "card|visa|credit|pay",
    "phone": "phone|tel|call|fax|mobile|cell",
    "secret": "password|passwd|secret|token|key",
}
_AGAINST = "version|isbn|order|invoice|page|issue|ticket|no[.]|#"
_CONTEXT_CHARS = 24

LABELERS = ["v_check", "v_plausible", "v_gazetteer", "v_context", "v_edges"]
EM_ROUNDS = 8
ACCEPT = 0.5


def _sql(s: str) -> str:
    return S.sql_text(s)


def _matches(text: str, pattern: str, guard: str) -> str:
    return (
        f"CASE WHEN {guard.replace('{t}', text)} THEN regexp_extract_all({text}, {_sql(pattern)}, 0) "
        "ELSE CAST(array() AS array<string>) END"
    )


def _votes(kind: str) -> dict[str, str]:
    """SQL of each labeler's vote on a candidate (value v, text before b, after a, check passed ok)."""
    name = REPORTED.get(kind, kind)
    plausible = {
        "email": "CASE WHEN v RLIKE '[A-Za-z]' AND length(v) <= 254 THEN 1 ELSE -1 END",
        "ip": "CASE WHEN v RLIKE '^(?:0+|127|255)[.]' THEN -1 ELSE 1 END",
        "card": f"CASE WHEN length({_DIGITS.replace('{v}', 'v')}) BETWEEN 13 AND 16 THEN 1 "
        f"WHEN length({_DIGITS.replace('{v}', 'v')}) BETWEEN 12 AND 19 THEN 0 ELSE -1 END",
        "phone": f"CASE WHEN length({_DIGITS.replace('{v}', 'v')}) BETWEEN 7 AND 15 THEN 1 ELSE -1 END",
        "secret": "CASE WHEN v RLIKE '[0-9]' AND v RLIKE '[A-Za-z]' THEN 1 ELSE -1 END",
    }[name]
    gazetteer = {
        "email": f"CASE WHEN v RLIKE '(?i)[.](?:{_DOMAINS})$' THEN 1 ELSE 0 END",
        "ip": "0",
        "card": f"CASE WHEN v RLIKE '^(?:{_ISSUER})' THEN 1 ELSE -1 END",
        "phone": f"CASE WHEN v RLIKE '^[+](?:{_COUNTRY})' THEN 1 WHEN v LIKE '+%' THEN -1 ELSE 0 END",
        "secret": f"CASE WHEN v RLIKE '^(?:{_KEY_STARTS})' THEN 1 ELSE 0 END",
    }[name]
    check = {"secret": "0", "local": "0"}.get(kind, "CASE WHEN ok THEN 1 ELSE -1 END")
    return {
        "v_check": check,
        "v_plausible": plausible,
        "v_gazetteer": gazetteer,
        "v_context": f"CASE WHEN b RLIKE '(?i)(?:{_BEFORE[name]})' THEN 1 "
        f"WHEN b RLIKE '(?i)(?:{_AGAINST})' THEN -1 ELSE 0 END",
        "v_edges": "CASE WHEN b RLIKE '[0-9A-Za-z]$' OR a RLIKE '^[0-9A-Za-z]' THEN -1 ELSE 1 END",
    }


def _candidates(kind: str, hits: str, found: str, gaps: str) -> str:
    """SQL array of candidates of one kind, with the votes on each."""
    check = BASE[kind][2] if kind in BASE else "false"
    value, start = "r.value", "r.`start`"
    if kind == "secret":
        name = f"regexp_extract(r.value, {_sql(_SECRET_NAME)}, 0)"
        start, value = f"r.`start` + length({name})", f"substring(r.value, length({name}) + 1)"
    votes = ", ".join(f"CAST({sql} AS INT) AS {v}" for v, sql in _votes(kind).items())
    reported = REPORTED.get(kind, kind)
    return f"""transform(zip_with({found}, sequence(0, size({hits}) - 1), (r, i) -> struct(
        {start} AS s, r.`end` AS e, {value} AS v, {check.replace('{v}', 'r.value')} AS ok,
        right({gaps}[i], {_CONTEXT_CHARS}) AS b, left({gaps}[i + 1], 1) AS a)),
      c -> struct(c.s AS s, {ORDER.index(reported)} AS rank, c.e AS e, '{kind}' AS kind,
        '{reported}' AS name, {'c.ok' if kind in BASE else 'false'} AS base,
        least(7, CAST(log2(c.e - c.s + 1) AS INT)) AS size,
        {votes.replace(' v ', ' c.v ').replace('(v ', '(c.v ').replace('(v,', '(c.v,')
              .replace('(v)', '(c.v)').replace(' b ', ' c.b ').replace(' a ', ' c.a ')
              .replace('WHEN ok', 'WHEN c.ok')}))"""


CANDIDATE_TYPE = (
    "struct<s:bigint,rank:int,e:bigint,kind:string,name:string,base:boolean,size:int,"
    + ",".join(f"{v}:int" for v in LABELERS)
    + ">"
)


def with_candidates(df: DataFrame, text: str = "text", out: str = "candidates") -> DataFrame:
    """Add ``out``, every base span and every further candidate with its votes, in order."""
    t, rest = unused(df, "__pii_text"), [c for c in df.columns if c != out]
    kinds = {**{k: v[:2] for k, v in BASE.items()}, **EXTRA}
    rows = S.settled(df.select(*rest), {t: F.coalesce(F.col(text), F.lit(""))})
    hit = {k: unused(df, f"__hit_{k}") for k in kinds}
    rows = S.settled(rows, {hit[k]: F.expr(_matches(f"`{t}`", *v)) for k, v in kinds.items()})
    gap = {k: unused(df, f"__gap_{k}") for k in kinds}
    # The text around the matches is only cut out where there is a match.
    rows = S.settled(
        rows,
        {
            gap[k]: F.expr(
                f"CASE WHEN size({hit[k]}) > 0 THEN split(`{t}`, {_sql(pattern)}, -1) END"
            )
            for k, (pattern, _) in kinds.items()
        },
    )
    at = {k: unused(df, f"__at_{k}") for k in kinds}
    rows = S.settled(rows, {at[k]: S.ranges(gap[k], hit[k]) for k in kinds})
    parts = [
        f"CASE WHEN size({hit[k]}) > 0 THEN CAST({_candidates(k, hit[k], at[k], gap[k])} AS "
        f"array<{CANDIDATE_TYPE}>) ELSE CAST(array() AS array<{CANDIDATE_TYPE}>) END"
        for k in kinds
    ]
    # Digit runs too short or too long for a card are no candidates at all.
    worth = "c.kind <> 'card' OR c.base OR c.size BETWEEN 3 AND 4"
    done = S.settled(rows, {out: F.expr(f"array_sort(filter(concat({', '.join(parts)}), c -> {worth}))")})
    return done.drop(t, *hit.values(), *gap.values(), *at.values())


def vote_patterns(candidates: DataFrame, column: str = "candidates") -> DataFrame:
    """Counts of (kind, size, votes): at most 6 x 8 x 3^5 rows, whatever the input."""
    rows = candidates.select(F.inline(column))
    return rows.groupBy("kind", "size", *LABELERS).agg(F.count("*").alias("n"))


def _vote_log(kept: dict, label: int) -> Column:
    """Sum of log P(vote | label) over the labelers, as an expression over the vote columns."""
    terms = []
    for v in LABELERS:
        p = kept[v][label]
        terms.append(
            F.when(F.col(v) > 0, p[1]).when(F.col(v) < 0, p[-1]).otherwise(p[0])
        )
    return reduce(lambda a, b: a + b, terms)


def _logs(counts: dict[int, float]) -> dict[int, float]:
    total = sum(counts.values()) + 3.0
    return {vote: math.log((n + 1.0) / total) for vote, n in counts.items()}


def fit(candidates: DataFrame, column: str = "candidates") -> dict:
    """Weights of the final classifier, learned without labels from all candidates' votes.

    A candidate starts as true in proportion to its votes; each round re-estimates every
    labeler's habits given true and false and then the posteriors.  The last posteriors give the
    classifier its log odds for each vote of each labeler, each kind and each length class.
    """
    patterns = staged(vote_patterns(candidates, column).coalesce(1), "vote-patterns")
    share = sum((F.col(v) for v in LABELERS), F.lit(0)) / F.lit(len(LABELERS))
    posterior = F.least(F.greatest(0.5 + 0.45 * share, F.lit(0.05)), F.lit(0.95))
    weights: dict = {}
    for _ in range(EM_ROUNDS):
        rows = patterns.withColumn("p", posterior)
        sums = []
        for label, mass in ((1, F.col("p")), (0, 1 - F.col("p"))):
            sums.append(F.sum(mass * F.col("n")).alias(f"all_{label}"))
            for v in LABELERS:
                for vote in (-1, 0, 1):
                    is_vote = F.signum(F.col(v)) == vote
                    sums.append(F.sum(F.when(is_vote, mass * F.col("n")).otherwise(0.0)).alias(f"{v}_{label}_{vote}"))
        s = rows.agg(*sums).first()
        if s["all_1"] is None:  # no candidate anywhere
            return {"votes": {}, "kind": {}, "size": {}, "prior": 0.0}
        kept = {
            v: {y: _logs({vote: s[f"{v}_{y}_{vote}"] for vote in (-1, 0, 1)}) for y in (0, 1)}
            for v in LABELERS
        }
        prior = math.log((s["all_1"] + 1.0) / (s["all_0"] + 1.0))
        odds = F.lit(prior) + _vote_log(kept, 1) - _vote_log(kept, 0)
        posterior = 1.0 / (1.0 + F.exp(-F.least(F.greatest(odds, F.lit(-30.0)), F.lit(30.0))))
        weights = {"prior": prior, "votes": {v: {x: kept[v][1][x] - kept[v][0][x] for x in (-1, 0, 1)} for v in LABELERS}}
    rows = patterns.withColumn("p", posterior)
    for name in ("kind", "size"):
        found = rows.groupBy(name).agg(
            F.sum(F.col("p") * F.col("n")).alias("yes"), F.sum((1 - F.col("p")) * F.col("n")).alias("no")
        )
        weights[name] = {
            r[name]: math.log((r["yes"] + 1.0) / (r["no"] + 1.0)) - weights["prior"] for r in found.collect()
        }
    return weights


def _odds(weights: dict, c: str) -> str:
    """SQL of the classifier's log odds for candidate ``c``."""

    def cases(column: str, table: dict) -> str:
        whens = " ".join(
            f"WHEN {_sql(k) if isinstance(k, str) else k} THEN {float(w)!r}D" for k, w in sorted(table.items())
        )
        return f"CASE {c}.{column} {whens} ELSE 0.0D END" if whens else "0.0D"

    terms = [f"{float(weights['prior'])!r}D"]
    terms += [cases(v, weights["votes"].get(v, {})) for v in LABELERS]
    # Kind and length overlap with the votes, so they count half.
    terms += [f"0.5D * {cases(name, weights[name])}" for name in ("kind", "size")]
    return " + ".join(f"({x})" for x in terms)


def accepted(candidates: Column | str, weights: dict) -> Column:
    """Base spans and the candidates the classifier believes."""
    line = math.log(ACCEPT / (1.0 - ACCEPT))
    return F.expr(f"filter({candidates}, c -> c.base OR ({_odds(weights, 'c')}) > {line!r}D)")


def with_spans(df: DataFrame, weights: dict, text: str = "text", out: str = "spans") -> DataFrame:
    """Add ``out``, array of (start, end, kind, base) in order of start, then kind."""
    c = unused(df, "__candidates")
    rows = with_candidates(df.drop(out) if out != text else df, text, c)
    span = "c -> struct(c.s AS `start`, c.e AS `end`, c.name AS kind, c.base AS base)"
    kept = S.settled(rows, {unused(df, "__kept"): accepted(c, weights)}).drop(c)
    name = unused(df, "__kept")
    return S.settled(kept, {out: F.expr(f"transform({name}, {span})")}).drop(name)


def redacted(df: DataFrame, weights: dict, text: str = "text") -> DataFrame:
    """``df`` with every span of ``text`` replaced by [EMAIL], [IP], [CARD], [PHONE] or [SECRET].

    Overlapping spans become one, named after the first, so nothing of them stays.
    """
    spans, cuts, t = (unused(df, x) for x in ("__spans", "__cuts", "__clean"))
    rows = with_spans(df, weights, text, spans)
    cut = "struct<start:bigint,end:bigint,placeholder:string>"
    new = "struct(x.`start` AS `start`, x.`end` AS `end`, concat('[', upper(x.kind), ']') AS placeholder)"
    step = f"""CASE WHEN acc.st.`end` IS NOT NULL AND x.`start` < acc.st.`end`
      THEN struct(struct(acc.st.`start` AS `start`, greatest(acc.st.`end`, x.`end`) AS `end`,
        acc.st.placeholder AS placeholder) AS st, acc.out AS out)
      ELSE struct({new} AS st, CASE WHEN acc.st.`end` IS NULL THEN acc.out
        ELSE concat(acc.out, {S.one("acc.st", f"array<{cut}>")}) END AS out) END"""
    fold = S.folded("z", "NULL", cut, step, cut)
    joined = F.expr(
        f"CASE WHEN size({spans}) > 0 THEN flatten(transform(transform(array({spans}), z -> {fold}), "
        f"f -> concat(f.out, array(f.st)))) ELSE CAST(array() AS array<{cut}>) END"
    )
    rows = S.settled(rows, {cuts: joined})
    rows = S.settled(rows, {t: S.applied(f"`{text}`", cuts)})
    return rows.select(*[F.col(t).alias(c) if c == text else F.col(c) for c in df.columns])


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, hash of the base spans, all spans."""
    found = staged(with_candidates(docs.select("doc_id", "text")).drop("text"), "pii-candidates")
    weights = fit(found)
    form = "c -> concat(c.name, ':', c.s, ':', c.e)"
    base = "filter(candidates, c -> c.base)"
    rows = S.settled(found, {"__kept": accepted("candidates", weights)})
    return rows.select(
        "doc_id",
        *[
            F.expr(f"CAST(size(filter(candidates, c -> c.base AND c.name = '{k}')) AS BIGINT)").alias(f"n_{k}")
            for k in BASE
        ],
        F.expr(f"sha2(array_join(transform({base}, {form}), ','), 256)").alias("base_sha256"),
        F.expr(f"array_join(transform(__kept, {form}), ',')").alias("spans"),
    )
