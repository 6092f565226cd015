"""Shared pieces of the check SQL (DuckDB dialect): spans, merging, policy, vault."""

from __future__ import annotations

EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
CARD = r"\b(?:\d[ -]?){12,18}\d\b"
IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
PHONE = r"\+?\d[\d\s().-]{6,}\d"

LUHN = (
    "(list_sum(list_transform(range(1, length(d)+1), lambda i: "
    "CASE WHEN i % 2 = 1 THEN substr(reverse(d), i, 1)::BIGINT "
    "WHEN substr(reverse(d), i, 1)::BIGINT > 4 THEN substr(reverse(d), i, 1)::BIGINT*2-9 "
    "ELSE substr(reverse(d), i, 1)::BIGINT*2 END)) % 10 = 0)"
)
VALID = {
    "EMAIL": "true",
    "CARD": f"(length(d) BETWEEN 13 AND 19 AND {LUHN})",
    "IP": "true",
    "PHONE": "(length(d) >= 7 AND NOT regexp_full_match(value, '[0-9]{4}-[0-9]{2}-[0-9]{2}'))",
}
PATTERNS = {"EMAIL": EMAIL, "CARD": CARD, "IP": IP, "PHONE": PHONE}
ORDER = ["EMAIL", "CARD", "IP", "PHONE"]


def located(src: str, key: str, pattern: str) -> str:
    """(key, i, value, s) of every match of a pattern (an SQL expression) in ``text``."""
    return (
        f"SELECT {key}, i, m[i] AS value, "
        "coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)::BIGINT + "
        "coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)::BIGINT AS s "
        f"FROM (SELECT {key}, m, g, unnest(range(1, len(m)+1)) AS i FROM ("
        f"SELECT {key}, regexp_extract_all(text, {pattern}) AS m, "
        f"string_split_regex(text, {pattern}) AS g FROM {src}) WHERE len(m) > 0)"
    )


def regex_raw(src: str, key: str, labels=tuple(ORDER), valid: bool = True) -> str:
    """(key, label, prio, ord, s, e, value, source) of the pattern layer, unmerged."""
    parts = []
    for n, label in enumerate(labels, 1):
        test = VALID[label] if valid else "true"
        parts.append(
            f"SELECT {key}, '{label}' AS label, 1 AS prio, {n * 1000000} + i AS ord, s, "
            f"s + length(value) AS e, value, 'regex' AS source FROM (SELECT *, "
            f"regexp_replace(value, '[^0-9]', '', 'g') AS d FROM "
            f"({located(src, key, repr_sql(PATTERNS[label]))})) WHERE {test}"
        )
    return " UNION ALL ".join(parts)


def repr_sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def merged(raw: str, key: str, prefix: str = "") -> str:
    """CTE chain ending in ``{prefix}spans(key.., label, source, s, e, value)``."""
    on = " AND ".join(f"c.{k.strip()} = r.{k.strip()}" for k in key.split(","))
    return (
        f"{prefix}raw AS ({raw}), "
        f"{prefix}cand AS (SELECT *, row_number() OVER (PARTITION BY {key} "
        f"ORDER BY s, prio, s - e, ord) AS rn FROM {prefix}raw), "
        f"{prefix}walk AS (SELECT {key}, rn, e AS frontier, true AS keep FROM {prefix}cand "
        f"WHERE rn = 1 UNION ALL SELECT {', '.join('c.' + k.strip() for k in key.split(','))}, "
        f"c.rn, CASE WHEN c.s >= r.frontier THEN c.e ELSE r.frontier END, c.s >= r.frontier "
        f"FROM {prefix}walk r JOIN {prefix}cand c ON {on} AND c.rn = r.rn + 1), "
        f"{prefix}spans AS (SELECT {', '.join('c.' + k.strip() for k in key.split(','))}, "
        f"c.label, c.source, c.s, c.e, c.value FROM {prefix}cand c JOIN {prefix}walk r "
        f"ON {on} AND c.rn = r.rn WHERE r.keep)"
    )


def regex_spans(src: str, key: str, labels=tuple(ORDER)) -> str:
    return merged(regex_raw(src, key, labels), key)


# Policy derived from the benchmark passages: words of six or more letters, longest first.
POLICY = """
words AS (
  SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}')) AS w
  FROM benchmark),
ranked AS (
  SELECT item_id, word, row_number() OVER (PARTITION BY item_id ORDER BY length(word) DESC, word)
    AS r, count(*) OVER (PARTITION BY item_id) AS n
  FROM (SELECT item_id, unnest(w) AS word FROM words)),
picked AS (
  SELECT item_id, n,
    max(word) FILTER (r = 1) AS w1, max(word) FILTER (r = 2) AS w2,
    max(word) FILTER (r = n) AS wn, max(word) FILTER (r = n - 1) AS wm
  FROM ranked GROUP BY item_id, n),
policy AS (
  SELECT item_id * 4 AS ord, 'deny' AS list, upper(w1[1]) || w1[2:] AS term,
    CASE item_id % 4 WHEN 0 THEN 'ORG' WHEN 1 THEN 'person' WHEN 2 THEN 'PROJECT' ELSE 'Client' END
      AS label,
    CASE WHEN item_id % 3 = 0 THEN 'global' ELSE 'SRC' || (item_id % 20) END AS scope,
    [w2] AS aliases, item_id % 2 = 1 AS whole_word
  FROM picked WHERE n >= 4
  UNION ALL
  SELECT item_id * 4 + 1, 'deny', wn, 'CODENAME',
    CASE WHEN item_id % 5 = 0 THEN 'Global' ELSE 'src' || ((item_id * 7) % 20) END,
    [], item_id % 3 = 1
  FROM picked WHERE n >= 4
  UNION ALL
  SELECT item_id * 4 + 2, 'allow', upper(wn), '',
    CASE WHEN item_id % 2 = 0 THEN 'global' ELSE 'src' || (item_id % 20) END, [], false
  FROM picked WHERE n >= 4 AND item_id % 8 IN (0, 3))
"""

# Forms seen by each request scope (rs), one per lower-cased spelling, longest first.
FORMS = """
hidden AS (
  SELECT ord, label, lower(scope) AS scope, whole_word, f.no AS form_no, f.form
  FROM (SELECT *, unnest([{'no': 0, 'form': term}]) AS f FROM policy WHERE list = 'deny'
        UNION ALL
        SELECT *, unnest(list_transform(aliases, lambda a, i: {'no': i, 'form': a}))
        FROM policy WHERE list = 'deny' AND len(aliases) > 0)),
asked AS (SELECT DISTINCT source AS rs FROM documents),
forms AS (
  SELECT * FROM (
    SELECT a.rs, h.*, row_number() OVER (PARTITION BY a.rs, lower(form)
      ORDER BY whole_word, strlen(form) DESC, ord, form_no) AS pick
    FROM asked a JOIN hidden h ON h.scope = 'global' OR h.scope = lower(a.rs))
  WHERE pick = 1),
scope_patterns AS (
  SELECT rs, '(?i)(?:' || string_agg(CASE WHEN whole_word THEN '\\b' || form || '\\b' ELSE form END,
    '|' ORDER BY strlen(form) DESC, ord, form_no) || ')' AS pat
  FROM forms GROUP BY rs)
"""


def dictionary_raw(src: str, key: str, scope: str = "source") -> str:
    """Dictionary layer over ``src`` (key, text, scope column)."""
    return (
        f"SELECT {', '.join('x.' + k.strip() for k in key.split(','))}, f.label, 0 AS prio, "
        "x.i AS ord, x.s, x.s + length(x.value) AS e, x.value, 'dictionary' AS source FROM ("
        + located(
            # RE2 knows ASCII word edges only: accented letters become a digit, so that \\b sees
            # a word character there.  No form contains a digit, and lengths stay the same.
            f"(SELECT t.* REPLACE (regexp_replace(t.text, '[À-ɏ]', '0', 'g') AS text), p.pat "
            f"FROM {src} t JOIN scope_patterns p ON p.rs = t.{scope})",
            f"{key}, {scope}",
            "pat",
        )
        + f") x JOIN forms f ON f.rs = x.{scope} AND lower(f.form) = lower(x.value)"
    )
