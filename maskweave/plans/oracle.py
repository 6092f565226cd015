"""Check SQL (DuckDB dialect) for the registered queries, written independently of them."""

from __future__ import annotations

from maskweave.plans.inputs import NESTING
from maskweave.plans.oracle_parts import (
    FORMS, ORDER, POLICY, dictionary_raw, located, merged, regex_raw, regex_spans,
    repr_sql,
)

SPAN = 's AS start, e AS "end", label, value'

# Conversation turns without a scope: every form applies.
ALL_FORMS = """
hidden AS (
  SELECT ord, label, lower(scope) AS scope, whole_word, f.no AS form_no, f.form
  FROM (SELECT *, unnest([{'no': 0, 'form': term}]) AS f FROM policy WHERE list = 'deny'
        UNION ALL
        SELECT *, unnest(list_transform(aliases, lambda a, i: {'no': i, 'form': a}))
        FROM policy WHERE list = 'deny' AND len(aliases) > 0)),
forms AS (
  SELECT '*' AS rs, * FROM (
    SELECT h.*, row_number() OVER (PARTITION BY lower(form)
      ORDER BY whole_word, strlen(form) DESC, ord, form_no) AS pick
    FROM hidden h) WHERE pick = 1),
scope_patterns AS (
  SELECT rs, '(?i)(?:' || string_agg(CASE WHEN whole_word THEN '\\b' || form || '\\b' ELSE form END,
    '|' ORDER BY strlen(form) DESC, ord, form_no) || ')' AS pat
  FROM forms GROUP BY rs)
"""

TURNS = "turns AS (SELECT conv_id, turn AS seg_no, text, '*' AS source FROM conversations)"
TKEY = "conv_id, seg_no"

DOC_SPANS = f"{POLICY}, {FORMS}, " + merged(
    dictionary_raw("documents", "doc_id") + " UNION ALL " + regex_raw("documents", "doc_id"),
    "doc_id",
)
TURN_SPANS = f"{POLICY}, {ALL_FORMS}, {TURNS}, " + merged(
    dictionary_raw("turns", TKEY) + " UNION ALL " + regex_raw("turns", TKEY), TKEY
)
ALLOWED = """
allowed AS (SELECT lower(term) AS term, lower(scope) AS scope FROM policy WHERE list = 'allow'),
kept AS (
  SELECT s.*, d.source AS scope FROM spans s JOIN documents d USING (doc_id)
  WHERE NOT EXISTS (SELECT 1 FROM allowed a WHERE a.term = lower(s.value)
    AND (a.scope = 'global' OR a.scope = lower(d.source))))
"""
ALLOWED_ANY = """
allowed AS (SELECT lower(term) AS term FROM policy WHERE list = 'allow'),
kept AS (SELECT * FROM spans s WHERE lower(s.value) NOT IN (SELECT term FROM allowed))
"""
VAULT = f"""{ALLOWED_ANY},
firsts AS (
  SELECT conv_id, value AS real, arg_min(upper(label), seg_no * 1000000000 + s) AS label,
    min(seg_no * 1000000000 + s) AS pos
  FROM kept GROUP BY ALL),
vault AS (
  SELECT conv_id, real, label, row_number() OVER (PARTITION BY conv_id, label ORDER BY pos) AS n
  FROM firsts),
named AS (
  SELECT *, '<<' || label || '_' || n || '>>' AS placeholder, label || '_' || n AS inner_name
  FROM vault)
"""


def _pieces(spans: str, texts: str, key: str) -> str:
    """``red`` CTE: text with each span of ``spans`` (key, s, e, placeholder) replaced."""
    keys = [k.strip() for k in key.split(",")]
    on = " AND ".join(f"t.{k} = p.{k}" for k in keys)
    return f"""
    cut AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY {key} ORDER BY s), 0) AS prev
            FROM {spans}),
    head AS (
      SELECT {', '.join('t.' + k for k in keys)},
        string_agg(substr(t.text, prev + 1, s - prev) || placeholder, '' ORDER BY s) AS front,
        max(e) AS upto
      FROM cut p JOIN {texts} t ON {on} GROUP BY ALL),
    red AS (
      SELECT {', '.join('t.' + k for k in keys)}, t.text,
        coalesce(p.front, '') || substr(t.text, coalesce(p.upto, 0) + 1) AS redacted
      FROM {texts} t LEFT JOIN head p ON {on})
    """


TURN_RED = f"""{TURN_SPANS}, {VAULT},
placed AS (SELECT s.conv_id, s.seg_no, s.s, s.e, n.placeholder
           FROM kept s JOIN named n ON n.conv_id = s.conv_id AND n.real = s.value),
{_pieces('placed', 'turns', TKEY)}"""

# One vault per document.
ROW_VAULT = """
firsts AS (
  SELECT doc_id, value AS real, arg_min(upper(label), s) AS label, min(s) AS pos
  FROM {kept} GROUP BY ALL),
named AS (
  SELECT *, '<<' || label || '_' || row_number() OVER (PARTITION BY doc_id, label ORDER BY pos)
    || '>>' AS placeholder FROM firsts),
placed AS (SELECT s.doc_id, s.s, s.e, n.placeholder
           FROM {kept} s JOIN named n ON n.doc_id = s.doc_id AND n.real = s.value)
"""
DOC_RED = f"{DOC_SPANS}, {ALLOWED}, {ROW_VAULT.format(kept='kept')}, {_pieces('placed', 'documents', 'doc_id')}"

REGEX_RED = f"""{POLICY}, {FORMS}, {regex_spans('documents', 'doc_id')}, {ROW_VAULT.format(kept='spans')},
{_pieces('placed', 'documents', 'doc_id')},
halves AS (
  SELECT r.doc_id, d.source, CASE WHEN r.doc_id % 2 = 1
    THEN regexp_replace(redacted, '(?s)>>[^>]*$', '') ELSE redacted END AS text
  FROM red r JOIN documents d USING (doc_id)),
allowed AS (SELECT lower(term) AS term, lower(scope) AS scope FROM policy WHERE list = 'allow'),
res AS (
  SELECT x.doc_id, count(*) AS residual FROM ({dictionary_raw('halves', 'doc_id')}) x
  JOIN documents d USING (doc_id)
  WHERE NOT EXISTS (SELECT 1 FROM allowed a WHERE a.term = lower(x.value)
    AND (a.scope = 'global' OR a.scope = lower(d.source)))
  GROUP BY x.doc_id),
audited AS (
  SELECT doc_id, CASE WHEN residual > 0 THEN 'residual_term'
    WHEN contains(text, '<<') AND NOT contains(text, '>>') THEN 'malformed_placeholder' END AS reason
  FROM halves LEFT JOIN res USING (doc_id))"""

ADMIN_LOG = """
log AS (
  SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'unteach' ELSE 'teach' END AS op,
    CASE WHEN event_id % 2 = 0 THEN 'Term-' || user_id ELSE upper('Term-' || user_id) END AS term,
    upper(event_type) AS label,
    CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN NULL
      WHEN event_id % 4 = 0 THEN 'global'
      WHEN event_id % 7 = 0 THEN upper('Scope' || (event_id % 4))
      ELSE 'Scope' || (event_id % 4) END AS scope,
    event_id % 5 = 0 AS whole_word
  FROM events),
keyed AS (SELECT *, lower(term) AS kt, lower(scope) AS ks FROM log)
"""

REQUESTS = """
requests AS (
  SELECT event_id AS req_id,
    CASE event_id % 3 WHEN 0 THEN 'key-' || (user_id % 30) END AS bearer,
    CASE WHEN event_id % 5 <> 0 THEN 'key-' || ((user_id + event_id) % 28) END AS api_key
  FROM events),
resolved AS (
  SELECT r.req_id, (SELECT arg_max(lower(n_name), n_nationkey) FROM nation n
    WHERE 'key-' || n_nationkey IN (r.bearer, r.api_key)) AS scope
  FROM requests r)
"""

WORD = (
    r"(?i)(?:https?://[^\s]+|www\.[^\s]+)"
    r"|[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
    r"|@[a-z0-9_]+"
    r"|[\p{L}\p{M}\p{Nd}_]+(?:[-_][\p{L}\p{M}\p{Nd}_]+)*"
    r"|\S"
)
CTURNS = "turns AS (SELECT conv_id, turn, text FROM conversations)"


def _words(src: str, key: str) -> str:
    return (
        f"words AS (SELECT {key}, i - 1 AS word_no, value AS word, s AS start, "
        f's + length(value) AS "end" FROM ({located(src, key, repr_sql(WORD))}))'
    )


def _candidates(src: str, key: str, width: int) -> str:
    names = [k.strip() for k in key.split(",")]
    same = " AND ".join(f"a.{k} = b.{k}" for k in names)
    return (
        f"{_words(src, key)}, cand AS (SELECT {', '.join(f'a.{k}' for k in names)}, "
        'a.word_no AS first_word, b.word_no AS last_word, a.start, b."end" '
        f"FROM words a JOIN words b ON {same} "
        f"AND b.word_no BETWEEN a.word_no AND a.word_no + {width - 1})"
    )


SCORED = (
    f"{CTURNS}, {_candidates('turns', 'conv_id, turn', 8)}, scored AS (SELECT conv_id, turn, start, \"end\", "
    "(['email', 'person', 'city', 'vehicle', 'iban'])[first_word % 5 + 1] AS label, "
    '((start * 31 + "end" * 17 + turn * 7) % 1000) / 1000.0::DOUBLE AS score FROM cand)'
)

GOLD_PRED = f"""
{regex_spans('documents', 'doc_id')},
praw AS ({regex_raw('documents', 'doc_id', ('CARD', 'PHONE'), valid=False)}),
sized AS (SELECT doc_id, lang, length(text) AS n FROM documents),
gold AS (SELECT DISTINCT doc_id, unnest(range(s, e)) AS c FROM spans),
pred AS (SELECT DISTINCT doc_id, c FROM (SELECT doc_id, unnest(range(s + 2, e + 2)) AS c FROM praw)
         JOIN sized USING (doc_id) WHERE c < n),
both_ AS (SELECT doc_id, count(*) AS k FROM gold JOIN pred USING (doc_id, c) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS k FROM gold GROUP BY doc_id),
p AS (SELECT doc_id, count(*) AS k FROM pred GROUP BY doc_id),
per AS (
  SELECT z.doc_id, z.lang, coalesce(b.k, 0) AS tp_chars, coalesce(g.k, 0) AS gold_chars,
    coalesce(p.k, 0) AS pred_chars, z.n - coalesce(g.k, 0) AS nonpii_chars
  FROM sized z LEFT JOIN both_ b USING (doc_id) LEFT JOIN g USING (doc_id)
  LEFT JOIN p USING (doc_id)),
sums AS (
  SELECT lang, count(*) AS texts, sum(tp_chars)::BIGINT AS tp, sum(gold_chars)::BIGINT AS gold,
    sum(pred_chars)::BIGINT AS pred, sum(nonpii_chars)::BIGINT AS nonpii FROM per GROUP BY lang),
pr AS (
  SELECT *, CASE WHEN pred = 0 THEN 0 ELSE tp / pred::DOUBLE END AS p,
    CASE WHEN gold = 0 THEN 0 ELSE tp / gold::DOUBLE END AS r FROM sums),
fs AS (
  SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1,
    CASE WHEN 4 * p + r = 0 THEN 0 ELSE 5 * p * r / (4 * p + r) END AS f2,
    CASE WHEN nonpii = 0 THEN 0 ELSE (pred - tp) / nonpii::DOUBLE END AS fpr FROM pr)
"""

J = "to_json(text)::VARCHAR"
# Chat bodies that arrive cut off.
CUT = "(conv_id % 11 = 5 AND turn % 3 = 1)"
CHAT = f"""
chat AS (
  SELECT conv_id, turn, text, '{{"messages":[' || CASE turn % 4
    WHEN 0 THEN '{{"content":' || {J} || ',"name":"x","role":"user"}}'
    WHEN 1 THEN '{{"content":[{{"text":' || {J} || ',"type":"text"}},{{"image_url":{{"url":"u"}},"type":"image_url"}},{{"input_text":' || {J} || ',"type":"input_text"}}],"role":"user"}}'
    WHEN 2 THEN '{{"content":null,"role":"assistant","tool_calls":[{{"function":{{"arguments":' || to_json('{{"q":' || {J} || '}}')::VARCHAR || ',"name":"f"}},"id":"c1","type":"function"}}]}}'
    ELSE '{{"content":' || {J} || ',"reasoning_content":"kept","role":"assistant"}}' END
    || '],"metadata":{{"note":"n"}},"model":"m"}}' AS body
  FROM conversations WHERE NOT {CUT}),
csegs AS (
  SELECT conv_id, turn, 0::BIGINT AS seg_no,
    CASE turn % 4 WHEN 1 THEN 'messages[0].content[0].text'
      WHEN 2 THEN 'messages[0].tool_calls[0].function.arguments'
      ELSE 'messages[0].content' END AS path,
    CASE WHEN turn % 4 = 2 THEN '{{"q":' || {J} || '}}' ELSE text END AS text
  FROM conversations WHERE NOT {CUT}
  UNION ALL
  SELECT conv_id, turn, 1, 'messages[0].content[2].input_text', text
  FROM conversations WHERE turn % 4 = 1 AND NOT {CUT})
"""
BLOCKS = f"""
blocks AS (
  SELECT conv_id, turn, '{{"max_tokens":5,"messages":[{{"content":' || CASE turn % 4
    WHEN 0 THEN {J}
    WHEN 1 THEN '[{{"text":' || {J} || ',"type":"text"}},{{"thinking":"no","type":"thinking"}}]'
    WHEN 2 THEN '[{{"content":[{{"text":' || {J} || ',"type":"text"}},{{"content":"deep","type":"tool_result"}}],"type":"tool_result"}}]'
    ELSE '[{{"input":{{"b":' || {J} || ',"a":["x",{{"z":1,"y":"w"}}]}},"type":"tool_use"}}]' END
    || ',"role":"user"}}],"system":' || CASE WHEN conv_id % 2 = 0 THEN to_json(role || ' prompt')::VARCHAR
    ELSE '[{{"text":' || to_json(role || ' prompt')::VARCHAR || ',"type":"text"}},{{"type":"other"}}]' END
    || '}}' AS body
  FROM conversations)
"""
BLOCK_SEGMENTS = """
SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN '.system' ELSE 'system[0].text' END AS path,
  role || ' prompt' AS text, 0::BIGINT AS seg_no FROM conversations
UNION ALL
SELECT conv_id, turn, 'messages[0].content', text, 1 FROM conversations WHERE turn % 4 = 0
UNION ALL
SELECT conv_id, turn, 'messages[0].content[0].text', text, 1 FROM conversations WHERE turn % 4 = 1
UNION ALL
SELECT conv_id, turn, 'messages[0].content[0].content[0].text', text, 1 FROM conversations WHERE turn % 4 = 2
UNION ALL
SELECT conv_id, turn, 'messages[0].content[0].content[1].content', 'deep', 2 FROM conversations WHERE turn % 4 = 2
UNION ALL
SELECT conv_id, turn, 'messages[0].content[0].input.a[0]', 'x', 1 FROM conversations WHERE turn % 4 = 3
UNION ALL
SELECT conv_id, turn, 'messages[0].content[0].input.a[1].y', 'w', 2 FROM conversations WHERE turn % 4 = 3
UNION ALL
SELECT conv_id, turn, 'messages[0].content[0].input.b', text, 3 FROM conversations WHERE turn % 4 = 3
"""

QUEUE = f"""{DOC_SPANS}, {ALLOWED},
seg AS (SELECT doc_id, source AS scope, min(doc_id) OVER (PARTITION BY source, text) AS first_doc
        FROM documents),
cands AS (
  SELECT k.scope, k.value AS term, seg.doc_id, k.s
  FROM kept k JOIN seg ON seg.doc_id = k.doc_id
  WHERE k.source <> 'dictionary' AND seg.doc_id = seg.first_doc
  AND NOT EXISTS (SELECT 1 FROM forms f WHERE f.rs = k.scope AND lower(f.form) = lower(k.value))),
queue AS (
  SELECT scope, term, (max(doc_id * 1000000000 + s) // 1000000000)::BIGINT AS doc_id,
    (max(doc_id * 1000000000 + s) % 1000000000)::BIGINT AS start
  FROM cands GROUP BY scope, term ORDER BY 3 DESC, 4 DESC, 1, 2 LIMIT 200)
"""

ROUTES = (
    "CASE user_id % 9 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'admin' "
    "WHEN 3 THEN 'admin' WHEN 4 THEN 'admin' WHEN 5 THEN 'admin' WHEN 6 THEN 'health' "
    "WHEN 7 THEN 'metrics' ELSE 'other' END"
)
BOUNDS = "[0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0]"

_LANES = " || '-' || ".join(
    f"coalesce(sum(('0x' || substr(h, {1 + 12 * i}, 12))::BIGINT::HUGEINT), 0)::VARCHAR"
    for i in range(5)
)

STREAM = f"""{TURN_RED},
streams AS (SELECT conv_id, seg_no, redacted AS r, length(redacted) AS n FROM red),
chunk AS (
  SELECT *, unnest(range(0, greatest(ceil(n / 16.0)::BIGINT, 1))) AS chunk_no FROM streams),
ends AS (SELECT *, least(16 * (chunk_no + 1), n) AS e FROM chunk),
looks AS (
  SELECT *, substr(r, 1, e) AS seen, strpos(reverse(substr(r, 1, e)), '<<') AS back FROM ends),
edges AS (
  SELECT *, CASE
    WHEN e = n THEN n
    WHEN back > 0 AND NOT contains(substr(seen, e - back), '>>')
      AND strlen(substr(seen, e - back)) <= 256 THEN e - back - 1
    WHEN right(seen, 1) = '<' THEN e - 1 ELSE e END AS upto
  FROM looks),
out_ AS (
  SELECT conv_id, seg_no, chunk_no, substr(r, prev + 1, upto - prev) AS text FROM (
    SELECT *, coalesce(lag(upto) OVER (PARTITION BY conv_id, seg_no ORDER BY chunk_no), 0) AS prev
    FROM edges)),
parts AS (
  SELECT conv_id, seg_no, chunk_no, unnest(range(1, len(g) + 1)) AS i, g, m FROM (
    SELECT *, string_split_regex(text, '<<[^<>]*>>') AS g, regexp_extract_all(text, '<<[^<>]*>>') AS m
    FROM out_)),
filled AS (
  SELECT p.conv_id, p.seg_no, p.chunk_no,
    string_agg(g[i] || CASE WHEN i > len(m) THEN '' ELSE coalesce(v.real, m[i]) END, '' ORDER BY i)
      AS restored
  FROM parts p LEFT JOIN named v ON v.conv_id = p.conv_id AND i <= len(m) AND v.placeholder = m[i]
  GROUP BY ALL)
"""

# The sample delta run: user turns were scanned before, half of them under an older policy.
DELTA = f"""{TURN_SPANS}, {ALLOWED_ANY},
seen AS (SELECT DISTINCT text FROM conversations WHERE role = 'user' AND length(text) % 2 = 0)
"""


def _with(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}"


def _pattern(label: str) -> str:
    return _with(regex_spans("documents", "doc_id", (label,)), f"SELECT doc_id, {SPAN} FROM spans")


def oracle() -> dict[str, str]:
    sql = {
        "scan_segments": "SELECT doc_id, source, length(text) AS chars, text FROM documents "
        "WHERE trim(text) <> ''",
        "detect_regex": _with(
            regex_spans("documents", "doc_id"), f"SELECT doc_id, {SPAN} FROM spans"
        ),
        "merge_spans": _with(
            merged(regex_raw("documents", "doc_id", valid=False), "doc_id"),
            f"SELECT doc_id, {SPAN} FROM spans",
        ),
        "detect_whole_word": _with(
            POLICY.replace("policy AS (", "policy0 AS (")
            + ", policy AS (SELECT * FROM policy0 WHERE whole_word),"
            + ALL_FORMS
            + ", docs AS (SELECT doc_id, text, '*' AS source FROM documents), raw AS ("
            + dictionary_raw("docs", "doc_id")
            + ")",
            f"SELECT doc_id, {SPAN} FROM raw",
        ),
        "detect_all": _with(
            f"{DOC_SPANS}, {ALLOWED}", f"SELECT doc_id, {SPAN}, source FROM kept"
        ),
        "allow_list_filter": _with(
            f"{DOC_SPANS}, {ALLOWED}",
            "SELECT source_name, label, found, coalesce(kept, 0) AS kept FROM ("
            "SELECT d.source AS source_name, s.label, count(*) AS found FROM spans s "
            "JOIN documents d USING (doc_id) GROUP BY ALL) LEFT JOIN ("
            "SELECT scope AS source_name, label, count(*) AS kept FROM kept GROUP BY ALL) "
            "USING (source_name, label)",
        ),
        "redactions_by_label": _with(
            f"{DOC_SPANS}, {ALLOWED}",
            "SELECT upper(label) AS label, count(*) AS redactions FROM kept GROUP BY 1",
        ),
        "policy_load": f"""WITH {POLICY.split('policy AS (')[0].rstrip().rstrip(',')}
            SELECT item_id * 4294967296 AS ord, 'deny' AS list, w1 AS term, 'ORG' AS label,
              CASE WHEN item_id % 3 = 0 THEN 'global' ELSE 'alpha' END AS scope,
              CASE WHEN item_id % 3 = 0 THEN '' ELSE w2 END AS aliases, '' AS source,
              item_id % 3 <> 0 AND item_id % 2 = 0 AS whole_word
            FROM picked WHERE n >= 4
            UNION ALL
            SELECT item_id * 4294967296, 'allow', wn, '', 'global', '', '', false
            FROM picked WHERE n >= 4 AND item_id % 3 <> 0""",
        "policy_state": f"""WITH {ADMIN_LOG}
            SELECT min(seq) AS ord, arg_min(term, seq) AS term, arg_max(label, seq) AS label,
              arg_min(scope, seq) AS scope, arg_max(whole_word, seq) AS whole_word
            FROM keyed t WHERE op = 'teach' AND NOT EXISTS (
              SELECT 1 FROM keyed u WHERE u.op = 'unteach' AND u.kt = t.kt
              AND (u.ks IS NULL OR u.ks = t.ks) AND u.seq > t.seq)
            GROUP BY kt, ks""",
        "unteach_effect": f"""WITH {ADMIN_LOG}
            SELECT seq, term, scope, EXISTS (
              SELECT 1 FROM keyed t WHERE t.op = 'teach' AND t.kt = u.kt AND t.seq < u.seq
              AND (u.ks IS NULL OR u.ks = t.ks)
              AND NOT EXISTS (SELECT 1 FROM keyed v WHERE v.op = 'unteach' AND v.kt = t.kt
                AND (v.ks IS NULL OR v.ks = t.ks) AND v.seq > t.seq AND v.seq < u.seq)) AS changed
            FROM keyed u WHERE op = 'unteach'""",
        "policy_forms": _with(
            f"{POLICY}, {FORMS}",
            "SELECT scope, lower(form) AS form_key, form, label, whole_word, ord, form_no FROM ("
            "SELECT *, row_number() OVER (PARTITION BY scope, lower(form) ORDER BY whole_word, "
            "strlen(form) DESC, ord, form_no) AS pick FROM hidden) WHERE pick = 1",
        ),
        "policy_terms": _with(
            POLICY, "SELECT ord, term, label, scope FROM policy WHERE list = 'deny'"
        ),
        "policy_version": _with(
            POLICY
            + ", hashed AS (SELECT sha256(concat_ws(chr(1), list, ord::VARCHAR, term, label, scope, "
            "array_to_string(aliases, chr(2)), whole_word::VARCHAR)) AS h FROM policy)",
            f"SELECT sha256(count(*)::VARCHAR || '-' || {_LANES}) AS policy_version FROM hashed",
        ),
        "scope_terms": _with(
            f"{POLICY}, {FORMS}",
            "SELECT rs AS request_scope, form, label, whole_word FROM forms WHERE rs <> 'src0' "
            "UNION ALL SELECT NULL, form, label, whole_word FROM ("
            "SELECT *, row_number() OVER (PARTITION BY lower(form) ORDER BY whole_word, "
            "strlen(form) DESC, ord, form_no) AS pick FROM hidden) WHERE pick = 1",
        ),
        "assign_placeholders": _with(
            f"{TURN_SPANS}, {VAULT}", "SELECT conv_id, real, label, n, placeholder FROM named"
        ),
        "redact_text": _with(DOC_RED, "SELECT doc_id, redacted FROM red"),
        "redact_conversations": _with(TURN_RED, "SELECT conv_id, seg_no, redacted FROM red"),
        "restore_text": _with(
            DOC_RED,
            "SELECT r.doc_id, r.redacted, len(regexp_extract_all(r.redacted, '<<[^<>]*>>'))::BIGINT AS n, "
            "d.text || ' <<  ORG_0>>' AS restored FROM red r JOIN documents d USING (doc_id)",
        ),
        "restore_join": _with(
            TURN_RED,
            "SELECT r.conv_id, r.seg_no, r.redacted, len(regexp_extract_all(r.redacted, '<<[^<>]*>>'))::BIGINT "
            "AS n, c.text AS restored FROM red r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.seg_no",
        ),
        "vault_isolation": _with(
            TURN_RED
            + """,
            parts AS (
              SELECT conv_id, seg_no, unnest(range(1, len(g) + 1)) AS i, g, m FROM (
                SELECT *, string_split_regex(redacted, '<<[^<>]*>>') AS g,
                  regexp_extract_all(redacted, '<<[^<>]*>>') AS m FROM red))""",
            """SELECT p.conv_id, p.seg_no,
              string_agg(g[i] || CASE WHEN i > len(m) THEN '' ELSE coalesce(v.real, m[i]) END, ''
                ORDER BY i) AS with_foreign_vault, true AS own_vault_restores
            FROM parts p LEFT JOIN named v ON v.conv_id = p.conv_id + 1 AND i <= len(m)
              AND v.placeholder = m[i]
            GROUP BY p.conv_id, p.seg_no""",
        ),
        "sealed_vault_roundtrip": _with(
            f"{TURN_SPANS}, {VAULT}",
            'SELECT conv_id, inner_name AS "inner", real, true AS refused FROM named',
        ),
        "audit_residual": _with(REGEX_RED, "SELECT doc_id, residual FROM res"),
        "audit_malformed": _with(
            REGEX_RED,
            "SELECT doc_id, contains(text, '<<') AND NOT contains(text, '>>') AS malformed FROM halves",
        ),
        "audit_split": _with(
            REGEX_RED, "SELECT doc_id, coalesce(reason, 'clean') AS outcome FROM audited"
        ),
        "audit_decoded_strings": f"""
            WITH quoted AS (SELECT conv_id, turn, '"q":' || {J} AS inner_ FROM conversations),
            terms AS (SELECT DISTINCT lower(substr(inner_, 1, 17)) AS term FROM quoted
              WHERE conv_id % 3 = 0 AND turn % 4 = 2)
            SELECT conv_id, turn, NULL::VARCHAR AS serialized, CASE WHEN turn % 4 = 2 AND NOT {CUT} AND EXISTS (
              SELECT 1 FROM terms t WHERE contains(lower(q.inner_), t.term)) THEN 'residual_term' END
              AS decoded FROM quoted q""",
        "scope_resolution": _with(
            REQUESTS,
            "SELECT req_id, scope, CASE WHEN scope IS NULL THEN 'unauthorized_scope' END AS reason "
            "FROM resolved",
        ),
        "scope_requests": _with(
            REQUESTS,
            "SELECT scope, count(*) AS requests FROM resolved WHERE scope IS NOT NULL GROUP BY scope",
        ),
        "oversize_split": "SELECT page_id, CASE WHEN strlen(html) > 8192 "
        "THEN 'oversize' END AS reason FROM pages",
        "blocked_by_reason": _with(
            f"{REGEX_RED}, {REQUESTS}",
            "SELECT reason, count(*) AS blocked FROM (SELECT reason FROM audited UNION ALL "
            "SELECT CASE WHEN scope IS NULL THEN 'unauthorized_scope' END FROM resolved UNION ALL "
            f"SELECT 'unreadable_body' FROM conversations WHERE {CUT}) "
            "WHERE reason IS NOT NULL GROUP BY reason",
        ),
        "scope_config_violations": """
            WITH cfg AS (
              SELECT c_custkey AS entry_no, CASE
                WHEN c_custkey % 97 = 0 THEN 'Global=tok' || c_custkey
                WHEN c_custkey % 89 = 0 THEN 'scope-' || c_custkey
                WHEN c_custkey % 83 = 0 THEN 'scope' || c_custkey || '= '
                ELSE 'seg' || (c_custkey % 140) || ' = tok' || (c_custkey % 130) END AS entry
              FROM customer),
            part_ AS (
              SELECT entry_no, contains(entry, '=') AS pair, lower(trim(split_part(entry, '=', 1))) AS s,
                trim(split_part(entry, '=', 2)) AS t FROM cfg),
            good AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY entry_no) AS sn,
              row_number() OVER (PARTITION BY t ORDER BY entry_no) AS tn
              FROM part_ WHERE pair AND s <> '' AND t <> '')
            SELECT entry_no, 'not scope=token' AS violation FROM part_ WHERE NOT pair
            UNION ALL SELECT entry_no, 'empty part' FROM part_ WHERE pair AND (s = '' OR t = '')
            UNION ALL SELECT entry_no, 'reserved scope' FROM good WHERE s = 'global'
            UNION ALL SELECT entry_no, 'scope listed twice' FROM good WHERE sn > 1
            UNION ALL SELECT entry_no, 'token shared' FROM good WHERE tn > 1""",
        "unknown_scopes": _with(
            POLICY,
            "SELECT ord, term, scope FROM policy WHERE lower(scope) <> 'global' AND lower(scope) "
            "NOT IN (SELECT lower(source) FROM documents WHERE regexp_matches(source, '[13579]$'))",
        ),
        "segment_hash": "SELECT doc_id, sha256(source || chr(0) || text) AS scoped, "
        "sha256(chr(0) || '*' || chr(0) || text) AS unscoped FROM documents",
        "resend_expand": """
            WITH first_ AS (
              SELECT *, row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) = 1 AS new_
              FROM conversations)
            SELECT b.conv_id, b.turn, count(*) AS segments,
              count(*) - max((b.new_)::BIGINT) AS hits, max((b.new_)::BIGINT) AS misses,
              sum(length(a.text))::BIGINT AS chars_sent,
              max(CASE WHEN b.new_ THEN length(b.text) ELSE 0 END)::BIGINT AS chars_scanned
            FROM first_ b JOIN conversations a ON a.conv_id = b.conv_id AND a.turn <= b.turn
            GROUP BY b.conv_id, b.turn""",
        "delta_scan": _with(
            DELTA,
            "SELECT c.conv_id, c.turn, count(s.s) AS n_spans, "
            "c.text IN (SELECT text FROM seen) AS hit, coalesce(min(s.s), -1) AS first_start "
            "FROM conversations c LEFT JOIN kept s ON s.conv_id = c.conv_id AND s.seg_no = c.turn "
            "GROUP BY c.conv_id, c.turn, c.text",
        ),
        "delta_hit_rate": "SELECT count(*) AS lookups, count(*) - count(DISTINCT (source, text)) "
        "AS hits, count(DISTINCT (source, text)) AS misses FROM documents",
        "suggestions": _with(QUEUE, "SELECT * FROM queue"),
        "suggestions_by_scope": _with(QUEUE, "SELECT * FROM queue WHERE scope = 'src3'"),
        "suggestions_all_scopes": _with(
            QUEUE,
            "SELECT term, arg_min(doc_id, doc_id * 1000000000 + start) AS doc_id, "
            "arg_min(start, doc_id * 1000000000 + start) AS start FROM queue GROUP BY term",
        ),
        "merge_intervals": _with(
            f"raw AS ({regex_raw('documents', 'doc_id', valid=False)}), "
            "chars AS (SELECT DISTINCT doc_id, unnest(range(s, e)) AS c FROM raw)",
            'SELECT doc_id, min(c) AS start, max(c) + 1 AS "end" FROM ('
            "SELECT *, c - row_number() OVER (PARTITION BY doc_id ORDER BY c) AS grp FROM chars) "
            "GROUP BY doc_id, grp",
        ),
        "span_overlap": _with(
            GOLD_PRED, "SELECT doc_id, tp_chars, gold_chars, pred_chars, nonpii_chars FROM per"
        ),
        "masking_score": _with(
            GOLD_PRED,
            "SELECT lang, texts, tp AS tp_chars, gold AS gold_chars, pred AS pred_chars, "
            'nonpii AS nonpii_chars, round(p, 9) AS "precision", round(r, 9) AS recall, '
            "round(f1, 9) AS f1, round(f2, 9) AS f2, round(fpr, 9) AS fpr FROM fs",
        ),
        "masking_score_macro": _with(
            GOLD_PRED,
            "SELECT round(avg(f2), 9) AS avg_f2, round(avg(f1), 9) AS avg_f1, "
            "round(avg(p), 9) AS avg_precision, round(avg(r), 9) AS avg_recall, "
            "count(*) = 4 AS complete FROM fs",
        ),
        "task_labels": _with(
            regex_spans("documents", "doc_id"),
            "SELECT DISTINCT lang, label FROM spans JOIN documents USING (doc_id)",
        ),
        "sample_per_task": "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER ("
        "PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || ':13'), doc_id) AS r FROM documents) "
        "WHERE r <= 20",
        "label_list_split": "SELECT doc_id, lang || '|' || source AS labels FROM documents",
        "preset_filter": _with(
            SCORED,
            "SELECT preset, label, count(*) AS n, round(sum(score), 6) AS total FROM ("
            "SELECT *, (['general', 'recall', 'precision', 'small'])[conv_id % 4 + 1] AS preset, "
            "([0.5, 0.3, 0.7, 0.4])[conv_id % 4 + 1] AS t FROM scored) WHERE score >= t "
            "AND (preset <> 'general' OR label IN ('email', 'person', 'city')) GROUP BY ALL",
        ),
        "extract_chat_segments": _with(CHAT, "SELECT * FROM csegs"),
        "extract_block_segments": BLOCK_SEGMENTS,
        "json_string_leaves": _with(
            BLOCKS,
            "SELECT conv_id, turn, t.fullkey AS path, t.value->>'$' AS value "
            "FROM blocks, json_tree(blocks.body) t WHERE t.type = 'VARCHAR'",
        ),
        "json_all_strings": _with(
            CHAT,
            "SELECT conv_id, turn, t.fullkey AS path, t.value->>'$' AS value "
            "FROM chat, json_tree(chat.body) t WHERE t.type = 'VARCHAR' UNION ALL "
            "SELECT conv_id, turn, t.fullkey, t.key FROM chat, json_tree(chat.body) t "
            "WHERE t.key IS NOT NULL AND NOT regexp_full_match(t.key, '[0-9]+')",
        ),
        "json_deep_strings": f"""
            SELECT conv_id, turn, s.no AS leaf_no, '$' || repeat('.a[0]', {NESTING - 1}) || '.a[' || s.at || ']' AS path,
                s.value FROM (
              SELECT conv_id, turn, unnest([{{'no': 0::BIGINT, 'at': 0, 'value': text}},
                {{'no': 1::BIGINT, 'at': 2, 'value': role}}]) AS s FROM conversations)""",
        "rebuild_chat_body": """
            SELECT conv_id, turn, CASE WHEN NOT (conv_id % 11 = 5 AND turn % 3 = 1) THEN '{"messages":[' || CASE turn % 4
              WHEN 0 THEN '{"content":"#0/' || length(text) || '","name":"x","role":"user"}'
              WHEN 1 THEN '{"content":[{"text":"#0/' || length(text) || '","type":"text"},{"image_url":{"url":"u"},"type":"image_url"},{"input_text":"#1/' || length(text) || '","type":"input_text"}],"role":"user"}'
              WHEN 2 THEN '{"content":null,"role":"assistant","tool_calls":[{"function":{"arguments":"#0/' || length('{"q":' || to_json(text)::VARCHAR || '}') || '","name":"f"},"id":"c1","type":"function"}]}'
              ELSE '{"content":"#0/' || length(text) || '","reasoning_content":"kept","role":"assistant"}' END
              || '],"metadata":{"note":"n"},"model":"m"}' END AS rebuilt
            FROM conversations""",
        "jsonl_detect": _with(
            "src AS (SELECT doc_id, CASE WHEN doc_id % 10 = 7 THEN '' ELSE text END AS text "
            "FROM documents WHERE doc_id % 10 NOT IN (3, 5)), " + regex_spans("src", "doc_id"),
            """SELECT d.doc_id, CASE WHEN d.doc_id % 10 <> 3 THEN d.doc_id::VARCHAR END AS id,
              CASE WHEN d.doc_id % 10 <> 3 THEN '[' || coalesce((SELECT string_agg('{"start":' || s
                || ',"end":' || e || ',"label":"' || label || '","score":0.0,"source":"regex"}', ','
                ORDER BY s) FROM spans x WHERE x.doc_id = d.doc_id), '') || ']' END AS entities,
              CASE WHEN d.doc_id % 10 = 3 THEN 'unreadable line' END AS error
            FROM documents d WHERE d.doc_id % 10 <> 5""",
        ),
        "word_tokens": _with(_words("documents", "doc_id"), "SELECT * FROM words"),
        "candidate_spans": _with(
            _candidates("documents", "doc_id", 8),
            'SELECT doc_id, count(*) AS n, sum(start)::BIGINT AS starts, sum("end")::BIGINT '
            "AS ends, sum(last_word - first_word)::BIGINT AS extra_words FROM cand GROUP BY ALL",
        ),
        "label_scores": """
            WITH e AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS pos,
                unnest(embedding)::DOUBLE AS x FROM embeddings),
            m AS (SELECT label, pos, avg(x) AS y FROM e GROUP BY label, pos),
            d AS (SELECT e.vec_id, m.label, sum(x * y) AS logit FROM e JOIN m USING (pos)
              GROUP BY e.vec_id, m.label)
            SELECT vec_id, label, round(logit, 6) AS logit, round(1 / (1 + exp(-logit)), 6) AS score
            FROM d""",
        "label_top_k": """
            WITH e AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS pos,
                unnest(embedding)::DOUBLE AS x FROM embeddings),
            m AS (SELECT label, pos, avg(x) AS y FROM e GROUP BY label, pos),
            d AS (SELECT e.vec_id, m.label, sum(x * y) AS logit FROM e JOIN m USING (pos)
              GROUP BY e.vec_id, m.label),
            r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, label) AS rank FROM d)
            SELECT vec_id, rank::INTEGER AS rank, label, round(logit, 6) AS logit,
              round(1 / (1 + exp(-logit)), 6) AS score FROM r WHERE rank <= 3""",
        "top_values": _with(
            regex_spans("documents", "doc_id"),
            "SELECT label, value, count(*) AS n FROM spans GROUP BY ALL ORDER BY n DESC, label, value LIMIT 50",
        ),
        "redactions_rollup": _with(
            regex_spans("documents", "doc_id"),
            "SELECT d.source, d.lang, s.label, bit_count(grouping(d.source, d.lang, s.label))::INTEGER AS level, "
            "count(*) AS redactions, count(DISTINCT s.value) AS distinct_values "
            "FROM spans s JOIN documents d USING (doc_id) GROUP BY ROLLUP (d.source, d.lang, s.label)",
        ),
        "score_threshold": _with(
            SCORED,
            "SELECT conv_id, label, count(*) AS n FROM scored WHERE score >= 0.5 GROUP BY ALL",
        ),
        "nms_spans": _with(
            SCORED
            + """, pool AS (
              SELECT *, row_number() OVER (PARTITION BY conv_id, turn, label
                ORDER BY score DESC, start, "end") AS rn FROM scored WHERE score >= 0.5),
            walk AS (
              SELECT conv_id, turn, label, rn, true AS keep, [{'s': start, 'e': "end"}] AS kept
              FROM pool WHERE rn = 1
              UNION ALL
              SELECT p.conv_id, p.turn, p.label, p.rn,
                len(list_filter(w.kept, lambda k: p.start < k.e AND p."end" > k.s)) = 0,
                CASE WHEN len(list_filter(w.kept, lambda k: p.start < k.e AND p."end" > k.s)) = 0
                  THEN list_append(w.kept, {'s': p.start, 'e': p."end"}) ELSE w.kept END
              FROM walk w JOIN pool p ON p.conv_id = w.conv_id AND p.turn = w.turn
                AND p.label = w.label AND p.rn = w.rn + 1)""",
            'SELECT p.conv_id, p.turn, p.start, p."end", p.label, round(p.score, 6) AS score '
            "FROM pool p JOIN walk w USING (conv_id, turn, label, rn) WHERE w.keep",
        ),
        "span_clamp": """
            WITH r AS (
              SELECT doc_id, text, length(text) AS n, unnest([
                {'s': -3, 'e': doc_id % 7, 'l': 'A'}, {'s': length(text) - 2, 'e': length(text) + 9, 'l': 'B'},
                {'s': length(text) + 1, 'e': length(text) + 9, 'l': 'C'}, {'s': 5, 'e': 5, 'l': 'D'}]) AS x
              FROM documents),
            c AS (SELECT doc_id, text, greatest(least(x.s, n), 0) AS s, greatest(least(x.e, n), 0) AS e,
              x.l AS label FROM r)
            SELECT doc_id, s AS start, e AS "end", label, substr(text, s + 1, e - s) AS value
            FROM c WHERE s < e""",
        "detect_plugin": _with(
            merged(
                regex_raw("documents", "doc_id")
                + " UNION ALL SELECT doc_id, 'SECRET' AS label, 2 AS prio, 9000000 + i AS ord, s, "
                "s + length(value) AS e, value, 'hex' AS source FROM ("
                + located(
                    "(SELECT * FROM documents WHERE NOT contains(text, '### '))",
                    "doc_id",
                    "'[0-9a-f]{40}'",
                )
                + ")",
                "doc_id",
            ),
            f"SELECT doc_id, {SPAN}, source FROM spans",
        ),
        "detector_failures": "SELECT count(*) AS segments, count(*) FILTER (contains(text, '### ')) "
        "AS failures FROM documents",
        "stream_restore_batch": _with(
            STREAM,
            "SELECT conv_id || '-' || seg_no AS stream_id, CASE WHEN seg_no % 2 = 0 THEN 'content' "
            "ELSE 'reasoning' END AS field, chunk_no, restored FROM filled",
        ),
        "windowed_counts": "SELECT strftime(time_bucket(INTERVAL '5 minutes', ts), "
        "'%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
        "histogram_buckets": f"""
            WITH b AS (SELECT unnest({BOUNDS}) AS le UNION ALL SELECT -1)
            SELECT event_type, le::DOUBLE AS le, count(*) FILTER (le < 0 OR value <= le) AS n,
              round(sum(value), 4) AS total, count(*) AS observations
            FROM events, b GROUP BY event_type, le""",
        "capped_counts": """
            WITH per AS (
              SELECT 'user' || user_id AS label, count(*) AS n,
                row_number() OVER (ORDER BY min(event_id)) AS r FROM events GROUP BY user_id)
            SELECT CASE WHEN r <= 64 THEN label ELSE 'other' END AS label, sum(n)::BIGINT AS n
            FROM per GROUP BY 1""",
        "traffic_matrix": f"SELECT {ROUTES} AS route, CASE WHEN event_type = 'error' THEN 502 "
        "ELSE 200 END AS status, count(*) AS requests FROM events GROUP BY ALL",
    }
    for label in ORDER:
        sql[f"detect_{label.lower()}"] = _pattern(label)
    dictionary = _with(
        f"{POLICY}, {FORMS}, raw AS ({dictionary_raw('documents', 'doc_id')})",
        f"SELECT doc_id, {SPAN} FROM raw",
    )
    sql["detect_dictionary"] = dictionary
    sql["detect_dictionary_pattern"] = dictionary
    sql["detect_dictionary_large"] = dictionary
    sql["detect_dictionary_join"] = dictionary
    return sql


