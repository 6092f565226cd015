"""Check SQL (DuckDB) of the training-data queries that SQL can express."""

from __future__ import annotations

from maskweave.llm.vector_codes import ENTRIES, PARTS, ROUNDS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_verdicts(rules: list[tuple[str, str, str]], listed: str) -> str:
    """Longest fitting rule of every page; without one, whether its url is among the listed."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
    WITH cut AS (
        SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
        FROM pages),
    places AS (
        SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
        FROM cut),
    rules(rule_host, rule_path, verdict) AS (VALUES {values}),
    fits AS (
        SELECT u.host, u.path, r.rule_host || r.rule_path AS rule, r.verdict,
            row_number() OVER (PARTITION BY u.host, u.path
                ORDER BY length(r.rule_host || r.rule_path) DESC, length(r.rule_host) DESC, r.verdict DESC) AS n
        FROM (SELECT DISTINCT host, path FROM places) u JOIN rules r
        ON (u.host = r.rule_host OR ends_with(u.host, '.' || r.rule_host)) AND starts_with(u.path, r.rule_path))
    SELECT p.page_id, p.host, p.path, f.rule,
        CASE WHEN f.rule IS NOT NULL THEN f.verdict
            WHEN regexp_matches(p.host, '{listed}') THEN 'block' ELSE 'allow' END AS verdict
    FROM places p LEFT JOIN fits f ON f.host = p.host AND f.path = p.path AND f.n = 1
    """


def vector_codes() -> str:
    """Codebooks refined in rounds, every distance computed."""
    ctes = [
        """kept AS (
        SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rn, vec_id, label, embedding AS v
        FROM embeddings
        WHERE embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""points AS MATERIALIZED (
        SELECT rn, part, list_transform(v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})],
            lambda x: floor(x::DOUBLE * 256)::BIGINT) AS p
        FROM kept, unnest(range({PARTS})) AS t(part))""",
        f"book0 AS MATERIALIZED (SELECT part, rn - 1 AS entry, p AS e FROM points WHERE rn <= {ENTRIES})",
    ]
    for i in range(ROUNDS + 1):
        ctes.append(
            f"""near{i} AS MATERIALIZED (
        SELECT rn, part, any_value(p) AS p, min({{'far': far, 'entry': entry}}) AS best
        FROM (SELECT rn, part, p, entry,
                list_sum(list_transform(list_zip(p, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS far
            FROM points JOIN book{i} USING (part))
        GROUP BY rn, part)"""
        )
        if i < ROUNDS:
            ctes.append(
                f"""mean{i} AS (
        SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS e
        FROM (SELECT part, best.entry AS entry, pos, sum(p[pos])::HUGEINT AS s, count(*)::HUGEINT AS n
            FROM near{i}, unnest(range(1, len(p) + 1)) AS t(pos) GROUP BY ALL)
        GROUP BY part, entry),
    book{i + 1} AS MATERIALIZED (
        SELECT part, entry, coalesce(m.e, b.e) AS e FROM book{i} b LEFT JOIN mean{i} m USING (part, entry))"""
            )
    ctes.append(
        f"""coded AS (
        SELECT rn, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.far)::BIGINT AS error
        FROM near{ROUNDS} GROUP BY rn)"""
    )
    ctes.append(
        f"""hashed AS (
        SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS h FROM book{ROUNDS})"""
    )
    return f"""
    WITH {", ".join(ctes)}
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
        (SELECT h FROM hashed) AS codebooks_sha256
    FROM coded JOIN kept USING (rn)
    """


# CRC-32, a bit at a time: a byte is added, then eight steps of the reversed polynomial follow.
CRC = """xor(list_reduce(flatten(list_transform(string_split(conv_id::VARCHAR, ''),
        lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
        lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384)
            ELSE acc >> 1 END, 4294967295::BIGINT), 4294967295::BIGINT)"""


def prefix_trie() -> str:
    """Every rebuilt prefix as a list of turns; subtrees by comparing the lists."""
    return f"""
    WITH own AS (
        SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS ts
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    sized AS (SELECT *, {CRC} % 6 AS h FROM own),
    whole AS (
        SELECT a.conv_id, list_concat(coalesce(b.ts[1:a.h], []), a.ts[a.h + 1:]) AS s
        FROM sized a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100),
    prefixes AS (
        SELECT conv_id, d, s[1:d] AS p, d = len(s) AS is_last FROM whole, unnest(range(len(s) + 1)) AS t(d)),
    nodes AS MATERIALIZED (
        SELECT d, p, count(*) AS n_convs, min(conv_id) AS conv_id,
            CASE WHEN d = 0 THEN 0 ELSE length(p[d].t) END AS chars,
            coalesce(string_agg(CASE WHEN is_last THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ids
        FROM prefixes GROUP BY d, p),
    children AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
    counted AS MATERIALIZED (
        SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.d = n.d AND c.p = n.p),
    subtrees AS (
        SELECT a.d, a.p, sum((u.n_children = 0)::INT)::BIGINT AS n_leaves,
            sum((u.n_convs - 1) * u.chars)::BIGINT AS saved_tokens
        FROM counted a JOIN counted u ON u.d >= a.d AND u.p[1:a.d] = a.p
        GROUP BY a.d, a.p)
    SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves,
        s.saved_tokens, sha256(n.ids) AS ends_sha256
    FROM counted n JOIN subtrees s ON s.d = n.d AND s.p = n.p
    LEFT JOIN nodes up ON up.d = n.d - 1 AND up.p = n.p[1:n.d - 1] AND n.d > 0
    """
