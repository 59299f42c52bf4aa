"""The package's queries and their SQL."""

from __future__ import annotations

from . import decontaminate, licenses, line_dedup, ngram_join, pieces, pii, prefix_trie, quality_rules, secrets, token_files, toxicity, url_filters

QUERIES = {
    "op1_pii_surrogates": pii.op1_pii_surrogates,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_licenses": licenses.op3_licenses,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_pieces": pieces.op6_pieces,
    "op7_token_files": token_files.op7_token_files,
    "op8_secrets": secrets.op8_secrets,
    "op9_ngram_classes": ngram_join.op9_ngram_classes,
    "op10_url_filters": url_filters.op10_url_filters,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_toxicity": toxicity.op12_toxicity,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules and the exact membership that the cascade must give, by a plain grouped look-up.
_URL_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filters.RULES)
_URLS = f"""
WITH parts AS (
    SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path
    FROM (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS rest FROM pages)
), rules(h, p, v) AS (VALUES {_URL_RULES}), fits AS (
    SELECT page_id, h || p AS rule, v FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
    QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) = 1
), listed AS (
    SELECT host FROM parts LEFT JOIN fits USING (page_id) WHERE host <> '' GROUP BY host HAVING avg(coalesce(v = 'block', false)::int) >= {url_filters.LISTED_SHARE}
)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN host IN (SELECT host FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fits USING (page_id)
"""

#: All pairs by their shared shingles, links by exact similarity, classes by reachability.
_CLASSES = f"""
WITH RECURSIVE ws AS (
    SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM ws WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), links AS (
    SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL)
    JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)
), reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.y FROM reach JOIN links ON reach.b = links.x)
SELECT d.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, r.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id
"""

#: Prefixes as lists of turns; a node is known by its depth and smallest member.
_CRC = "xor(list_reduce([4294967295::UBIGINT] || [ord(x)::UBIGINT FOR x IN string_split(c::VARCHAR, '')], lambda a, b: list_reduce([xor(a, b)] || [0::UBIGINT FOR x IN range(8)], lambda v, z: xor(v >> 1, 3988292384::UBIGINT * (v & 1::UBIGINT)))), 4294967295::UBIGINT)"
_TRIE = f"""
WITH t AS (
    SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS turn FROM conversations WHERE conv_id IS NOT NULL
), own AS (SELECT c, list(turn ORDER BY i) AS s FROM t GROUP BY c
), h AS (SELECT c, s, c - c % {prefix_trie.FAMILY} AS p, ({_CRC} % {prefix_trie.MOST_SHARED})::INT AS h FROM own
), l AS (SELECT h.c, coalesce(o.s[1:h], []) || h.s[h + 1:] AS s FROM h LEFT JOIN own o ON o.c = h.p
), r AS (SELECT c, s, d, min(c) OVER (PARTITION BY d, s[1:d]) AS f FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM l)
), n AS (SELECT d, f, count(*) AS n, any_value(CASE WHEN d > 0 THEN len(regexp_extract_all(s[d].t, '[^\x20\x09-\x0D]+')) ELSE 0 END) AS w FROM r GROUP BY d, f
), np AS (SELECT n.*, r.f AS pf FROM n LEFT JOIN r ON r.c = n.f AND r.d = n.d - 1
), ch AS (SELECT d - 1 AS d, pf AS f, count(*) AS k FROM np WHERE d > 0 GROUP BY ALL
), nk AS (SELECT np.*, coalesce(ch.k, 0) AS k FROM np LEFT JOIN ch USING (d, f)
), sub AS (SELECT r.d, r.f, sum((nk.n - 1) * nk.w)::BIGINT AS saved, count(*) FILTER (nk.k = 0) AS leaves FROM r JOIN nk ON nk.f = r.c AND nk.d >= r.d GROUP BY ALL
), e AS (SELECT d, f, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM r WHERE d = len(s) GROUP BY ALL)
SELECT nk.f AS conv_id, nk.d AS depth, pf AS parent_conv_id, n AS n_convs, k AS n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nk JOIN sub USING (d, f) LEFT JOIN e USING (d, f)
"""

SQL: dict[str, str] = {"op11_prefix_trie": _TRIE, "op9_ngram_classes": _CLASSES, "op10_url_filters": _URLS}
