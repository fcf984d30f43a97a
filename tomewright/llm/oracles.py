"""DuckDB SQL for the queries that SQL can express, over the driver's tables."""

from __future__ import annotations

from . import line_dedup, quality_rules

#: Payload digests need base 32, which is spelled out: each five hexadecimal digits are four of base 32.
_BASE32 = "array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform(range(0, 4), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, g * 5 + 1, 5))::BIGINT >> (15 - 5 * k)) & 31)::INTEGER + 1, 1)), '')), '')"

OP4 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)"""

OP5 = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length('### : ') + length(regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g')) + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) + length(' </turn>') + 1) AS formatted_chars
    FROM r GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM g"""

OP6 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 2], ' ') END AS s
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s AS a JOIN s AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n AS x ON a = x.doc_id JOIN n AS y ON b = y.doc_id WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

_FOLDED = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP9 = f"""
WITH d AS (SELECT doc_id, {_FOLDED} AS ws FROM documents),
b AS (SELECT item_id, {_FOLDED} AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i:i + 12], ' ') AS p
    FROM (SELECT *, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
v AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS p
    FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(ws) >= n)),
h AS (SELECT doc_id, v.n, i, item_id FROM v JOIN p ON v.p = p.p AND v.n = p.n),
k AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
j AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN j USING (doc_id)"""

_CODE_PARTS, _CODE_ENTRIES = 16, 64
_APART = "list_sum(list_transform(list_zip(v, e), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
_NEAREST = f"SELECT r, part, any_value(v) AS v, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT r, part, v, entry, {_APART} AS d FROM p JOIN {{0}} USING (part)) GROUP BY r, part"
_MEANS = "SELECT part, entry, coalesce(m, e) AS e FROM {0} LEFT JOIN (SELECT part, entry, list(m ORDER BY j) AS m FROM (SELECT part, entry, j, floor(sum(v[j])::DOUBLE / count(*))::BIGINT AS m FROM (SELECT *, unnest(range(1, len(v) + 1)) AS j FROM {1}) GROUP BY ALL) GROUP BY part, entry) USING (part, entry)"

OP11 = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, v[part * (len(v) // {_CODE_PARTS}) + 1:(part + 1) * (len(v) // {_CODE_PARTS})] AS v FROM (SELECT *, unnest(range(0, {_CODE_PARTS})) AS part FROM k)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, v AS e FROM p WHERE r <= {_CODE_ENTRIES}),
a0 AS MATERIALIZED ({_NEAREST.format('c0')}), c1 AS MATERIALIZED ({_MEANS.format('c0', 'a0')}),
a1 AS MATERIALIZED ({_NEAREST.format('c1')}), c2 AS MATERIALIZED ({_MEANS.format('c1', 'a1')}),
a2 AS MATERIALIZED ({_NEAREST.format('c2')}),
o AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY r),
s AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN o USING (r), s"""

_TERMS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ws FROM documents),
i AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY ALL),
g AS (SELECT count(*) AS n_all, sum(len(ws))::BIGINT AS l_all FROM d WHERE len(ws) > 0),
m AS (SELECT r, doc_id, 75 + (25 * len(ws) * n_all) // l_all AS m FROM d, g WHERE len(ws) > 0),
f AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ws) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM f GROUP BY t), g),
s AS (SELECT item_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score, any_value(doc_id) AS doc_id FROM i JOIN w USING (t) JOIN f USING (t) JOIN m USING (r) GROUP BY item_id, r)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20"""

ORACLES = {
    "op3_quality_rules": quality_rules.oracle(),
    "op4_warc": OP4,
    "op5_chat": OP5,
    "op6_minhash": OP6,
    "op8_line_dedup": line_dedup.oracle(),
    "op9_decontamination": OP9,
    "op11_vector_codes": OP11,
    "op13_lexical_search": OP13,
}
