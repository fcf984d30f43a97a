"""The catalogue's queries in DuckDB's SQL: common table expressions shared by name, and a body each."""

from __future__ import annotations

import re

from ..operators.extract import DEFAULT_PATTERNS

#: The default patterns, whose syntax RE2 shares.
_PATTERNS = dict(DEFAULT_PATTERNS)
_TOKEN, _TION = r"\b[A-Z][a-z]{4,7}\b", r"\b[a-z]{2,6}tion\b"
_CUSTOM = {"token": _TOKEN, "tion": _TION}

_CONFIDENCE = (
    "least(1::double, 0.7::double + (((CASE WHEN length(name) >= 6 THEN 0.1::double ELSE 0::double END + CASE WHEN regexp_matches(name, '[A-Z]') AND regexp_matches(name, '[a-z]') THEN 0.1::double ELSE 0::double END)"
    " + CASE WHEN regexp_matches(name, '[0-9]') THEN 0.05::double ELSE 0::double END) + CASE WHEN type IN ('email', 'doi', 'pmid') THEN 0.2::double ELSE 0::double END))"
)


def _sentences(text: str) -> str:
    """No look-behind in RE2: a mark goes between an end and the capital after it."""
    return rf"list_filter(list_transform(string_split(regexp_replace({text}, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) >= 20)"


_NORM = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def _id(ns: str, uri: str, key: str, text: str) -> str:
    return f"sha256({ns} || '|' || {uri} || '|' || {key} || '|' || {_NORM.format(text)})"


def _segments(resources: str) -> str:
    return f"""SELECT ir_id, namespace, source_uri, i::INT AS segment_index, (i * 3)::INT AS sentence, least(3, len(s) - i * 3)::INT AS sentence_count, t AS text,
        {_id('namespace', 'source_uri', '(i * 3)::VARCHAR', 't')} AS id, sha256({_NORM.format('t')}) AS text_hash
        FROM (SELECT *, array_to_string(s[i * 3 + 1:i * 3 + 3], ' ') AS t FROM (SELECT *, unnest(range(0, (len(s) + 2) // 3)) AS i
        FROM (SELECT id AS ir_id, namespace, source_uri, {_sentences('text')} AS s FROM {resources})))"""


def _hits(source: str, patterns: dict[str, str], key: str = "id", least: float = 0.5, folded: bool = False) -> str:
    """RE2's word borders are ASCII's: other characters are masked as word characters first, but not for addresses, whose class holds the mask."""
    parts = []
    for kind, pattern in patterns.items():
        text = "text" if kind == "email" else r"regexp_replace(text, '[^\x00-\x7F]', '_', 'g')"
        pattern = ("(?i)" if folded else "") + pattern
        parts.append(f"SELECT *, '{kind}' AS type, unnest(list_distinct(regexp_extract_all({text}, '{pattern}', 0))) AS name FROM {source}")
    return f"SELECT * FROM (SELECT *, {_CONFIDENCE} AS confidence FROM ({' UNION ALL '.join(parts)})) WHERE confidence >= {least}"


_DENSE = {**_PATTERNS, **_CUSTOM}
_EDIT = "SELECT * REPLACE (CASE WHEN doc_id % 7 = 0 THEN text || ' x' ELSE text END AS text, sha256(CASE WHEN doc_id % 7 = 0 THEN text || ' x' ELSE text END) AS content_hash) FROM ir WHERE doc_id >= 10"

CTES = {
    "ir": "SELECT doc_id, sha256(lang || '|doc://' || doc_id) AS id, lang AS namespace, 'txt' AS source_type, 'doc://' || doc_id AS source_uri, sha256(text) AS content_hash, text, doc_id AS created_at FROM documents",
    "seg": _segments("ir"),
    "later": _EDIT,
    "later_seg": _segments("later"),
    "page": "SELECT id AS ir_id, namespace, source_uri, (p + 1)::INT AS page_num, substr(text, p * 1000 + 1, 1000) AS text FROM (SELECT *, unnest(range(0, (length(text) + 999) // 1000)) AS p FROM ir)",
    "page_seg": f"""SELECT *, (row_number() OVER (PARTITION BY namespace, source_uri ORDER BY page, sentence) - 1)::INT AS segment_index, {_id('namespace', 'source_uri', "page || ':' || sentence", 'text')} AS id FROM
        (SELECT ir_id, namespace, source_uri, page_num AS page, (i * 3)::INT AS sentence, least(3, len(s) - i * 3)::INT AS sentence_count, array_to_string(s[i * 3 + 1:i * 3 + 3], ' ') AS text FROM
        (SELECT *, unnest(range(0, (len(s) + 2) // 3)) AS i FROM (SELECT ir_id, namespace, source_uri, page_num, {_sentences('text')} AS s FROM page WHERE length(text) >= 50)))""",
    "md": "SELECT 'conv' AS namespace, 'conv://' || conv_id AS source_uri, string_agg('# ' || role || chr(10) || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
    "md_line": "SELECT namespace, source_uri, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM (SELECT namespace, source_uri, string_split(text, chr(10)) AS l FROM md)",
    "md_part": "SELECT *, sum(CASE WHEN starts_with(line, '#') THEN 1 ELSE 0 END) OVER (PARTITION BY source_uri ORDER BY pos) AS part FROM md_line",
    "md_section": r"SELECT namespace, source_uri, part, coalesce(trim(ltrim(max(line) FILTER (starts_with(line, '#')), '#')), 'root') AS heading, string_agg(line, ' ' ORDER BY pos) FILTER (NOT starts_with(line, '#') AND regexp_matches(line, '\S')) AS text FROM md_part GROUP BY namespace, source_uri, part",
    "md_para": f"SELECT *, (row_number() OVER (PARTITION BY source_uri ORDER BY part) - 1)::INT AS para, {_sentences('text')} AS s FROM md_section WHERE text IS NOT NULL",
    "md_made": "SELECT *, (len(s) + 2) // 3 AS n, sum((len(s) + 2) // 3) OVER (PARTITION BY source_uri ORDER BY para) AS made FROM md_para",
    "md_start": "SELECT *, coalesce(sum(made) OVER (PARTITION BY source_uri ORDER BY para ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM md_made",
    "md_seg": f"""SELECT *, {_id('namespace', 'source_uri', "heading || ':' || para || ':' || sentence", 'text')} AS id FROM (SELECT namespace, source_uri, heading, para, (i * 3)::INT AS sentence, (start + i)::INT AS segment_index, (made - n + i)::INT AS dense_index,
        array_to_string(s[i * 3 + 1:i * 3 + 3], ' ') AS text FROM (SELECT *, unnest(range(0, n)) AS i FROM md_start))""",
    "hit": _hits("seg", _DENSE),
    "ent": "SELECT DISTINCT sha256(namespace || '|' || type || '|' || name) AS id, namespace, type, name, lower(name) AS alias FROM hit",
    "link": "SELECT id AS segment_id, namespace, sha256(namespace || '|' || type || '|' || name) AS entity_id, 'mentions' AS link_type, confidence::FLOAT AS confidence FROM hit",
    "counted": "SELECT e.*, n FROM ent AS e JOIN (SELECT entity_id, count(*) AS n FROM link GROUP BY entity_id) ON entity_id = e.id",
    "named": "SELECT * FROM counted WHERE namespace = 'en' ORDER BY n DESC, name, type LIMIT 1",
    "emb": "SELECT vec_id, seg.id AS segment_id, embedding AS vector, seg.namespace, seg.source_uri, seg.text FROM embeddings JOIN ir ON vec_id = doc_id JOIN seg ON seg.ir_id = ir.id AND segment_index = 0",
    "q0": "SELECT embedding AS q FROM embeddings WHERE vec_id = 0",
    "semantic": "SELECT segment_id, text, source_uri, namespace, round(score, 6) AS score FROM (SELECT *, list_cosine_similarity(vector::double[], q::double[]) AS score FROM emb, q0 WHERE namespace = 'en') ORDER BY round(score, 12) DESC, segment_id",
    "exact": "SELECT DISTINCT segment_id FROM link JOIN named ON entity_id = named.id",
    "near50": "SELECT segment_id FROM semantic LIMIT 50",
    "words": r"SELECT '/data/' || namespace || '/' || substr(source_uri, 7) || '.pdf' AS source_pdf, source_uri, page_num, list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '') AS w FROM page",
    "chunk": "SELECT source_pdf, source_uri, page_num, i::INT AS chunk_index, 'page_' || page_num || '_chunk_' || i AS location, array_to_string(w[i * 35 + 1:i * 35 + 40], ' ') AS content FROM (SELECT *, unnest(range(0, greatest(1, (len(w) - 5 + 34) // 35))) AS i FROM words WHERE len(w) > 0)",
    "appended": "SELECT row_number() OVER (ORDER BY (NOT coalesce(source_pdf LIKE '/data/en/%', false))::INT, source_pdf NULLS FIRST, page_num, chunk_index) AS id, * FROM chunk",
    "moved": f"""SELECT *, 'file://' || source_pdf AS uri, (row_number() OVER (PARTITION BY source_pdf ORDER BY page_num, chunk_index) - 1)::INT AS segment_index, {_id("'migrated'", "'file://' || source_pdf", "page_num || ':' || chunk_index", 'content')} AS id, content AS text FROM chunk""",
}


def sql(body: str) -> str:
    """The body with the expressions it needs, in order of definition."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name, definition in CTES.items():
            if name not in needed and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                needed.add(name)
                todo.append(definition)
    parts = [f"{name} AS MATERIALIZED ({definition})" for name, definition in CTES.items() if name in needed]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def _typed(hits: str) -> str:
    return f"SELECT id, type, name FROM ({hits})"


_FIXED = "(SELECT doc_id, concat_ws(' ', text, 'The CCNA001 strain and BRCA' || doc_id % 100 || '; mail r' || doc_id || '@example.com. See 10.1234/abc.D-' || doc_id || ' and PMID: ' || lpad(doc_id::VARCHAR, 8, '1') || ', also AB1' || lpad((doc_id % 10000)::VARCHAR, 4, '0') || '.') AS text FROM documents)"

_FIRST = "(SELECT min(name) FROM ent WHERE namespace = 'en' AND type = 'token')"

#: A user's view of each time, the last of equal times.
_VIEWS = "(SELECT user_id, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY user_id, ts)"
_DEAD = "(source_uri LIKE '%3' OR namespace = 'de')"
#: Every row of every table, and whether it goes with the resources that go.
_FATES = " UNION ALL ".join([*(f"SELECT '{name}' AS name, namespace, {_DEAD} AS gone FROM {table}" for name, table in (("resources", "ir"), ("segments", "seg"), ("links", "hit"), ("embeddings", "emb"))), f"SELECT 'entities', namespace, bool_and({_DEAD}) FROM hit GROUP BY namespace, type, name"])

_BODIES = {
    "register_resources": "SELECT id, namespace, source_uri, content_hash FROM ir",
    "lookup_resource_by_id": "SELECT id, namespace, source_uri FROM ir WHERE id = (SELECT sha256(lang || '|doc://5') FROM documents WHERE doc_id = 5)",
    "lookup_resource_by_uri": "SELECT id, namespace, source_uri FROM ir WHERE namespace = 'en' AND source_uri = 'doc://2'",
    "list_sources": "SELECT id, source_uri, source_type, content_hash FROM ir WHERE namespace = 'en'",
    "detect_changed": "SELECT l.namespace, l.source_uri, CASE WHEN k.id IS NULL THEN 'new' WHEN k.content_hash <> l.content_hash THEN 'changed' ELSE 'unchanged' END AS status FROM later AS l LEFT JOIN (SELECT * FROM ir WHERE source_uri NOT LIKE '%9') AS k ON k.id = l.id",
    "upsert_resources": "SELECT ir.id, ir.source_type, coalesce(l.content_hash, ir.content_hash) AS content_hash, ir.created_at FROM ir LEFT JOIN later AS l ON l.id = ir.id",
    "split_sentences": f"SELECT doc_id, (generate_subscripts(s, 1) - 1)::INT AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {_sentences('text')} AS s FROM ir)",
    "normalize_text": f"SELECT doc_id, sha256({_NORM.format('text')}) AS text_hash FROM ir",
    "segment_texts": "SELECT id, namespace, source_uri, segment_index, sentence, sentence_count, text, text_hash FROM seg",
    "segment_ids": "SELECT id, ir_id FROM seg",
    "ingest_directory": "SELECT text_hash, segment_index FROM seg",
    "stream_ingest": "SELECT id, ir_id FROM seg",
    "segment_pages": "SELECT id, source_uri, segment_index, page, sentence, text FROM page_seg",
    "segment_markdown": "SELECT id, source_uri, heading, para, sentence, text FROM md_seg",
    "segment_markdown_index": "SELECT id, segment_index, dense_index FROM md_seg",
    "provenance_keys": "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN doc_id || ':' || n_chars WHEN 1 THEN lang || ':' || doc_id || ':' || n_chars WHEN 2 THEN lang || ':0:0' WHEN 3 THEN doc_id || ':0' WHEN 4 THEN source || ':' || doc_id || ':' WHEN 5 THEN source || ':' || doc_id || ':' || lang ELSE doc_id || ':' || n_chars END AS key FROM documents",
    "provenance_roundtrip": "SELECT id, page, sentence, sentence_count, NULL::VARCHAR AS heading_path FROM page_seg",
    "segment_preview": "SELECT id, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS preview, substr(id, 1, 8) AS short_id FROM seg",
    "lookup_segment_by_id": "SELECT id, segment_index, text FROM seg WHERE id = (SELECT min(id) FROM seg)",
    "duplicate_text": "SELECT text_hash, count(*) AS copies, min(id) AS first_id FROM seg GROUP BY text_hash HAVING count(*) > 1",
    "upsert_segments": "SELECT seg.id, seg.segment_index, seg.text_hash, seg.sentence, CASE WHEN l.id IS NOT NULL THEN 7::INT END AS para FROM seg LEFT JOIN (SELECT DISTINCT id FROM later_seg) AS l ON l.id = seg.id UNION ALL SELECT id, -1, text_hash, sentence, 7::INT FROM later_seg WHERE id NOT IN (SELECT id FROM seg)",
    "idempotent_reingest": "SELECT run, count(*) AS n, count(DISTINCT id) AS n_ids, true AS same FROM seg, (VALUES (1), (2)) AS r(run) GROUP BY run",
    "stale_segments": "SELECT id, source_uri FROM seg WHERE ir_id IN (SELECT ir_id FROM later_seg) AND id NOT IN (SELECT id FROM later_seg)",
    "extract_entities": _typed(_hits("seg", _PATTERNS)),
    "extract_raw_documents": f"SELECT doc_id, type, name FROM ({_hits('ir', _PATTERNS)})",
    "extract_custom_patterns": _typed(_hits("seg", _CUSTOM)),
    "custom_extractor": _typed(_hits("seg", {"token": _TOKEN})),
    "extract_case_insensitive": _typed(_hits("seg", {"tion": _TION}, folded=True)),
    "extract_edited_patterns": _typed(_hits("seg", {k: (r"\b[A-Z][a-z]{6,7}\b" if k == "token" else p) for k, p in _DENSE.items() if k != "strain"})),
    "extract_fixed_texts": f"SELECT doc_id, type, name, round(confidence, 6) AS confidence FROM ({_hits(_FIXED, _PATTERNS)})",
    "entity_confidence": "SELECT DISTINCT type, name, round(confidence, 6) AS confidence FROM hit",
    "min_confidence_filter": _typed(_hits("seg", _DENSE, least=0.8)),
    "resolve_entities": "SELECT id, namespace, type, name FROM ent",
    "link_entities": "SELECT segment_id, entity_id, link_type, round(confidence::double, 6) AS confidence FROM link",
    "new_entities": "SELECT id, type, name FROM ent WHERE type <> 'token'",
    "lookup_entity_by_id": "SELECT id, type, name FROM ent WHERE id = (SELECT max(id) FROM ent)",
    "lookup_entity_typed": "SELECT id, type, name FROM ent WHERE namespace = 'en' AND type = 'token' AND name = 'Thtion'",
    "lookup_entity_untyped": f"SELECT id, type, name FROM ent WHERE namespace = 'en' AND (name = {_FIRST} OR alias = {_FIRST}) ORDER BY name, type LIMIT 1",
    "lookup_entity_alias": f"SELECT id, type, name FROM ent WHERE namespace = 'en' AND (name = lower({_FIRST}) OR alias = lower({_FIRST})) ORDER BY name, type LIMIT 1",
    "entity_json": "SELECT id, '[\"' || alias || '\"]' AS aliases_json, '{}' AS metadata_json, 1::INT AS n_aliases, 0::INT AS n_metadata FROM ent",
    "list_entities_by_type": "SELECT id, type, name FROM ent WHERE namespace = 'en' AND type = 'tion'",
    "entity_mention_counts": "SELECT namespace, type, name, n AS mention_count FROM counted",
    "entity_mention_counts_min2": "SELECT type, name, n AS mention_count FROM counted WHERE namespace = 'en' AND type = 'token' AND n >= 2",
    "entity_mention_counts_min0": "SELECT namespace, type, name, n AS mention_count FROM counted UNION ALL SELECT DISTINCT namespace, 'token', 'Unmentioned', 0 FROM ent",
    "upsert_entities": "SELECT id, name, CASE WHEN type = 'tion' THEN '' ELSE alias END AS aliases FROM ent",
    "upsert_links": "SELECT segment_id, entity_id, CASE WHEN entity_id < '8' THEN 3 ELSE 1 END AS created_at, CASE WHEN entity_id < '8' THEN 0.5::double ELSE round(confidence::double, 6) END AS confidence FROM link",
    "exact_recall": "SELECT segment_id, text, source_uri, link_type, round(confidence::double, 6) AS confidence FROM link JOIN named ON entity_id = named.id JOIN seg ON seg.id = segment_id",
    "exact_recall_by_name": f"SELECT segment_id, entity_id, source_uri FROM link JOIN seg ON seg.id = segment_id WHERE entity_id = (SELECT id FROM ent WHERE namespace = 'en' AND (name = {_FIRST} OR alias = {_FIRST}) ORDER BY name, type LIMIT 1)",
    "exact_recall_unknown": "SELECT segment_id, entity_id, source_uri FROM link JOIN seg ON seg.id = segment_id WHERE false",
    "entities_for_segment": "SELECT segment_id, entity_id, type, name FROM link JOIN ent ON ent.id = entity_id",
    "segments_for_source": "SELECT id AS segment_id, text, source_uri, segment_index FROM seg WHERE namespace = 'en' AND source_uri = 'doc://2'",
    "segments_of_resource": "SELECT id AS segment_id, text, source_uri, segment_index FROM seg WHERE source_uri = 'doc://5'",
    "segments_of_missing_resource": "SELECT id AS segment_id, text, NULL::VARCHAR AS source_uri, segment_index FROM seg WHERE source_uri = 'doc://5'",
    "count_segments": "SELECT count(*) AS segments FROM seg",
    "count_segments_by_namespace": "SELECT count(*) AS segments FROM seg WHERE namespace = 'en'",
    "kb_stats": "SELECT namespace, information_resources, coalesce(segments, 0) AS segments, coalesce(entities, 0) AS entities, coalesce(entity_types, 0) AS entity_types FROM (SELECT namespace, count(*) AS information_resources FROM ir GROUP BY 1) LEFT JOIN (SELECT namespace, count(*) AS segments FROM seg GROUP BY 1) USING (namespace) LEFT JOIN (SELECT namespace, count(*) AS entities, count(DISTINCT type) AS entity_types FROM ent GROUP BY 1) USING (namespace)",
    "namespace_isolation": "SELECT count(*) FILTER (l.namespace <> ent.namespace) AS crossing, count(*) AS links FROM link AS l JOIN ent ON ent.id = entity_id",
    "semantic_topk": "SELECT rank::INT AS rank, vec_id, round(v.score, 6) AS vec_score, segment_id, round(s.score, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, vec_id) AS rank FROM (SELECT vec_id, list_cosine_similarity(embedding::double[], q::double[]) AS score FROM embeddings, q0) ORDER BY rank LIMIT 10) AS v FULL JOIN (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, segment_id) AS rank FROM (SELECT segment_id, list_cosine_similarity(vector::double[], q::double[]) AS score FROM emb, q0) ORDER BY rank LIMIT 10) AS s USING (rank)",
    "semantic_topk_namespace": "SELECT * FROM semantic LIMIT 5",
    "semantic_topk_batch": "SELECT query_id, rank::INT AS rank, vec_id, round(v.score, 6) AS vec_score, segment_id, round(s.score, 6) AS score FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(v.embedding::double[], q.embedding::double[]) AS score FROM embeddings AS v, embeddings AS q WHERE q.vec_id % 50 = 0)) WHERE rank <= 5) AS v FULL JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, segment_id) AS rank FROM (SELECT e.vec_id AS query_id, segment_id, list_cosine_similarity(vector::double[], embedding::double[]) AS score FROM emb, embeddings AS e WHERE e.vec_id % 50 = 0)) WHERE rank <= 5) AS s USING (query_id, rank)",
    "embedding_lookup": "SELECT segment_id, 'given' AS model, len(vector)::INT AS size, round(vector[1]::double, 6) AS first FROM emb WHERE vec_id = 7",
    "missing_embeddings": "SELECT id, segment_index FROM seg WHERE id NOT IN (SELECT segment_id FROM emb)",
    "embed_hash": r"""SELECT id, list_transform(range(0, 64), lambda b: coalesce(round((map_extract_value(m, b)::FLOAT / sqrt(l)::FLOAT)::DOUBLE, 4), 0::DOUBLE)) AS vector FROM
        (SELECT seg.id, coalesce(m, MAP {}) AS m, l FROM seg LEFT JOIN (SELECT id, map(list(b), list(v)) AS m, sum(v * v) AS l FROM
        (SELECT id, ('0x' || substr(md5(f), 1, 8))::BIGINT % 64 AS b, sum(CASE WHEN ('0x' || substr(md5(f), 9, 1))::BIGINT >= 8 THEN 1 ELSE -1 END) AS v FROM
        (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM (SELECT id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM seg)) GROUP BY id, b) GROUP BY id) AS g ON g.id = seg.id)""",
    "upsert_embeddings": "SELECT segment_id, CASE WHEN segment_id < '8' THEN 'later' ELSE 'given' END AS model, list_transform(vector, lambda v: round(CASE WHEN segment_id < '8' THEN -v::double ELSE v::double END, 6)) AS vector FROM emb",
    "compare_exact_vs_semantic": "SELECT 'top' AS entity_name, e AS exact_count, s AS semantic_count, o AS overlap_count, e - o AS missed_by_semantic_count, s - o AS false_positive_count, CASE WHEN e > 0 THEN round(o / e, 6) ELSE 0::double END AS recall, CASE WHEN s > 0 THEN round(o / s, 6) ELSE 0::double END AS precision, coalesce(m, '') AS missed_segments FROM (SELECT (SELECT count(*) FROM exact) AS e, (SELECT count(*) FROM near50) AS s, (SELECT count(*) FROM exact JOIN near50 USING (segment_id)) AS o, (SELECT string_agg(segment_id, ',' ORDER BY segment_id) FROM (SELECT segment_id FROM exact WHERE segment_id NOT IN (SELECT segment_id FROM near50) ORDER BY segment_id LIMIT 10)) AS m)",
    "missed_segments": "SELECT segment_id FROM exact WHERE segment_id NOT IN (SELECT segment_id FROM near50)",
    "legacy_chunk": "SELECT source_pdf, page_num, chunk_index, location, content FROM chunk",
    "legacy_append": "SELECT id, source_pdf, page_num, chunk_index FROM appended",
    "legacy_count": "SELECT count(*) AS chunks, coalesce(max(id), 0) AS max_id FROM appended",
    "legacy_search": "SELECT source_pdf, page_num, chunk_index, content, round(score, 6) AS score FROM (SELECT c.*, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) AS score FROM chunk AS c JOIN embeddings AS e ON c.source_uri = 'doc://' || e.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 3) AS q) ORDER BY round(score, 12) DESC, source_pdf, page_num, chunk_index LIMIT 5",
    "legacy_sources": "SELECT DISTINCT source_pdf FROM chunk",
    "migrate_sources": "SELECT DISTINCT sha256('migrated|file://' || source_pdf) AS id, 'migrated' AS namespace, 'file://' || source_pdf AS source_uri, 'legacy_' || replace(source_pdf, '/', '_') AS content_hash, source_pdf AS original_path FROM chunk",
    "migrate_segments": "SELECT id, sha256('migrated|' || uri) AS ir_id, segment_index, page_num AS page, chunk_index, location FROM moved",
    "migrate_entities": f"SELECT id AS segment_id, sha256('migrated|' || type || '|' || name) AS entity_id FROM ({_hits('moved', _CUSTOM)})",
    "latency_stats": "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_samp(value), 6) AS stdev, round(min(value), 6) AS least, round(max(value), 6) AS most, round(list_sort(list(value))[floor(count(value) * 0.95)::INT + 1], 6) AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "ann_topk_all_lists": "SELECT query_id, vec_id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(v.embedding::double[], q.embedding::double[]) AS score FROM embeddings AS v, embeddings AS q WHERE q.vec_id % 50 = 0)) WHERE rank <= 10",
    "ann_recall": "SELECT count(*) AS queries, true AS nine_tenths_found FROM embeddings WHERE vec_id % 50 = 0",
    "as_of_view": f"SELECT e.event_id, v.event_id AS view_id, v.value AS view_value FROM (SELECT * FROM events WHERE event_type <> 'view' OR event_type IS NULL) AS e ASOF LEFT JOIN {_VIEWS} AS v ON e.user_id = v.user_id AND e.ts >= v.ts",
    "as_of_view_within_hour": f"SELECT e.event_id, CASE WHEN e.ts - v.ts <= INTERVAL 1 HOUR THEN v.event_id END AS view_id FROM events AS e ASOF LEFT JOIN {_VIEWS} AS v ON e.user_id = v.user_id AND e.ts > v.ts",
    "span_join_clicks": "SELECT e.event_id, c.event_id AS click_id FROM events AS e JOIN events AS c ON e.user_id = c.user_id AND c.ts BETWEEN e.ts - INTERVAL 6 HOUR AND e.ts WHERE e.event_type = 'error' AND c.event_type = 'click'",
    "stream_tumbling": "SELECT event_type, epoch_us(ts) // 3600000000 * 3600 AS starts, epoch_us(ts) // 3600000000 * 3600 + 3600 AS ends, count(*) AS events, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "stream_sliding": "SELECT event_type, epoch_us(ts) // 7200000000 * 7200 - 7200 * k AS starts, epoch_us(ts) // 7200000000 * 7200 - 7200 * k + 21600 AS ends, count(*) AS events, round(sum(value), 4) AS total FROM events, range(0, 3) AS r(k) WHERE ts IS NOT NULL GROUP BY ALL",
    "stream_session": "SELECT user_id, epoch_us(min(ts)) // 1000000 AS starts, epoch_us(max(ts)) // 1000000 + 7200 AS ends, count(*) AS events, round(sum(value), 4) AS total FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL)) GROUP BY user_id, session",
    "retention_cascade": f"SELECT name, namespace, count(*) AS before, count(*) FILTER (NOT gone) AS after FROM ({_FATES}) GROUP BY name, namespace",
    "retention_in_store": f"SELECT name, count(*) FILTER (gone) AS first_run, 0::BIGINT AS second_run, count(*) FILTER (NOT gone) AS left_over FROM ({_FATES}) GROUP BY name",
    "distinct_rollup": "SELECT namespace, type, grouping(namespace, type)::INT AS level, count(DISTINCT id) AS segments, true AS near FROM hit GROUP BY ROLLUP (namespace, type)",
    "known_names": r"SELECT id AS segment_id, entity_id, count(*) AS times FROM (SELECT id, namespace, unnest(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '_', 'g'), '\w+')) AS form FROM seg) JOIN (SELECT id AS entity_id, namespace, name AS form FROM ent WHERE type IN ('token', 'tion') UNION SELECT id, namespace, alias FROM ent WHERE type IN ('token', 'tion')) USING (namespace, form) GROUP BY ALL",
    "custom_extractor_sql": f"SELECT id, type, name, 0.8::DOUBLE AS confidence FROM ({_hits('seg', {'token': _TOKEN})})",
    "metadata_filter": "SELECT event_id, (props ->> '$.k')::INT AS k FROM events WHERE (props ->> '$.k')::INT >= 50",
    "metadata_merge": "SELECT doc_id, lang, source, n_chars + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS n_chars, CASE WHEN doc_id % 2 = 0 THEN true END AS seen, CASE WHEN doc_id % 2 = 0 THEN 'b' END AS tag FROM documents",
    "dated_events": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || strftime(ts, '%f') END AS ts, event_type FROM events",
    "page_source": f"SELECT sha256({_NORM.format('text')}) AS text_hash, page, sentence, segment_index FROM page_seg",
}

ORACLES = {name: sql(body) for name, body in _BODIES.items()}
