"""Queries over the driver's tables, one or more for each operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids, metadata
from ..functions.text import preview, sentences
from ..functions.vectors import HashEmbedder, embed, rounded
from ..operators import ann, dictionary, legacy, link, order_stats, recall, retention, search, sketches, table_functions, temporal, upsert
from ..operators.extract import EntityExtractor, PatternSet, extract, extract_with
from ..operators.segment import segment_text
from ..schemas import PROVENANCE
from ..streaming import windows
from .fixtures import CUSTOM, DENSE, TABLES, Fixture, kept, scratch, write_each

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
NAMESPACE = "en"
#: Queries of a batch search that one pass over the vectors answers.
BATCH_QUERIES = 4_096


def query(f: Callable[[Fixture], DataFrame]) -> Callable[[Fixture], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Fixture(spark, sf_dir))
    return f


def edited(x: Fixture) -> DataFrame:
    """Documents as they are later: every seventh changed, the first ten gone, with new ids and hashes."""
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" x"))).otherwise(F.col("text"))
    return x.resources.where("doc_id >= 10").withColumn("text", text).withColumn("content_hash", ids.content_hash(F.col("text")))


def named(x: Fixture) -> DataFrame:
    """The entity with the most mentions of namespace en, as one row. Links to it are links of its namespace."""
    t = x.stored
    return recall.most_first(recall.mention_counts(t["entities"], _of(t["links"]), _of(t["segments"]), NAMESPACE)).limit(1)


def _of(table: DataFrame) -> DataFrame:
    """The rows of namespace en, whose files are the only ones read."""
    return table.where(F.col("namespace") == NAMESPACE)


def _recalled(x: Fixture, entity: DataFrame) -> DataFrame:
    """As the facade recalls: through the layout by entity."""
    found = entity.select("id").first()
    return recall.recalled(x.filled_store("mentions", "segments", "resources"), found["id"] if found else "", NAMESPACE)


def _first_name(x: Fixture, alias: bool = False) -> str:
    """The first name in order among namespace en's entities of type token, or its alias."""
    row = _of(x.stored["entities"]).where("type = 'token'").orderBy("name").select("name").first()
    return (row[0].lower() if alias else row[0]) if row else ""


# Resources


@query
def register_resources(x):
    return x.bare_resources.select("id", "namespace", "source_uri", "content_hash")


@query
def lookup_resource_by_id(x):
    return recall.by_id(x.stored["resources"], _resource(x)).select("id", "namespace", "source_uri")


def _resource(x: Fixture) -> str:
    import hashlib

    lang = x.table("documents").where("doc_id = 5").select("lang").first()[0]
    return hashlib.sha256(f"{lang}|doc://5".encode()).hexdigest()


@query
def lookup_resource_by_uri(x):
    return recall.resource_by_uri(x.stored["resources"], NAMESPACE, "doc://2").select("id", "namespace", "source_uri")


@query
def list_sources(x):
    return recall.list_resources(x.stored["resources"], NAMESPACE).select("id", "source_uri", "source_type", "content_hash")


@query
def detect_changed(x):
    rows = upsert.resource_changes(x.bare_resources.where(~F.col("source_uri").like("%9")), edited(x).select("namespace", "source_uri", "content_hash"))
    return rows.select("namespace", "source_uri", "status")


@query
def upsert_resources(x):
    later = edited(x).drop("text", "doc_id").withColumn("created_at", F.lit(-1).cast("long")).withColumn("source_type", F.lit("other"))
    return upsert.upsert(x.bare_resources, later, ["namespace", "source_uri"], upsert.UPDATED["resources"]).select("id", "source_type", "content_hash", "created_at")


# Segments


@query
def split_sentences(x):
    return x.resources.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))


@query
def normalize_text(x):
    return x.resources.select("doc_id", ids.text_hash(F.col("text")).alias("text_hash"))


@query
def segment_texts(x):
    return x.segments.select("id", "namespace", "source_uri", "segment_index", F.col("provenance.sentence").alias("sentence"), F.col("provenance.sentence_count").alias("sentence_count"), "text", "text_hash")


@query
def segment_ids(x):
    return x.segments.select("id", "ir_id")


@query
def segment_pages(x):
    return x.page_segments.select("id", "source_uri", "segment_index", F.col("provenance.page").alias("page"), F.col("provenance.sentence").alias("sentence"), "text")


@query
def segment_markdown(x):
    return x.markdown_segments().select("id", "source_uri", F.col("provenance.heading_path").alias("heading"), F.col("provenance.para").alias("para"), F.col("provenance.sentence").alias("sentence"), "text")


@query
def segment_markdown_index(x):
    both = x.markdown_segments().select("id", "segment_index").join(x.markdown_segments(dense=True).select("id", F.col("segment_index").alias("dense_index")), "id")
    return both


@query
def provenance_keys(x):
    """Each document's own values as a provenance of one of seven shapes."""
    d, n = F.col("doc_id").cast("string"), F.col("n_chars").cast("string")
    shapes = [{"page": d, "sentence": n}, {"heading_path": F.col("lang"), "para": d, "sentence": n}, {"heading_path": F.col("lang")}, {"line": d}, {"table": F.col("source"), "row": d}, {"table": F.col("source"), "row": d, "col": F.col("lang")}, {"sentence": n, "b": d}]
    shape = F.col("doc_id") % len(shapes)
    given = F.coalesce(*[F.when(shape == i, F.create_map(*[v if isinstance(v, Column) else F.lit(v) for kv in s.items() for v in kv])) for i, s in enumerate(shapes)])
    return x.table("documents").select("doc_id", ids.provenance_key(given).alias("key"))


@query
def provenance_roundtrip(x):
    back = F.from_json(F.to_json("provenance"), PROVENANCE)
    return x.page_segments.select("id", back.alias("p")).select("id", "p.page", "p.sentence", "p.sentence_count", "p.heading_path")


@query
def segment_preview(x):
    return x.segments.select("id", preview(F.col("text")).alias("preview"), F.substring("id", 1, 8).alias("short_id"))


@query
def lookup_segment_by_id(x):
    return x.stored["segments"].join(x.stored["segments"].agg(F.min("id").alias("id")), "id", "left_semi").select("id", "segment_index", "text")


@query
def duplicate_text(x):
    rows = x.stored["segments"].groupBy("text_hash").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))
    return rows.where("copies > 1")


@query
def upsert_segments(x):
    """Later segments come with another index, which stays, and another shape, which is taken over."""
    later = segment_text(edited(x).select(F.col("id").alias("ir_id"), "namespace", "source_uri", "text")).withColumn("segment_index", F.lit(-1))
    later = later.withColumn("provenance", F.col("provenance").withField("para", F.lit(7)))
    rows = upsert.upsert(x.segments, later, ["id"], upsert.UPDATED["segments"])
    return rows.select("id", "segment_index", "text_hash", F.col("provenance.sentence").alias("sentence"), F.col("provenance.para").alias("para"))


@query
def idempotent_reingest(x):
    once = x.segments
    twice = upsert.upsert(once, once, ["id"], upsert.UPDATED["segments"])
    digest = F.bit_xor(F.xxhash64(*[F.col(c) for c in ("id", "ir_id", "segment_index", "text", "text_hash")], F.to_json("provenance"))).alias("digest")
    count = lambda df: df.agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"), digest)
    runs = count(once).withColumn("run", F.lit(1)).unionByName(count(twice).withColumn("run", F.lit(2)))
    return runs.withColumn("same", F.min("digest").over(Window.partitionBy()) == F.max("digest").over(Window.partitionBy())).drop("digest")


@query
def stale_segments(x):
    later = segment_text(edited(x).select(F.col("id").alias("ir_id"), "namespace", "source_uri", "text"))
    return upsert.stale_segments(x.segments, later).select("id", "source_uri")


# Entities and links


def _hits(x: Fixture, patterns: PatternSet) -> DataFrame:
    return x.hits(patterns).select("id", "type", "name")


@query
def extract_entities(x):
    return _hits(x, PatternSet())


@query
def extract_raw_documents(x):
    return extract(x.resources.select("doc_id", "text"), PatternSet()).select("doc_id", "type", "name")


@query
def extract_custom_patterns(x):
    return _hits(x, CUSTOM)


@query
def extract_case_insensitive(x):
    return _hits(x, PatternSet((("tion", r"\b[a-z]{2,6}tion\b"),), case_sensitive=False))


@query
def extract_edited_patterns(x):
    return _hits(x, DENSE.remove("strain").add("token", r"\b[A-Z][a-z]{6,7}\b"))


@query
def extract_fixed_texts(x):
    """Every document with a passage of its own that has hits of all seven default types."""
    d = F.col("doc_id").cast("string")
    own = F.concat(F.lit("The CCNA001 strain and BRCA"), (F.col("doc_id") % 100).cast("string"), F.lit("; mail r"), d, F.lit("@example.com. See 10.1234/abc.D-"), d, F.lit(" and PMID: "), F.lpad(d, 8, "1"), F.lit(", also AB1"), F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0"), F.lit("."))
    texts = x.table("documents").select("doc_id", F.concat_ws(" ", "text", own).alias("text"))
    return extract(texts, PatternSet()).select("doc_id", "type", "name", F.round("confidence", 6).alias("confidence"))


@query
def entity_confidence(x):
    rows = x.hits().select("type", "name", "confidence").distinct()
    return rows.select("type", "name", F.round("confidence", 6).alias("confidence"))


@query
def min_confidence_filter(x):
    return _hits(x, PatternSet(DENSE.patterns, min_confidence=0.8))


class Capitals(EntityExtractor):
    """A custom extractor, equal to the pattern 'token'."""

    def extract(self, text):
        import re

        return [("token", name, 0.8) for name in dict.fromkeys(re.findall(r"\b[A-Z][a-z]{4,7}\b", text))]


@query
def custom_extractor(x):
    return extract_with(x.segments.select("id", "text"), Capitals()).select("id", "type", "name")


@query
def resolve_entities(x):
    return link.entities_of(x.hits()).select("id", "namespace", "type", "name")


@query
def entity_json(x):
    """Entities with aliases and metadata as JSON, and read back from it."""
    written = ids.to_json_fields(x.stored["entities"], "aliases", "metadata")
    back = ids.from_json_fields(written, x.stored["entities"].schema)
    return written.join(back.select("id", F.size("aliases").alias("n_aliases"), F.size("metadata").alias("n_metadata")), "id").select("id", "aliases_json", "metadata_json", "n_aliases", "n_metadata")


@query
def link_entities(x):
    return x.links.select("segment_id", "entity_id", "link_type", F.round(F.col("confidence").cast("double"), 6).alias("confidence"))


@query
def new_entities(x):
    known = link.entities_of(x.hits(CUSTOM.remove("tion")))
    return link.new_entities(x.hits(), known).select("id", "type", "name")


@query
def lookup_entity_by_id(x):
    return x.stored["entities"].join(x.stored["entities"].agg(F.max("id").alias("id")), "id", "left_semi").select("id", "type", "name")


@query
def lookup_entity_typed(x):
    return recall.resolve_entity(x.stored["entities"], "Thtion", NAMESPACE, "token").select("id", "type", "name")


@query
def lookup_entity_untyped(x):
    return recall.resolve_entity(x.stored["entities"], _first_name(x), NAMESPACE).select("id", "type", "name")


@query
def lookup_entity_alias(x):
    return recall.resolve_entity(x.stored["entities"], _first_name(x, alias=True), NAMESPACE).select("id", "type", "name")


@query
def list_entities_by_type(x):
    return recall.list_entities(x.stored["entities"], NAMESPACE, "tion").select("id", "type", "name")


@query
def entity_mention_counts(x):
    return recall.mention_counts(x.stored["entities"], x.stored["links"], x.stored["segments"]).select("namespace", "type", "name", "mention_count")


@query
def entity_mention_counts_min2(x):
    return recall.mention_counts(x.stored["entities"], x.stored["links"], x.stored["segments"], NAMESPACE, "token", 2).select("type", "name", "mention_count")


@query
def entity_mention_counts_min0(x):
    """With an entity for each namespace that no segment mentions."""
    t = x.stored
    lone = t["entities"].select("namespace").distinct().select(F.lit("none").alias("id"), "namespace", F.lit("token").alias("type"), F.lit("Unmentioned").alias("name"))
    known = t["entities"].select("id", "namespace", "type", "name").unionByName(lone)
    return recall.mention_counts(known, t["links"], t["segments"], least=0).select("namespace", "type", "name", "mention_count")


@query
def upsert_entities(x):
    known = link.entities_of(x.hits(CUSTOM))
    return upsert.upsert(known, x.entities.where("type <> 'tion'"), ["namespace", "type", "name"], upsert.UPDATED["entities"]).select("id", "name", F.concat_ws(",", "aliases").alias("aliases"))


@query
def upsert_links(x):
    known = kept(x.links.drop("namespace", "ir_id")).withColumn("created_at", F.lit(1))
    later = known.where(F.col("entity_id") < "8").select("segment_id", "entity_id", "link_type", (F.col("confidence") * 0).cast("float").alias("confidence"), F.lit(2).alias("created_at"))
    both = later.unionByName(later.withColumns({"confidence": F.lit(0.5).cast("float"), "created_at": F.lit(3)}))
    rows = upsert.upsert(known, both, ["segment_id", "entity_id", "link_type"], upsert.UPDATED["links"], F.col("created_at"))
    return rows.select("segment_id", "entity_id", "created_at", F.round(F.col("confidence").cast("double"), 6).alias("confidence"))


# Recall


@query
def exact_recall(x):
    rows = _recalled(x, named(x))
    return rows.select("segment_id", "text", "source_uri", "link_type", F.round(F.col("confidence").cast("double"), 6).alias("confidence"))


@query
def exact_recall_by_name(x):
    return _recalled(x, recall.resolve_entity(x.stored["entities"], _first_name(x), NAMESPACE)).select("segment_id", "entity_id", "source_uri")


@query
def exact_recall_unknown(x):
    return _recalled(x, recall.resolve_entity(x.stored["entities"], "NONEXISTENT999", NAMESPACE)).select("segment_id", "entity_id", "source_uri")


@query
def entities_for_segment(x):
    return recall.entities_for_segment(x.stored["links"], x.stored["entities"]).select("segment_id", "entity_id", "type", "name")


@query
def segments_for_source(x):
    return recall.segments_for_source(x.stored["segments"], x.stored["resources"], NAMESPACE, "doc://2").select(F.col("id").alias("segment_id"), "text", "source_uri", "segment_index")


def _lost(x: Fixture) -> tuple[DataFrame, str]:
    """Resources less one, and its id."""
    gone = _resource(x)
    return x.stored["resources"].where(F.col("id") != gone), gone


@query
def segments_of_resource(x):
    t = x.stored
    return recall.segments_of_resource(t["segments"], t["resources"], _resource(x)).select(F.col("id").alias("segment_id"), "text", "source_uri", "segment_index")


@query
def segments_of_missing_resource(x):
    resources, gone = _lost(x)
    return recall.segments_of_resource(x.stored["segments"], resources, gone).select(F.col("id").alias("segment_id"), "text", "source_uri", "segment_index")


@query
def count_segments(x):
    return recall.count_segments(x.stored["segments"], x.stored["resources"])


@query
def count_segments_by_namespace(x):
    return recall.count_segments(x.stored["segments"], x.stored["resources"], NAMESPACE)


@query
def kb_stats(x):
    return recall.stats(x.stored["resources"], x.stored["segments"], x.stored["entities"])


@query
def namespace_isolation(x):
    owner = x.stored["segments"].select(F.col("id").alias("segment_id"), F.col("namespace").alias("ns"))
    rows = x.stored["links"].drop("namespace").join(owner, "segment_id").join(x.stored["entities"].select(F.col("id").alias("entity_id"), "namespace"), "entity_id")
    return rows.agg(F.count(F.when(F.col("ns") != F.col("namespace"), 1)).alias("crossing"), F.count("*").alias("links"))


# Vectors


def _beside(vectors: DataFrame, segments: DataFrame, by: list[str]) -> DataFrame:
    """The best of all vectors beside the best of those that segments have, by rank."""
    on = [F.col(f"v.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by]
    rows = vectors.withColumnRenamed("score", "vec_score").alias("v").join(segments.alias("s"), on, "full_outer")
    found = [F.coalesce(f"v.{c}", f"s.{c}").alias(c) for c in by]
    return rows.select(*found, "vec_id", F.round("vec_score", 6).alias("vec_score"), "segment_id", F.round("score", 6).alias("score"))


@query
def semantic_topk(x):
    """The ten best of all vectors, with or without a segment, and the ten best segments."""

    def ranked(best: DataFrame, id: str) -> DataFrame:
        return best.select(id, "score", F.row_number().over(Window.orderBy(F.desc("score"), F.asc(id))).alias("rank"))

    vectors = search.top_k(x.table("embeddings"), x.query_vector(0), 10, "embedding", "vec_id")
    return _beside(ranked(vectors, "vec_id"), ranked(search.top_k(x.stored["embeddings"], x.query_vector(0), 10), "segment_id"), ["rank"])


@query
def semantic_topk_namespace(x):
    t = x.stored
    rows = search.search(t["embeddings"], t["segments"], t["resources"], x.query_vector(0), 5, NAMESPACE)
    return rows.select("segment_id", "text", "source_uri", "namespace", F.round("score", 6).alias("score"))


@query
def semantic_topk_batch(x):
    """Every vector whose id is divisible by 50 against all, with or without a segment, and against those of all segments, in blocks of
    BATCH_QUERIES a pass."""
    vectors, of_segments = x.table("embeddings"), x.stored["embeddings"]
    rows = vectors.where("vec_id % 50 = 0 and embedding is not null").orderBy("vec_id").toLocalIterator()
    best, best_segments = [], []
    while block := {r["vec_id"]: r["embedding"] for r in islice(rows, BATCH_QUERIES)}:
        best.append(search.top_k_batch(vectors, block, 5, "embedding", "vec_id"))
        best_segments.append(search.top_k_batch(of_segments, block, 5))
    if not best:
        none = "query_id long, vec_id long, vec_score double, segment_id string, score double, rank int"
        return x.spark.createDataFrame([], none)
    return _beside(reduce(DataFrame.unionByName, best), reduce(DataFrame.unionByName, best_segments), ["query_id", "rank"])


@query
def embedding_lookup(x):
    return x.embeddings.where("vec_id = 7").select("segment_id", "model", F.size("vector").alias("size"), rounded(F.element_at("vector", 1).cast("double"), 6).alias("first"))


@query
def missing_embeddings(x):
    return upsert.missing_embeddings(x.stored["segments"], x.stored["embeddings"]).select("id", "segment_index")


@query
def upsert_embeddings(x):
    """Vectors of some segments come again with the signs of all their elements changed."""
    known = x.embeddings.select("segment_id", "model", "vector")
    turned = F.transform("vector", lambda v: -v)
    later = known.where(F.col("segment_id") < "8").withColumns({"model": F.lit("later"), "vector": turned})
    rows = upsert.upsert(known, later, ["segment_id"], upsert.UPDATED["embeddings"][:2])
    return rows.select("segment_id", "model", F.transform("vector", lambda v: rounded(v.cast("double"), 6)).alias("vector"))


@query
def embed_hash(x):
    rows = embed(x.segments.select("id", "text"), HashEmbedder(64))
    return rows.select("id", F.transform("vector", lambda v: F.round(v.cast("double"), 4)).alias("vector"))


def _compared(x: Fixture) -> tuple[DataFrame, DataFrame]:
    t = x.stored
    exact = _recalled(x, named(x)).select("segment_id")
    semantic = search.search(t["embeddings"], t["segments"], t["resources"], x.query_vector(0), 50, NAMESPACE).select("segment_id")
    return exact, semantic


@query
def compare_exact_vs_semantic(x):
    rows = recall.compare(*_compared(x), "top")
    return rows.select("entity_name", "exact_count", "semantic_count", "overlap_count", "missed_by_semantic_count", "false_positive_count", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"), F.concat_ws(",", "missed_segments").alias("missed_segments"))


@query
def missed_segments(x):
    exact, semantic = _compared(x)
    return exact.distinct().join(semantic, "segment_id", "left_anti")


# Older model


@query
def legacy_chunk(x):
    return x.chunks.select("source_pdf", "page_num", "chunk_index", "location", "content")


def _legacy(x: Fixture) -> DataFrame:
    """Every chunk, in two batches: the sources of en, then all others, null ones included."""
    empty = x.chunks.select(F.lit(0).cast("long").alias("id"), "source_pdf", "page_num", "chunk_index", "location", "content").limit(0)
    first = F.coalesce(F.col("source_pdf").like("/data/en/%"), F.lit(False))
    return legacy.append_chunks(legacy.append_chunks(empty, x.chunks.where(first)), x.chunks.where(~first))


@query
def legacy_append(x):
    return _legacy(x).select("id", "source_pdf", "page_num", "chunk_index")


@query
def legacy_count(x):
    return _legacy(x).agg(F.count("*").alias("chunks"), F.coalesce(F.max("id"), F.lit(0).cast("long")).alias("max_id"))


@query
def legacy_search(x):
    """All chunks of documents with a vector; a document's chunks share it, so the first of them lead."""
    vectors = x.table("embeddings").select(F.concat(F.lit("doc://"), F.col("vec_id").cast("string")).alias("source_uri"), F.col("embedding").alias("vector"))
    uri = F.concat(F.lit("doc://"), F.regexp_extract("source_pdf", r"/(\d+)\.pdf$", 1))
    place = F.concat_ws("|", "source_pdf", F.lpad(F.col("page_num").cast("string"), 9, "0"), F.lpad(F.col("chunk_index").cast("string"), 9, "0"))
    chunks = x.chunks.withColumns({"source_uri": uri, "place": place})
    best = search.top_k(chunks.join(vectors, "source_uri"), x.query_vector(3), 5, id="place")
    return best.select("source_pdf", "page_num", "chunk_index", "content", F.round("score", 6).alias("score"))


@query
def legacy_sources(x):
    return legacy.sources(x.chunks)


@query
def migrate_sources(x):
    return legacy.migrate_sources(x.chunks, "migrated").select("id", "namespace", "source_uri", "content_hash", F.element_at("metadata", "original_path").alias("original_path"))


@query
def migrate_segments(x):
    return legacy.migrate_segments(x.chunks, "migrated").select("id", "ir_id", "segment_index", F.col("provenance.page").alias("page"), F.col("provenance.chunk_index").alias("chunk_index"), F.col("provenance.location").alias("location"))


@query
def migrate_entities(x):
    rows = extract(legacy.migrate_segments(x.chunks, "migrated").select("id", "namespace", "text"), CUSTOM)
    return link.links_of(rows).select("segment_id", "entity_id")


# Others


@query
def latency_stats(x):
    """The 95th is the value at place floor(0.95 n) of the sorted values; it and the median are found by counts of value cells, so no task
    sorts a whole type."""
    rows = x.table("events").where("value is not null")
    stats = rows.groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("stdev"), F.min("value").alias("least"), F.max("value").alias("most"))
    places = {"below": lambda n: F.floor((n - 1) / 2), "above": lambda n: F.floor(n / 2), "p95": lambda n: F.least(F.floor(n * 0.95), n - 1)}
    found = order_stats.order_statistics(rows, "event_type", "value", places).withColumn("median", (F.col("below") + F.col("above")) / 2).withColumnRenamed("event_type", "of")
    both = stats.join(found, F.col("event_type").eqNullSafe(F.col("of")))
    return both.select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "median", "stdev", "least", "most", "p95")])


@query
def ingest_directory(x):
    """Documents as text files, a file each, taken in through the facade and read back from its store."""
    from ..api import KnowledgeBase

    folder = f"{scratch(x.spark)}/files-{uuid.uuid4().hex}"
    write_each(x.table("documents").where("text is not null"), f"{folder}/in")
    base = KnowledgeBase(x.spark, f"{folder}/kb", namespace="files")
    base.ingest_directory(f"{folder}/in", "*.txt")
    return base.tables()["segments"].select("text_hash", "segment_index")


@query
def stream_ingest(x):
    """Documents as a file stream into a store of its own, read back: the same segments as segment_ids."""
    from ..sources.store import TableStore
    from ..streaming.ingest import text_stream_to_segments

    folder = f"{scratch(x.spark)}/stream-{uuid.uuid4().hex}"
    rows = x.stream("documents").select(F.col("lang").alias("namespace"), F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("source_uri"), "text")
    store = TableStore(x.spark, f"{folder}/store")
    text_stream_to_segments(rows, store, f"{folder}/checkpoint").awaitTermination()
    return store.read("segments").select("id", "ir_id")


# Vector index


def _index(x: Fixture) -> tuple[ann.VectorIndex, DataFrame]:
    """All vectors of the table in an index, and those whose id is divisible by 50 as queries."""
    vectors = x.table("embeddings")
    index = ann.VectorIndex.build(vectors, f"{scratch(x.spark)}/index-{uuid.uuid4().hex}", "vec_id", "embedding")
    return index, vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query
def ann_topk_all_lists(x):
    """With every list probed the index gives the exact answer."""
    index, queries = _index(x)
    found = index.search(queries, 10, probes=index.lists)
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query
def ann_recall(x):
    """As many lists probed as building found to do: queries, and whether nine tenths of their ten best vectors were found."""
    index, queries = _index(x)
    exact = index.search(queries, 10, probes=index.lists).select("query_id", "id")
    found = index.search(queries, 10).select("query_id", "id", F.lit(1).alias("there"))
    rows = exact.join(found, ["query_id", "id"], "left")
    return rows.agg(F.countDistinct("query_id").alias("queries"), (F.count("there") >= 0.9 * F.count("*")).alias("nine_tenths_found"))


# Along time


@query
def as_of_view(x):
    """Each purchase-like event (all but views) with the user's last view before it or at its time."""
    events = x.table("events")
    views = events.where("event_type = 'view'").select("user_id", "ts", "event_id", "value")
    rows = temporal.as_of_join(events.where("event_type <> 'view' or event_type is null").select("event_id", "user_id", "ts"), views, ["user_id"], tie="event_id", cell_rows=2000)
    return rows.select("event_id", F.col("met.event_id").alias("view_id"), F.col("met.value").alias("view_value"))


@query
def as_of_view_within_hour(x):
    """As as_of_view, strictly earlier views of the last hour only."""
    events = x.table("events")
    views = events.where("event_type = 'view'").select("user_id", "ts", "event_id")
    rows = temporal.as_of_join(events.select("event_id", "user_id", "ts"), views, ["user_id"], tie="event_id", tolerance=3600, strict=True)
    return rows.select("event_id", F.col("met.event_id").alias("view_id"))


@query
def span_join_clicks(x):
    """Each error with the user's clicks of the six hours before it."""
    events = x.table("events")
    of = lambda kind: events.where(F.col("event_type") == kind).select("event_id", "user_id", "ts")
    pairs = temporal.span_join(of("error"), of("click"), ["user_id"], 6 * 3600, salts=2)
    return pairs.select("event_id", F.col("met.event_id").alias("click_id"))


def _windowed(x: Fixture, by: list[str], span) -> DataFrame:
    """The events table as a stream, its windows written as they close; the input's end closes the last."""
    folder = f"{scratch(x.spark)}/windows-{uuid.uuid4().hex}"
    schema = x.table("events").schema
    stream = lambda: windows.closing(x.stream("events"), f"{folder}/end")
    run = lambda: windows.write(windows.totals(stream(), by, span(), "1 hour"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    run()
    windows.close(x.spark, schema, f"{folder}/end")
    run()
    rows = x.spark.read.parquet(f"{folder}/out")
    return rows.withColumn("total", F.round("total", 4))


@query
def stream_tumbling(x):
    return _windowed(x, ["event_type"], lambda: windows.tumbling("1 hour"))


@query
def stream_sliding(x):
    return _windowed(x, ["event_type"], lambda: windows.sliding("6 hours", "2 hours"))


@query
def stream_session(x):
    return _windowed(x, ["user_id"], lambda: windows.session("2 hours"))


# Retention


def _gone(resources: DataFrame) -> DataFrame:
    """Resources to be deleted: those whose uri ends in 3, and all of namespace de."""
    return resources.where("source_uri like '%3' or namespace = 'de'")


@query
def retention_cascade(x):
    """Rows of each table and namespace before and after resources are deleted with all that comes of them."""
    t = x.stored
    kept = retention.survivors(t, _gone(t["resources"]))
    parts = []
    for name in ("resources", "segments", "links", "embeddings", "entities"):
        before, after = (df.groupBy("namespace").agg(F.count("*").alias(c)) for df, c in ((t[name], "before"), (kept[name], "after")))
        parts.append(before.join(after, "namespace", "left").select(F.lit(name).alias("name"), "namespace", "before", F.coalesce("after", F.lit(0).cast("long")).alias("after")))
    return reduce(DataFrame.unionByName, parts)


@query
def retention_in_store(x):
    """The same deletion in a store of its own, run twice: what went each time, and what is left."""
    from ..sources.store import TableStore

    store = TableStore(x.spark, f"{scratch(x.spark)}/retention-{uuid.uuid4().hex}", buckets=4)
    x.fill(store, [n for n in TABLES if n != "sketches"])  # deletion takes nothing from them
    gone = _gone(store.read("resources"))
    runs = [retention.delete_resources(store, gone) for _ in range(2)]
    left = {name: store.read(name).count() for name in runs[0]}
    rows = [(name, *(r[name] for r in runs), left[name]) for name in runs[0]]
    return x.spark.createDataFrame(rows, "name string, first_run long, second_run long, left_over long")


# Sketches, known names, table functions, metadata


@query
def distinct_rollup(x):
    """Segments with an entity by namespace and type, and rolled up: the exact count, and whether the stored states' estimate is near it."""
    t = x.stored
    about = sketches.rolled_up(t["sketches"]).select(F.col("namespace").alias("_ns"), F.col("type").alias("_type"), F.col("level").alias("_level"), F.col("segments").alias("estimate"))
    real = sketches.exact(t["links"], t["entities"])
    same = real["namespace"].eqNullSafe(about["_ns"]) & real["type"].eqNullSafe(about["_type"]) & (real["level"] == about["_level"])
    near = F.abs(F.col("estimate") - F.col("segments")) <= F.greatest(F.lit(1.0), F.col("segments") * sketches.ERROR)
    return real.join(about, same, "left").select("namespace", "type", "level", "segments", F.coalesce(near, F.lit(False)).alias("near"))


@query
def known_names(x):
    """Where the names and aliases of all tokens and -tion words of a namespace stand in its segments."""
    t = x.stored
    return dictionary.known_names(t["segments"], t["entities"].where("type in ('token', 'tion')")).select(F.col("id").alias("segment_id"), "entity_id", "times")


@query
def custom_extractor_sql(x):
    """custom_extractor, called by SQL as a table function."""
    table_functions.register(x.spark, "capitals", Capitals())
    return x.spark.sql("SELECT s.id, e.type, e.name, round(e.confidence, 6) AS confidence FROM {segments} AS s, LATERAL capitals(s.text, 'confidence') AS e", segments=x.segments.select("id", "text"))


@query
def metadata_filter(x):
    """Events whose properties have a k of 50 or more."""
    k = metadata.at(metadata.parsed(F.col("props")), "$.k", "int")
    return x.table("events").select("event_id", k.alias("k")).where("k >= 50")


@query
def metadata_merge(x):
    """Documents' metadata, with later values for every second one merged in key by key, read back by paths."""
    old = metadata.parsed(F.to_json(F.struct("lang", "source", "n_chars")))
    later = F.concat(F.lit('{"n_chars": '), (F.col("n_chars") + 1).cast("string"), F.lit(', "seen": true, "tags": ["a", "b"]}'))
    both = metadata.merged(old, metadata.parsed(F.when(F.col("doc_id") % 2 == 0, later)))
    rows = x.table("documents").select("doc_id", both.alias("m"))
    paths = {"lang": "string", "source": "string", "n_chars": "bigint", "seen": "boolean"}
    return rows.select("doc_id", *[metadata.at(F.col("m"), f"$.{p}", kind).alias(p) for p, kind in paths.items()], metadata.at(F.col("m"), "$.tags[1]", "string").alias("tag"))


@query
def dated_events(x):
    return metadata.dated(x.table("events").select("event_id", "ts", "event_type"))


@query
def page_source(x):
    """Documents as paged files, a file each, read by ranges of pages and cut into segments: the segments of segment_pages."""
    from ..operators.segment import keep_pages
    from ..operators.segment import segment_pages as cut
    from ..sources.pages import read_pages

    folder = f"{scratch(x.spark)}/pages-{uuid.uuid4().hex}"
    of = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "text"))), lambda p: p["text"]), "\f")
    files = x.pages.where("not contains(text, chr(12))").groupBy("ir_id").agg(of.alias("text")).select("text")
    write_each(files, folder)
    rows = cut(keep_pages(read_pages(x.spark, folder, "pages", "*.txt", task_bytes=65536).drop("error")))
    return rows.select("text_hash", F.col("provenance.page").alias("page"), F.col("provenance.sentence").alias("sentence"), "segment_index")
