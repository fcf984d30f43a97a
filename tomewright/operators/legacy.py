"""The older page, chunk and embedding model, and its migration to segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.text import normalize
from .segment import provenance

CHUNK_WORDS, OVERLAP_WORDS = 400, 50
#: Ranges of source names that are numbered on their own.
RANGES = 64


def chunk_pages(pages: DataFrame, size: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """pages (source_pdf, page_num, text) in windows of size words that share overlap words: content, chunk_index
    (from 0 on each page), location. A window that would hold only words of the one before is left out."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be 0 or more and less than size")
    step = size - overlap
    words = F.array_remove(F.split(normalize(F.col("text")), " "), "")
    last = F.greatest(F.ceil((F.size("w") - overlap) / step).cast("int") - 1, F.lit(0))
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice("w", i * step + 1, F.lit(size)), " "))
    rows = pages.select("source_pdf", "page_num", words.alias("w")).where(F.size("w") > 0)
    rows = rows.select("source_pdf", "page_num", F.posexplode(windows).alias("chunk_index", "content"))
    return rows.withColumn("location", F.concat(F.lit("page_"), F.col("page_num").cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string")))


def append_chunks(known: DataFrame, chunks: DataFrame) -> DataFrame:
    """known with chunks appended as numbered_chunks has them."""
    return known.unionByName(numbered_chunks(known, chunks))


def numbered_chunks(known: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunks (and embeddings, null where there are none) under ids that go on from known's largest. Numbers are dealt per source and added to the running total of the sources before: sources are cut into RANGES ranges of names, each
    summed in its own task, and only the ranges' totals meet in one place."""
    start = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("start"))
    per = chunks.groupBy("source_pdf").agg(F.count("*").alias("n"))
    # Names of the least hashes are an even sample, the same on every run; a name's range is the number of these before it.
    names = chunks.select("source_pdf").where("source_pdf is not null").distinct()
    cuts = sorted(r[0] for r in names.orderBy(F.xxhash64("source_pdf"), "source_pdf").limit(RANGES - 1).collect())
    past = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<string>"), lambda cut: cut <= F.col("source_pdf")))
    per = per.withColumn("range", F.when(F.col("source_pdf").isNull(), -1).otherwise(past))
    totals = per.groupBy("range").agg(F.sum("n").alias("total"))
    running = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("range", F.coalesce(F.sum("total").over(running), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("range").orderBy("source_pdf").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(totals, "range").select("source_pdf", (F.col("own") + F.col("earlier")).alias("before"))
    place = F.row_number().over(Window.partitionBy("source_pdf").orderBy("page_num", "chunk_index"))
    per = per.withColumnRenamed("source_pdf", "of")
    rows = chunks.withColumn("place", place).join(per, F.col("source_pdf").eqNullSafe(F.col("of"))).join(F.broadcast(start))
    return rows.select(*[(F.col("start") + F.col("before") + F.col("place")).cast("long").alias("id") if c == "id" else (F.col(c) if c in chunks.columns else F.lit(None).cast(known.schema[c].dataType).alias(c)) for c in known.columns])


def sources(chunks: DataFrame) -> DataFrame:
    return chunks.select("source_pdf").distinct().orderBy("source_pdf")


def migrate_sources(chunks: DataFrame, namespace: str | Column, hashes: DataFrame | None = None) -> DataFrame:
    """A resource per source. hashes (source_pdf, content_hash) has the files that still are; others get a placeholder."""
    ns = F.lit(namespace) if isinstance(namespace, str) else namespace
    rows = chunks.select("source_pdf", ns.alias("namespace")).distinct()
    known = hashes if hashes is not None else rows.select("source_pdf", F.lit(None).cast("string").alias("content_hash")).limit(0)
    rows = rows.join(known, "source_pdf", "left")
    uri = ids.file_uri(F.col("source_pdf"))
    meta = F.create_map(F.lit("migrated_from"), F.lit("legacy_chunks"), F.lit("original_path"), F.col("source_pdf"))
    return rows.select(ids.resource_id(F.col("namespace"), uri).alias("id"), "namespace", F.lit("pdf").alias("source_type"), uri.alias("source_uri"), F.coalesce("content_hash", ids.placeholder_hash(F.col("source_pdf"))).alias("content_hash"), meta.alias("metadata"))


def migrate_segments(chunks: DataFrame, namespace: str | Column) -> DataFrame:
    """A segment per chunk, in page and chunk order within its source."""
    ns = F.lit(namespace) if isinstance(namespace, str) else namespace
    order = Window.partitionBy("namespace", "source_pdf").orderBy("page_num", "chunk_index")
    rows = chunks.withColumn("namespace", ns).withColumn("segment_index", F.row_number().over(order) - 1)
    uri, text = ids.file_uri(F.col("source_pdf")), F.col("content")
    key = F.concat_ws(":", F.col("page_num").cast("string"), F.col("chunk_index").cast("string"))
    shape = provenance(page=F.col("page_num"), chunk_index=F.col("chunk_index"), location=F.col("location"), legacy=F.lit(True))
    return rows.select(ids.resource_id(F.col("namespace"), uri).alias("ir_id"), "namespace", uri.alias("source_uri"), "segment_index", text.alias("text"), shape.alias("provenance"), ids.segment_id(F.col("namespace"), uri, key, text).alias("id"), ids.text_hash(text).alias("text_hash"))
