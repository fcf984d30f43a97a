"""Segmenters: texts, pages and Markdown into batches of sentences with provenance and content ids.

All are projections of one row and an explode; only page segments, numbered over all pages of a resource, shuffle by the resource.
Input: ir_id, namespace, source_uri and text (pages: and page_num). A null text has no segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.text import batches, sentences, trim_space, unix_lines
from ..schemas import PROVENANCE

DEFAULT_SENTENCES = 3
#: Pages of fewer characters are dropped.
LEAST_PAGE = 50
CARRIED = ["ir_id", "namespace", "source_uri"]


def provenance(**fields: Column) -> Column:
    """The provenance struct, null in the fields that aren't given."""
    return F.struct(*[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PROVENANCE.fields])


def _finished(df: DataFrame, key: Column, shape: Column) -> DataFrame:
    uri, namespace, text = F.col("source_uri"), F.col("namespace"), F.col("text")
    return df.select(*CARRIED, "segment_index", "text", shape.alias("provenance"), ids.segment_id(namespace, uri, key, text).alias("id"), ids.text_hash(text).alias("text_hash"))


def segment_text(df: DataFrame, per_segment: int = DEFAULT_SENTENCES) -> DataFrame:
    rows = df.select(*CARRIED, sentences(F.col("text")).alias("s")).select(*CARRIED, F.posexplode(batches(F.col("s"), per_segment)).alias("segment_index", "b"))
    rows = rows.select(*CARRIED, "segment_index", "b.text", "b.sentence", "b.sentence_count")
    return _finished(rows, F.col("sentence").cast("string"), provenance(sentence=F.col("sentence"), sentence_count=F.col("sentence_count")))


def keep_pages(pages: DataFrame, least: int = LEAST_PAGE) -> DataFrame:
    return pages.where(F.length("text") >= least)


def segment_pages(pages: DataFrame, per_segment: int = DEFAULT_SENTENCES) -> DataFrame:
    rows = pages.select(*CARRIED, "page_num", sentences(F.col("text")).alias("s")).select(*CARRIED, "page_num", F.explode(batches(F.col("s"), per_segment)).alias("b"))
    rows = rows.select(*CARRIED, "page_num", "b.text", "b.sentence", "b.sentence_count")
    order = Window.partitionBy("namespace", "source_uri").orderBy("page_num", "sentence")
    rows = rows.withColumn("segment_index", F.row_number().over(order) - 1)
    key = F.concat_ws(":", F.col("page_num").cast("string"), F.col("sentence").cast("string"))
    return _finished(rows, key, provenance(page=F.col("page_num"), sentence=F.col("sentence"), sentence_count=F.col("sentence_count")))


def markdown_sections(text: Column) -> Column:
    """Array of (heading, lines): a line that starts with # opens a section under its title, text before the
    first is 'root'; sections without a line that shows anything are left out."""

    def section(s: Column) -> Column:
        lines, headed = F.split(s, "\n", -1), s.startswith("#")
        title = trim_space(F.regexp_replace(F.element_at(lines, 1), "^#+", ""))
        body = F.when(headed, F.slice(lines, F.lit(2), F.size(lines))).otherwise(lines)
        return F.struct(F.when(headed, title).otherwise("root").alias("heading"), F.filter(body, lambda line: trim_space(line) != "").alias("lines"))

    return F.filter(F.transform(F.split(unix_lines(text), "\n(?=#)", -1), section), lambda s: F.size(s["lines"]) > 0)


def segment_markdown(df: DataFrame, per_segment: int = DEFAULT_SENTENCES, dense: bool = False) -> DataFrame:
    """Index of a section's first segment: the sum, over the sections before it, of the segments made up to each; so
    indices grow with gaps. dense counts segments instead. The fold copies an array of numbers at each heading; that stays below the cost of
    shuffling the texts, which a running sum over rows would take, up to some 100,000 headings in one text."""
    parts = df.select(*CARRIED, markdown_sections(F.col("text")).alias("sections"))
    parts = parts.select(*CARRIED, F.transform("sections", lambda s: F.struct(s["heading"].alias("heading"), sentences(F.array_join(s["lines"], " ")).alias("s"))).alias("sections"))
    counts = F.transform("sections", lambda s: F.ceil(F.size(s["s"]) / per_segment).cast("int"))
    zero = F.struct(F.lit(0).alias("made"), F.lit(0).alias("start"), F.array().cast("array<int>").alias("starts"))

    def step(at: Column, n: Column) -> Column:
        made = at["made"] + n
        following = made if dense else at["start"] + made
        return F.struct(made.alias("made"), following.alias("start"), F.concat(at["starts"], F.array(at["start"])).alias("starts"))

    parts = parts.withColumn("starts", F.aggregate(counts, zero, step)["starts"])
    rows = parts.select(*CARRIED, "starts", F.posexplode("sections").alias("para", "section"))
    rows = rows.select(*CARRIED, "para", F.col("section.heading").alias("heading"), F.get("starts", "para").alias("start"), F.col("section.s").alias("s"))
    rows = rows.select(*CARRIED, "para", "heading", "start", F.posexplode(batches(F.col("s"), per_segment)).alias("i", "b"))
    rows = rows.select(*CARRIED, "para", "heading", (F.col("start") + F.col("i")).alias("segment_index"), "b.text", "b.sentence", "b.sentence_count")
    key = F.concat_ws(":", "heading", F.col("para").cast("string"), F.col("sentence").cast("string"))
    return _finished(rows, key, provenance(heading_path=F.col("heading"), para=F.col("para"), sentence=F.col("sentence"), sentence_count=F.col("sentence_count")))
