"""Lookups, exact recall, listings and counts. Each is one plan over the tables; none loops over rows."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from ..sources.store import TableStore

ENTITY_COLUMNS = ["id", "namespace", "type", "name", "aliases"]


def by_id(df: DataFrame, id: str) -> DataFrame:
    return df.where(F.col("id") == id)


def resource_by_uri(resources: DataFrame, namespace: str, source_uri: str) -> DataFrame:
    return resources.where((F.col("namespace") == namespace) & (F.col("source_uri") == source_uri))


def _filtered(df: DataFrame, **equal) -> DataFrame:
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def list_resources(resources: DataFrame, namespace: str | None = None) -> DataFrame:
    return _filtered(resources, namespace=namespace).orderBy(F.desc("created_at"), "id")


def list_entities(entities: DataFrame, namespace: str | None = None, type: str | None = None) -> DataFrame:
    return _filtered(entities, namespace=namespace, type=type).orderBy("name", "type", "id")


def resolve_entity(entities: DataFrame, name: str, namespace: str, type: str | None = None) -> DataFrame:
    """At most one entity. With a type: that of the exact name. Without: the first in name order whose name or alias it is."""
    own = entities.where(F.col("namespace") == namespace)
    if type is not None:
        return own.where((F.col("type") == type) & (F.col("name") == name))
    return own.where((F.col("name") == name) | F.array_contains("aliases", name)).orderBy("name", "type").limit(1)


def segments_for_entity(entity: DataFrame, links: DataFrame, segments: DataFrame, resources: DataFrame) -> DataFrame:
    """All segments linked to the given entities, with their sources where known."""
    found = links.drop("namespace").join(entity.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    rows = segments.withColumnRenamed("id", "segment_id").join(found, "segment_id")
    sources = resources.select(F.col("id").alias("ir_id"), "source_uri")
    return rows.drop("source_uri").join(sources, "ir_id", "left")


def recalled(store: TableStore, entity_id: str, namespace: str) -> DataFrame:
    """Exact recall of one entity from the stored tables, as segments_for_entity. Only the bucket of mentions that holds the entity is read, then
    only the buckets of segments that its mentions lie in, and of both the files of the namespace alone."""
    at = [store.bucket_of("mentions", entity_id)]
    own = lambda df: df.where(F.col("namespace") == namespace)
    mentions = own(store.read("mentions", at)).where(F.col("entity_id") == entity_id)
    segments = own(store.read("segments", store.touched("segments", mentions)))
    found = mentions.select("segment_id", "entity_id", "link_type", "confidence", "ir_id")
    rows = segments.withColumnRenamed("id", "segment_id").join(found, ["ir_id", "segment_id"])
    sources = own(store.read("resources")).select(F.col("id").alias("ir_id"), "source_uri")
    return rows.join(sources, "ir_id", "left")


def entities_for_segment(links: DataFrame, entities: DataFrame, segment_id: str | None = None) -> DataFrame:
    found = (links if segment_id is None else links.where(F.col("segment_id") == segment_id)).drop("namespace")
    return entities.select(*ENTITY_COLUMNS).withColumnRenamed("id", "entity_id").join(found, "entity_id")


def segments_for_source(segments: DataFrame, resources: DataFrame, namespace: str, source_uri: str) -> DataFrame:
    source = resource_by_uri(resources, namespace, source_uri).select(F.col("id").alias("ir_id"), "source_uri")
    return segments.drop("source_uri").join(source, "ir_id").orderBy("segment_index", "id")


def segments_of_resource(segments: DataFrame, resources: DataFrame, ir_id: str) -> DataFrame:
    """The segments of a resource by its id, in order. Segments of a resource that isn't there stay, with a null source_uri."""
    source = by_id(resources, ir_id).select(F.col("id").alias("ir_id"), "source_uri")
    return segments.where(F.col("ir_id") == ir_id).drop("source_uri").join(source, "ir_id", "left").orderBy("segment_index", "id")


def mention_counts(entities: DataFrame, links: DataFrame, segments: DataFrame, namespace: str | None = None, type: str | None = None, least: int = 1) -> DataFrame:
    """Entities with the number of link rows to segments there are: at least least (0 keeps unlinked ones). Not in order: most_first sorts."""
    linked = links.join(segments.select(F.col("id").alias("segment_id")), "segment_id", "left_semi")
    counts = linked.groupBy("entity_id").agg(F.count("*").alias("mention_count"))
    own = _filtered(entities, namespace=namespace, type=type)
    rows = own.join(counts, own["id"] == counts["entity_id"], "left").drop("entity_id")
    rows = rows.withColumn("mention_count", F.coalesce("mention_count", F.lit(0).cast("long")))
    return rows.where(F.col("mention_count") >= least)


def most_first(counted: DataFrame) -> DataFrame:
    return counted.orderBy(F.desc("mention_count"), "name", "type", "id")


def count_segments(segments: DataFrame, resources: DataFrame, namespace: str | None = None) -> DataFrame:
    """One row, segments. With a namespace, orphans of unknown resources don't count."""
    if namespace is not None:
        own = resources.where(F.col("namespace") == namespace).select(F.col("id").alias("ir_id"))
        segments = segments.join(own, "ir_id", "left_semi")
    return segments.agg(F.count("*").alias("segments"))


def stats(resources: DataFrame, segments: DataFrame, entities: DataFrame) -> DataFrame:
    """A row per namespace: information_resources, segments, entities, entity_types."""
    seg = segments.select(F.col("ir_id")).join(resources.select(F.col("id").alias("ir_id"), "namespace"), "ir_id").groupBy("namespace").agg(F.count("*").alias("segments"))
    ent = entities.groupBy("namespace").agg(F.count("*").alias("entities"), F.countDistinct("type").alias("entity_types"))
    res = resources.groupBy("namespace").agg(F.count("*").alias("information_resources"))
    rows = res.join(seg, "namespace", "full_outer").join(ent, "namespace", "full_outer")
    return rows.na.fill(0).select("namespace", "information_resources", "segments", "entities", "entity_types")


def compare(exact: DataFrame, semantic: DataFrame, entity_name: str) -> DataFrame:
    """One row on two sets of segment_id: counts, overlap, recall, precision (0 without rows), and up to ten missed ids in order."""
    a = exact.select("segment_id").distinct().withColumn("e", F.lit(1))
    b = semantic.select("segment_id").distinct().withColumn("s", F.lit(1))
    both = a.join(b, "segment_id", "full_outer")
    count = lambda test: F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).cast("long")
    in_e, in_s = F.col("e").isNotNull(), F.col("s").isNotNull()
    counts = both.agg(count(in_e).alias("exact_count"), count(in_s).alias("semantic_count"), count(in_e & in_s).alias("overlap_count"))
    missed = both.where(in_e & ~in_s).orderBy("segment_id").limit(10).agg(F.sort_array(F.collect_list("segment_id")).alias("missed_segments"))
    e, s, o = F.col("exact_count"), F.col("semantic_count"), F.col("overlap_count")
    share = lambda n: F.when(n > 0, o / n).otherwise(F.lit(0.0))
    return counts.join(F.broadcast(missed)).select(F.lit(entity_name).alias("entity_name"), e, s, o, (e - o).alias("missed_by_semantic_count"), (s - o).alias("false_positive_count"), share(e).alias("recall"), share(s).alias("precision"), "missed_segments")
