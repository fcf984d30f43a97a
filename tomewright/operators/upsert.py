"""Upserts as one full outer join each, for tables or buckets that are written anew rather than changed in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that an upsert overwrites; all others keep what the table has.
UPDATED = {
    "resources": ["content_hash", "metadata", "updated_at"],
    "segments": ["text", "provenance", "text_hash"],
    "entities": ["aliases", "metadata", "updated_at"],
    "links": ["confidence", "created_at"],
    "mentions": ["confidence", "created_at"],
    "sketches": ["state"],
    "embeddings": ["model", "vector", "created_at"],
    "chunks": ["embedding"],
}


def last_of(df: DataFrame, keys: Sequence[str], order: Column | None) -> DataFrame:
    """One row a key: the last by order, ties by the row itself. Combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    sortable = [c for c in rest if not dict(df.dtypes)[c].startswith("map")]
    rank = F.struct(*([order.alias("_order")] if order is not None else []), *[F.col(c) for c in sortable])
    if not rest:
        return df.distinct()
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row")).select(*keys, *[F.col(f"_row.{c}") for c in rest]).select(*df.columns)


def upsert(known: DataFrame, incoming: DataFrame, keys: Sequence[str], updated: Sequence[str], order: Column | None = None) -> DataFrame:
    """known with incoming merged in by keys: updated columns take the incoming value, others stay; new keys are added. A
    null is a key like any other."""
    fresh = last_of(incoming.select(*known.columns), keys, order).withColumn("_in", F.lit(True))
    old = known.withColumn("_old", F.lit(True))
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    joined = old.alias("o").join(fresh.alias("n"), same, "full_outer")

    def value(c: str) -> Column:
        new, was = F.col(f"n.{c}"), F.col(f"o.{c}")
        first = F.col("n._in") if c in updated else F.col("o._old").isNull()
        return F.when(first, new).otherwise(was).alias(c)

    return joined.select(*[value(c) for c in known.columns])


def resource_changes(known: DataFrame, current: DataFrame) -> DataFrame:
    """current (namespace, source_uri, content_hash) with status new, changed or unchanged against known. A null hash is a value of its own:
    unchanged only against a null one."""
    old = known.select(F.col("namespace").alias("_ns"), F.col("source_uri").alias("_uri"), F.col("content_hash").alias("_was"), F.lit(True).alias("_there"))
    status = F.when(F.col("_there").isNull(), "new").when(F.col("_was").eqNullSafe(F.col("content_hash")), "unchanged").otherwise("changed")
    return current.join(old, F.col("namespace").eqNullSafe(F.col("_ns")) & F.col("source_uri").eqNullSafe(F.col("_uri")), "left").withColumn("status", status).drop("_ns", "_uri", "_was", "_there")


def stale_segments(known: DataFrame, current: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """Segments of known, of the resources that were read again, which current no longer has. covered (ir_id) names these resources; without it
    they are those that current has segments of, and a resource that lost all of its own isn't seen."""
    read_again = (current if covered is None else covered).select("ir_id").distinct()
    return known.join(read_again, "ir_id", "left_semi").join(current.select("id"), "id", "left_anti").select(*known.columns)


def missing_embeddings(segments: DataFrame, embeddings: DataFrame) -> DataFrame:
    return segments.join(embeddings.select(F.col("segment_id").alias("id")), "id", "left_anti").select(*segments.columns)
