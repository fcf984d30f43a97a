"""From hits to entities and links, as set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids

MENTIONS = "mentions"


def entities_of(hits: DataFrame) -> DataFrame:
    """Distinct entities of hits (namespace, type, name): with ids and no aliases."""
    found = hits.select("namespace", "type", "name").distinct()
    return found.select(ids.entity_id(F.col("namespace"), F.col("type"), F.col("name")).alias("id"), "namespace", "type", "name", F.array().cast("array<string>").alias("aliases"))


def new_entities(hits: DataFrame, known: DataFrame) -> DataFrame:
    """Entities of hits that known lacks; those it has stay as they are."""
    return entities_of(hits).join(known.select("namespace", "type", "name"), ["namespace", "type", "name"], "left_anti").select("id", "namespace", "type", "name", "aliases")


def links_of(hits: DataFrame, link_type: str = MENTIONS) -> DataFrame:
    """A link per segment (id) and entity. Entity ids are functions of the hit, so nothing is joined, and a segment's
    hits are distinct already, so nothing is shuffled. Hits that name their segment's resource give links that do."""
    of = [F.col("ir_id")] if "ir_id" in hits.columns else []
    return hits.select(F.col("id").alias("segment_id"), ids.entity_id(F.col("namespace"), F.col("type"), F.col("name")).alias("entity_id"), F.lit(link_type).alias("link_type"), F.col("confidence").cast("float").alias("confidence"), *of, "namespace")
