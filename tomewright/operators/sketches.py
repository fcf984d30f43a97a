"""Distinct counts that add up: a HyperLogLog state for each namespace and type, written at ingest and merged when asked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base-2 logarithm of a state's registers: 16 KB and a standard error of 0.8 %.
REGISTERS = 14
#: Relative error that an estimate stays within, five standard errors.
ERROR = 0.04


def states(hits: DataFrame) -> DataFrame:
    """namespace, type, state (of the segments, id, that have a hit of the type). States are made in the tasks and merged, so no set of ids is
    shuffled, and a hot type is one state a task."""
    return hits.groupBy("namespace", "type").agg(F.hll_sketch_agg("id", REGISTERS).alias("state"))


def merged(*parts: DataFrame) -> DataFrame:
    """States of several ingests as one table. A segment that is ingested again changes nothing; one that is taken out of the tables stays in
    the states until they are made anew."""
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("namespace", "type").agg(F.hll_union_agg("state").alias("state"))


def rolled_up(stored: DataFrame) -> DataFrame:
    """namespace, type, level (0: both, 1: all types of a namespace, 3: everything), segments (estimated), from stored states alone, whose number
    doesn't grow with the texts."""
    rows = stored.rollup("namespace", "type").agg(F.grouping_id().cast("int").alias("level"), F.hll_sketch_estimate(F.hll_union_agg("state")).alias("segments"))
    return rows.select("namespace", "type", "level", "segments")


def exact(links: DataFrame, entities: DataFrame) -> DataFrame:
    """The same with exact counts, from the links. A segment's links meet once, as the set of their namespaces and types; equal sets are
    counted together, and only these few counts are rolled up."""
    typed = links.drop("namespace").join(entities.select(F.col("id").alias("entity_id"), "namespace", "type"), "entity_id")
    sets = typed.groupBy("segment_id").agg(F.array_sort(F.collect_set(F.struct("namespace", "type"))).alias("of"))
    counted = sets.groupBy("of").agg(F.count("segment_id").alias("n"))
    none = F.lit(None).cast("string")

    def level(number: int, namespace: Callable[[Column], Column], type: Callable[[Column], Column]) -> Column:
        return F.array_distinct(F.transform("of", lambda c: F.struct(namespace(c).alias("namespace"), type(c).alias("type"), F.lit(number).alias("level"))))

    own_ns, own_type, no = (lambda c: c["namespace"]), (lambda c: c["type"]), (lambda c: none)
    levels = [level(0, own_ns, own_type), level(1, own_ns, no), level(3, no, no)]
    rows = counted.select("n", F.explode(F.concat(*levels)).alias("c")).select("c.*", "n")
    return rows.groupBy("namespace", "type", "level").agg(F.sum("n").alias("segments"))
