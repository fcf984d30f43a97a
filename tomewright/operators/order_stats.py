"""Exact order statistics of groups without sorting a group in one task: counts of value cells say where a rank lies, and only that cell is sorted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Equal cells between a group's least and greatest value.
CELLS = 1024


def order_statistics(df: DataFrame, by: str, value: str, ranks: dict[str, Callable[[Column], Column]], cells: int = CELLS) -> DataFrame:
    """by, and for each name of ranks the value at a place of the group's sorted values. A rank is a function of the group's count that gives the place,
    from 0. Null values aren't counted, groups of nulls alone have no row, a null group is one.

    Equal values are counted together first, so a value that a third of all rows have is one row a task. A group's cells are a bounded
    number of rows; of the cells, those that hold a wanted place are sorted. A distribution that puts most distinct values into one
    cell sorts that cell in one task."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(by).alias("g"), F.col(value).cast("double").alias("v"))
    counted = rows.groupBy("g", "v").agg(F.count("*").alias("times"))
    about = counted.groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("times").alias("n"))
    place = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * cells), F.lit(cells - 1))).otherwise(0)
    named = about.select(F.col("g").alias("_g"), "low", "high")
    celled = counted.join(named, F.col("g").eqNullSafe(F.col("_g"))).select("g", "v", "times", place.cast("int").alias("cell"))
    upto = Window.partitionBy("g").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = celled.groupBy("g", "cell").agg(F.sum("times").alias("own")).withColumn("upto", F.sum("own").over(upto))
    wanted = about.select(F.col("g").alias("_g"), F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("rank")) for name, rank in ranks.items()])).alias("w"))
    at = totals.join(wanted, F.col("g").eqNullSafe(F.col("_g")) & (F.col("w.rank") < F.col("upto")) & (F.col("w.rank") >= F.col("upto") - F.col("own")))
    at = at.select(F.col("g").alias("_g"), F.col("cell").alias("_cell"), F.col("w.name").alias("name"), (F.col("w.rank") - F.col("upto") + F.col("own")).alias("rest"))
    inside = Window.partitionBy("g", "name").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = celled.join(at, F.col("g").eqNullSafe(F.col("_g")) & (F.col("cell") == F.col("_cell"))).withColumn("upto", F.sum("times").over(inside))
    found = found.where(F.col("upto") > F.col("rest")).groupBy("g").agg(*[F.min(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks])
    return found.select(F.col("g").alias(by), *ranks)
