"""Joins along time: the last earlier row, and the rows of a span before. Neither compares rows by anything but equal keys and sorts.

A hot key is cut into cells of time, so that it fills as many tasks as it needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.times import micros

#: Rows of an average cell of as_of_join, where the caller names no width.
CELL_ROWS = 1_000_000
_MICROS = 1_000_000


def _width(both: DataFrame, cell_rows: int) -> int:
    """Microseconds of a cell, so that cells have about cell_rows rows if these are spread evenly over time."""
    found = both.agg(F.count("*").alias("n"), F.min("_at").alias("low"), F.max("_at").alias("high")).first()
    return max(1, -(-((found["high"] or 0) - (found["low"] or 0) + 1) // max(1, -(-found["n"] // cell_rows))))


def as_of_join(left: DataFrame, right: DataFrame, on: Sequence[str], time: str = "ts", tie: str | None = None, tolerance: float | None = None, strict: bool = False, cell_rows: int = CELL_ROWS) -> DataFrame:
    """left with a struct `met`: the row of right with equal keys and the latest time not after left's own (before it, if strict), null where there
    is none, or none within tolerance seconds. Of right rows of one time the greatest tie counts (without tie, the greatest row).

    Both sides are put into one frame, dealt by key and cell of time, sorted, and the last right row is carried on; where a cell has none
    before a left row, the last of the key's earlier cells is, which one row per key and cell says. So nothing is compared across a key, and a
    hot key is many tasks; rows of one key and cell meet in one. Null keys and null times meet nothing; repeated left rows each keep their place;
    right's columns are met's fields, so names may clash. Empty sides are fine."""
    keys = [f"_k{i}" for i in range(len(on))]
    inside = [F.col(c).alias(k) for c, k in zip(on, keys, strict=True)]
    none_missing = F.lit(True)
    for c in (*on, time):
        none_missing = none_missing & F.col(c).isNotNull()
    row = F.struct(*[F.col(c) for c in right.columns])
    order = F.struct(F.col(tie), row) if tie else row
    # One right row for each key and time, combined before the shuffle.
    met = right.where(none_missing).groupBy(*inside, micros(right, time).alias("_at")).agg(F.max(order).alias("_met"))
    met = met.withColumn("_met", F.col("_met").getField("col2") if tie else F.col("_met"))
    kind = T.StructType([T.StructField(f.name, f.dataType, True) for f in right.schema.fields])
    asked = left.select(*inside, micros(left, time).alias("_at"), F.struct(*[F.col(c) for c in left.columns]).alias("_row"), none_missing.alias("_whole"))
    lone = asked.where(~F.col("_whole")).select("_row", F.lit(None).cast(kind).alias("met"))
    asked = asked.where("_whole").drop("_whole")
    # A right row of the same time comes first unless it mustn't count.
    both = asked.select(*keys, "_at", F.lit(0 if strict else 1).alias("_side"), "_row", F.lit(None).cast(kind).alias("_met")).unionByName(met.select(*keys, "_at", F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), F.col("_met").cast(kind)))
    width = _width(asked.select("_at").unionByName(met.select("_at")), cell_rows)
    both = both.withColumn("_cell", F.floor(F.col("_at") / F.lit(width)).cast("long"))
    found = F.struct("_at", "_met")
    here = Window.partitionBy(*keys, "_cell").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumn("_last", F.last(F.when(F.col("_met").isNotNull(), found), ignorenulls=True).over(here)).where("_row is not null")
    # What each cell hands to the key's later cells: one row a key and cell.
    cells = met.withColumn("_cell", F.floor(F.col("_at") / F.lit(width)).cast("long")).groupBy(*keys, "_cell").agg(F.max_by(found, "_at").alias("_end"))
    every = both.select(*keys, "_cell").distinct().join(cells, [*keys, "_cell"], "left")
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    every = every.select(*keys, "_cell", F.last("_end", ignorenulls=True).over(before).alias("_before"))
    out = carried.join(every, [*keys, "_cell"], "left").withColumn("_last", F.coalesce("_last", "_before"))
    near = F.lit(True) if tolerance is None else (F.col("_at") - F.col("_last._at")) <= F.lit(int(tolerance * _MICROS))
    out = out.select("_row", F.when(near, F.col("_last._met")).alias("met")).unionByName(lone)
    return out.select(*[F.col("_row").getField(c).alias(c) for c in left.columns], "met")


def span_join(left: DataFrame, right: DataFrame, on: Sequence[str], span: float, time: str = "ts", salts: int = 1) -> DataFrame:
    """Pairs: left with a struct `met`, once for each row of right with equal keys and a time within span seconds before left's own, or equal to it.

    Time is cut into cells as wide as the span, so a left row meets two cells of right rows, by an equal join on key and cell; a condition on the
    times follows. A key that is hot within one cell can be dealt to several tasks: salts copies of each left row meet a
    part of the right rows each. Null keys and times meet nothing; repeated rows each pair."""
    width = int(span * _MICROS)
    if width < 1 or salts < 1:
        raise ValueError("span must be a microsecond or more, and salts 1 or more")
    keys = [f"_k{i}" for i in range(len(on))]
    cell = F.floor(F.col("_at") / F.lit(width)).cast("long")
    inside = [F.col(c).alias(k) for c, k in zip(on, keys, strict=True)]
    asked = left.select(*inside, micros(left, time).alias("_at"), *left.columns).withColumn("_cell", F.explode(F.array(cell, cell - 1)))
    asked = asked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))) if salts > 1 else F.lit(0))
    row = F.struct(*[F.col(c) for c in right.columns])
    met = right.select(*inside, micros(right, time).alias("_at"), row.alias("met")).select(*keys, cell.alias("_cell"), F.col("_at").alias("_was"), "met")
    met = met.withColumn("_salt", F.pmod(F.xxhash64("met"), F.lit(salts)).cast("int") if salts > 1 else F.lit(0))
    pairs = asked.join(met, [*keys, "_cell", "_salt"]).where(F.col("_was").between(F.col("_at") - width, F.col("_at")))
    return pairs.select(*left.columns, "met")
