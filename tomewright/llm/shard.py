"""Shards along a Hilbert curve over metadata, so that files hold compact boxes of all dimensions at once.

Each dimension is quantised by cut points of equal depth, taken over all rows; those of a text dimension are values of its own, found on
the running count of its sorted distinct values. The cell's index on the
Hilbert curve orders the rows; runs of that order are the shards. Only the key, the sizes and the dimensions are sorted, never the
texts. Ties of the curve (a hot source or one cell may hold a third of the rows) are broken by a hash of the
key, so range partitions split them, and a run is cut wherever its law says, inside a cell or not.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import other_columns, stash

BITS = 6
#: Bytes that each row counts for besides its text.
ROW_OVERHEAD = 16
#: Rows of the sorted key table that one task takes.
ROWS_PER_TASK = 500_000


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of cells (rows of d coordinates below 2**bits), by Skilling's transform
    (Programming the Hilbert curve, 2004), for all rows at once."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    high = 1 << (bits - 1)
    q = high
    while q > 1:
        p = q - 1
        for i in range(d):
            set_bit = (x[i] & q) != 0
            exchanged = np.where(set_bit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(set_bit, x[0] ^ p, x[0] ^ exchanged)
            x[i] ^= exchanged
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = high
    while q > 1:
        t = np.where(x[d - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(d):
            index = (index << 1) | ((x[i] >> bit) & 1)
    return index


def _text_cuts(df: DataFrame, name: str, parts: int) -> list[str]:
    """Up to parts - 1 values that cut a text column into runs of near equal counts of rows: the values at equal shares of the running
    count over all distinct values. Values are counted, range-sorted and numbered by part, so none of it depends on how many there are."""
    counted = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))
    ordered = stash(counted.orderBy("value").withColumn("_at", F.monotonically_increasing_id()), "values").withColumn("_part", F.shiftright("_at", 33))
    sums = sorted(ordered.groupBy("_part").agg(F.sum("n").alias("n")).collect())
    total = sum(r["n"] for r in sums)
    if not total:
        return []
    before = {r["_part"]: sum(q["n"] for q in sums[:i]) for i, r in enumerate(sums)}
    offsets = F.broadcast(df.sparkSession.createDataFrame(list(before.items()), "_part long, _before long"))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = ordered.join(offsets, "_part").withColumn("_upto", F.col("_before") + F.sum("n").over(inside))
    share = lambda count: F.floor(count * parts / total)
    # The rows after which the running count enters another share: parts at most.
    return [r[0] for r in upto.where(share(F.col("_upto")) != share(F.col("_upto") - F.col("n"))).orderBy("value").select("value").collect()][: parts - 1]


def _below(cuts: Column, value: Column) -> Column:
    return F.filter(cuts, lambda cut: cut < value)


def _codes(df: DataFrame, dimensions: Sequence[str], bits: int) -> dict[str, Column]:
    """An order-keeping number for each dimension: numbers as they are, text by the number of cut values before it."""
    codes = {}
    for d in dimensions:
        if dict(df.dtypes)[d] == "string":
            value, cuts = F.col(d), F.array(*[F.lit(c) for c in _text_cuts(df, d, 1 << bits)]).cast("array<string>")
            codes[d] = F.when(value.isNotNull(), F.size(_below(cuts, value)).cast("double"))
        else:
            codes[d] = F.col(d).cast("double")
    return {d: F.coalesce(c, F.lit(-1.0)) for d, c in codes.items()}


def hilbert_shards(df: DataFrame, dimensions: Sequence[str], shards: int = 40, law: str = "rows", key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """Per row of df: key, the dimensions, size (UTF-8 bytes of the text plus 16), text_crc32, hilbert (place on the curve), law, shard
    (0 to shards - 1) and slot (gapless from 0 in each shard, in curve order).

    law 'rows': shard counts differ by one at most. law 'bytes': runs are cut where the running size passes the next equal share. Null
    dimensions come first; a null text has no bytes (size 16, checksum 0). Rows with equal keys each get a slot; an
    empty table gives an empty result."""
    if law not in ("rows", "bytes"):
        raise ValueError(f"law {law!r}")
    codes = _codes(df, dimensions, bits)
    content = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    light = stash(df.select(F.col(key).alias("_key"), *[F.col(d).alias(f"_d{i}") for i, d in enumerate(dimensions)], *[codes[d].alias(f"_c{i}") for i, d in enumerate(dimensions)], (F.octet_length(content) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(content).alias("text_crc32")), "light")
    depth = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts = light.agg(F.count("*").alias("n"), *[F.percentile_approx(f"_c{i}", depth, 1000).alias(f"q{i}") for i in range(len(dimensions))]).first()
    borders = [np.unique(np.array(cuts[f"q{i}"] or [], dtype=float)) for i in range(len(dimensions))]

    @F.pandas_udf("bigint")
    def curve(*columns: pd.Series) -> pd.Series:
        # Few cut points would use only a corner of the grid: cells are spread over its whole side.
        cells = [np.searchsorted(b, c.to_numpy(float), "left") * ((1 << bits) - 1) // max(1, len(b)) for b, c in zip(borders, columns, strict=True)]
        return pd.Series(hilbert_index(np.stack(cells, axis=1), bits))

    tie = F.xxhash64("_key", "text_crc32")
    placed = light.select("_key", *[f"_d{i}" for i in range(len(dimensions))], "size", "text_crc32", curve(*[f"_c{i}" for i in range(len(dimensions))]).alias("hilbert"), tie.alias("_tie"))
    order = ["hilbert", "_tie", "_key", "text_crc32", "size"]
    tasks = max(light.sparkSession.sparkContext.defaultParallelism, cuts["n"] // ROWS_PER_TASK + 1)
    ordered = placed.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    # The stored table fixes each row's range and its place there, whatever runs again later.
    ordered = stash(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered").withColumn("_part", F.shiftright("_at", 33))
    parts = sorted(ordered.groupBy("_part").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).collect())
    rows = sum(p["rows"] for p in parts)
    measure, total = ("rows", rows) if law == "rows" else ("bytes", sum(p["bytes"] for p in parts))
    before, running = {}, 0
    for p in parts:
        before[p["_part"]] = running
        running += p[measure]
    # A row for each sort task, ROWS_PER_TASK rows of the input or more.
    offsets = F.broadcast(df.sparkSession.createDataFrame(list(before.items()), "_part long, _before long"))
    ordered, offset = ordered.join(offsets, "_part"), F.col("_before")
    if law == "rows":
        base, extra = divmod(rows, shards)
        place = ordered.withColumn("_place", offset + F.col("_at").bitwiseAND((1 << 33) - 1))
        large = F.lit(extra * (base + 1))
        shard = F.when(F.col("_place") < large, F.expr(f"_place div {base + 1}")).otherwise(F.lit(extra) + F.expr(f"(_place - {extra * (base + 1)}) div {max(1, base)}"))
        begins = F.col("shard") * base + F.least("shard", F.lit(extra))
        out = place.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("_place") - begins).cast("long"))
    else:
        inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        place = ordered.withColumn("_place", offset + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        place = place.withColumn("shard", F.least(F.expr(f"cast((_place + size div 2) * {shards} div {max(1, total)} as int)"), F.lit(shards - 1)))
        # A row's slot is its rank among the rows of its shard: its place in the range, less where the shard begins there, plus the shard's rows in earlier ranges.
        place = stash(place, "placed")
        counts = sorted(place.groupBy("shard", "_part").agg(F.count("*").alias("n"), F.min("_at").alias("first")).collect())
        start: dict[tuple[int, int], int] = {}
        seen: dict[int, int] = {}
        for c in counts:
            start[c["shard"], c["_part"]] = seen.get(c["shard"], 0) - (c["first"] & ((1 << 33) - 1))
            seen[c["shard"]] = seen.get(c["shard"], 0) + c["n"]
        shift = place.sparkSession.createDataFrame([(s, p, v) for (s, p), v in start.items()], "shard int, _part long, _shift long")
        out = place.join(F.broadcast(shift), ["shard", "_part"]).withColumn("slot", F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_shift"))
    return out.select(F.col("_key").alias(key), *[F.col(f"_d{i}").alias(d) for i, d in enumerate(dimensions)], "size", "text_crc32", "hilbert", F.lit(law).alias("law"), "shard", "slot")


def write_shards(df: DataFrame, assignment: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Write df's rows to path/shard=N, each shard sorted by slot, for readers that skip files by their statistics. assignment is
    hilbert_shards(df). Each row of df is written once: rows of equal key and text go together, to the least shard and slot
    of theirs; a null key is a key. Columns of df named shard, slot or hilbert are replaced."""
    content = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    rows = df.select(*other_columns(df, "shard", "slot", "hilbert"), F.col(key).alias("_k"), F.crc32(content).alias("_crc"), (F.octet_length(content) + ROW_OVERHEAD).cast("long").alias("_size"))
    least = assignment.groupBy(F.col(key).alias("k"), F.col("text_crc32").alias("c"), F.col("size").alias("s")).agg(F.min(F.struct("shard", "slot", "hilbert")).alias("to"))
    placed = rows.join(least, F.col("_k").eqNullSafe(F.col("k")) & (F.col("_crc") == F.col("c")) & (F.col("_size") == F.col("s"))).select(*other_columns(df, "shard", "slot", "hilbert"), "to.shard", "to.slot", "to.hilbert")
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
