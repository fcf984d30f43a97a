"""Windowed totals of a stream of events, with a watermark for late ones.

A window's row is written once, when the watermark has passed its end: the greatest time seen, less the delay. An event of a window
that is closed is late and is dropped; the query's progress counts it. Windows that are still open when the input ends
are closed by a marker row far in the future, which a second, small source carries (closing, close).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.times import instant

#: The time of a marker row.
END = "9000-01-01 00:00:00"


def tumbling(width: str) -> Column:
    return F.window("_time", width)


def sliding(width: str, slide: str) -> Column:
    return F.window("_time", width, slide)


def session(gap: str) -> Column:
    return F.session_window("_time", gap)


def totals(events: DataFrame, by: Sequence[str], span: Column, delay: str, time: str = "ts", value: str = "value") -> DataFrame:
    """by, starts, ends (seconds since 1970), events, total (of value) for each group and window. Works on a stream, in append mode, and on a table,
    where the delay means nothing. Null keys are a key; events without a time are in no window; a null value counts as an event. The
    partial sums of a task are combined before the shuffle, so a hot key costs a row a task and window."""
    timed = events.withColumn("_time", instant(events, time)).where("_time is not null").withWatermark("_time", delay)
    rows = timed.groupBy(*by, span.alias("_span")).agg(F.count("*").alias("events"), F.sum(value).alias("total"))
    rows = rows.where(F.col("_span.start") < F.lit(END).cast("timestamp") - F.expr("INTERVAL 1 YEAR"))
    return rows.select(*by, F.unix_seconds("_span.start").alias("starts"), F.unix_seconds("_span.end").alias("ends"), "events", "total")


def _folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)


def closing(stream: DataFrame, folder: str) -> DataFrame:
    """stream with the rows that close() puts into folder."""
    spark = stream.sparkSession
    _folder(spark, folder)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder))


def close(spark: SparkSession, schema: T.StructType, folder: str, time: str = "ts") -> None:
    """Say that the input has ended: one row that has nothing but a time after all others."""
    cells = [F.lit(END).cast(f.dataType).alias(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    spark.range(1).select(*cells).coalesce(1).write.mode("append").parquet(folder)


def write(windows: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Closed windows as Parquet files, each window once, whatever fails and starts again on the same checkpoint."""
    writer = windows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def dropped(query: StreamingQuery) -> int:
    """Late rows that the query has dropped so far, after they were combined in their tasks."""
    return sum(o.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for o in p["stateOperators"])
