"""Incremental ingest: a stream of text rows into the segments table, each micro-batch an idempotent merge of the buckets it touches."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import ids
from ..operators.segment import segment_text
from ..sources.store import TableStore


def text_stream_to_segments(stream: DataFrame, store: TableStore, checkpoint: str, per_segment: int = 3, available_now: bool = True) -> StreamingQuery:
    """stream: namespace, source_uri, text. Segment ids are functions of the content, so a batch that runs twice changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        rows = batch.withColumn("ir_id", ids.resource_id(F.col("namespace"), F.col("source_uri")))
        made = segment_text(rows, per_segment).withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
        made = made.persist(StorageLevel.DISK_ONLY)  # read for its buckets, and again for the merge
        store.merge("segments", made)
        made.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
