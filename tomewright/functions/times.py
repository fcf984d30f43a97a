"""Times as numbers and instants, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970. A time without a zone is taken as UTC."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column))
    return F.unix_micros(F.col(column).cast("timestamp"))


def instant(df: DataFrame, column: str) -> Column:
    """The time as a timestamp, which windows and watermarks need."""
    return F.timestamp_micros(micros(df, column))
