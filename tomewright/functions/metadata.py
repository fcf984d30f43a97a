"""Metadata as VARIANT: any JSON, filtered by paths, merged key by key; and rows as dated dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KEYED = "map<string,variant>"


def parsed(json: Column) -> Column:
    """A variant of JSON text. Null and empty texts are an empty object; what isn't JSON is null."""
    return F.try_parse_json(F.when(F.coalesce(F.trim(json), F.lit("")) == "", F.lit("{}")).otherwise(json))


def at(metadata: Column, path: str, kind: str) -> Column:
    """The value at a path such as '$.a.b[0]', null where there is none or where it isn't of the kind."""
    return F.try_variant_get(metadata, path, kind)


def merged(old: Column, new: Column) -> Column:
    """The objects' keys together; new's values win. Null is an empty object."""
    keyed = lambda v: F.coalesce(v.cast(_KEYED), F.create_map().cast(_KEYED))
    kept = F.map_filter(keyed(old), lambda k, v: ~F.array_contains(F.map_keys(keyed(new)), k))
    return F.to_variant_object(F.map_concat(kept, keyed(new)))


def iso(time: Column) -> Column:
    """A time as ISO 8601, with microseconds unless they are zero."""
    whole = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(time, "SSSSSS") == "000000", whole).otherwise(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def dated(df: DataFrame) -> DataFrame:
    """df with its times as ISO 8601 texts, as the dictionary forms of rows have them."""
    times = (T.TimestampType, T.TimestampNTZType)
    return df.select(*[iso(F.col(f.name)).alias(f.name) if isinstance(f.dataType, times) else F.col(f.name) for f in df.schema.fields])
