"""Identifiers as columns: hashes of natural keys, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import normalize


def segment_id(namespace: Column, source_uri: Column, key: Column, text: Column) -> Column:
    return F.sha2(F.concat(namespace, F.lit("|"), source_uri, F.lit("|"), key, F.lit("|"), normalize(text)), 256)


def text_hash(text: Column) -> Column:
    return F.sha2(normalize(text), 256)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def resource_id(namespace: Column, source_uri: Column) -> Column:
    return F.sha2(F.concat(namespace, F.lit("|"), source_uri), 256)


def entity_id(namespace: Column, kind: Column, name: Column) -> Column:
    return F.sha2(F.concat(namespace, F.lit("|"), kind, F.lit("|"), name), 256)


def file_uri(path: Column) -> Column:
    """file:// and the absolute path, from a path or a URI of any number of slashes; URIs of other schemes as they are."""
    return F.when(path.rlike(r"^(?!file:)[A-Za-z][A-Za-z0-9+.-]*://"), path).otherwise(F.concat(F.lit("file://"), F.regexp_replace(path, r"^file:/+", "/")))


def placeholder_hash(path: Column) -> Column:
    """Stands for the content hash of a file that is gone."""
    return F.concat(F.lit("legacy_"), F.translate(path, "/", "_"))


def provenance_key(provenance: Column) -> Column:
    """Key of a provenance map (string to string), by the fields it has; without a known set of fields, all values in key order."""

    def field(name: str, default: str | None = None) -> Column:
        value = F.element_at(provenance, F.lit(name))
        return value if default is None else F.coalesce(value, F.lit(default))

    def has(*names: str) -> Column:
        out = F.lit(True)
        for name in names:
            out = out & F.array_contains(F.map_keys(provenance), name)
        return out

    def joined(*parts: Column) -> Column:
        return F.concat_ws(":", *parts)

    rest = F.array_join(F.transform(F.sort_array(F.map_keys(provenance)), lambda k: F.element_at(provenance, k)), ":")
    return (
        F.when(has("page", "sentence"), joined(field("page"), field("sentence")))
        .when(has("heading_path"), joined(field("heading_path"), field("para", "0"), field("sentence", "0")))
        .when(has("line"), joined(field("line"), field("sentence", "0")))
        .when(has("table", "row"), joined(field("table"), field("row"), field("col", "")))
        .otherwise(rest)
    )


def to_json_fields(df: DataFrame, *columns: str) -> DataFrame:
    """df with the nested columns as JSON text, under their names and _json; null stays null."""
    return df.select(*[c for c in df.columns if c not in columns], *[F.to_json(c).alias(f"{c}_json") for c in columns])


def from_json_fields(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with its columns *_json read back into schema's types and names; no text, or an empty one, gives an empty array or map."""

    def read(field: T.StructField) -> Column:
        if field.name in df.columns:
            return F.col(field.name)
        text = F.col(f"{field.name}_json")
        empty = F.array() if isinstance(field.dataType, T.ArrayType) else F.create_map()
        return F.when(text.isNull() | (text == ""), empty.cast(field.dataType)).otherwise(F.from_json(text, field.dataType)).alias(field.name)

    return df.select(*[read(f) for f in schema.fields if f.name in df.columns or f"{f.name}_json" in df.columns])
