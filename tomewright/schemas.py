"""Schemas of the knowledge base's tables."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT, _INT, _TIME = T.StringType(), T.IntegerType(), T.TimestampNTZType()
_MAP = T.MapType(_TEXT, _TEXT)


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


#: One struct for all kinds of sources; fields that a kind lacks are null.
PROVENANCE = _fields(page=_INT, sentence=_INT, sentence_count=_INT, heading_path=_TEXT, para=_INT, chunk_index=_INT, location=_TEXT, legacy=T.BooleanType())
RESOURCES = _fields(id=_TEXT, namespace=_TEXT, source_type=_TEXT, source_uri=_TEXT, content_hash=_TEXT, metadata=_MAP, created_at=_TIME, updated_at=_TIME)
SEGMENTS = _fields(id=_TEXT, ir_id=_TEXT, namespace=_TEXT, segment_index=_INT, text=_TEXT, provenance=PROVENANCE, text_hash=_TEXT, created_at=_TIME)
ENTITIES = _fields(id=_TEXT, namespace=_TEXT, type=_TEXT, name=_TEXT, aliases=T.ArrayType(_TEXT), metadata=_MAP, created_at=_TIME, updated_at=_TIME)
#: Links and vectors carry their segment's namespace and resource, by which they are laid out.
LINKS = _fields(segment_id=_TEXT, entity_id=_TEXT, link_type=_TEXT, confidence=T.FloatType(), ir_id=_TEXT, namespace=_TEXT, created_at=_TIME)
EMBEDDINGS = _fields(segment_id=_TEXT, model=_TEXT, vector=T.ArrayType(T.FloatType()), ir_id=_TEXT, namespace=_TEXT, created_at=_TIME)
SKETCHES = _fields(namespace=_TEXT, type=_TEXT, state=T.BinaryType())
CHUNKS = _fields(id=T.LongType(), source_pdf=_TEXT, page_num=_INT, chunk_index=_INT, location=_TEXT, content=_TEXT, embedding=T.ArrayType(T.FloatType()))

#: mentions has the rows of links in another layout, by entity, for recall.
TABLES = {"resources": RESOURCES, "segments": SEGMENTS, "entities": ENTITIES, "links": LINKS, "mentions": LINKS, "embeddings": EMBEDDINGS, "sketches": SKETCHES, "chunks": CHUNKS}
_LINK = ["segment_id", "entity_id", "link_type"]
KEYS = {"resources": ["namespace", "source_uri"], "segments": ["id"], "entities": ["namespace", "type", "name"], "links": _LINK, "mentions": _LINK, "embeddings": ["segment_id"], "sketches": ["namespace", "type"], "chunks": ["id"]}
#: Columns whose hash is a row's bucket. All that comes of one resource lies in one bucket of segments, links and embeddings each.
BUCKETED_BY = {"resources": ["namespace", "source_uri"], "segments": ["ir_id"], "entities": ["namespace", "type", "name"], "links": ["ir_id"], "mentions": ["entity_id"], "embeddings": ["ir_id"], "sketches": ["namespace", "type"], "chunks": ["id"]}
#: Columns by which rows lie in their files, so that a filter on them skips the rest of a file.
SORTED_BY = {"segments": ["ir_id", "id"], "links": ["segment_id"], "mentions": ["entity_id"], "embeddings": ["segment_id"], "entities": ["name"]}
