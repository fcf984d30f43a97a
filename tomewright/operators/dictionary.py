"""Known names in texts: all names and aliases of a namespace against its texts, by one automaton instead of a pattern a name.

The forms are dealt to blocks of a bounded size. A block's Aho-Corasick automaton is built once in each Python worker, and each block is a pass
of its own over the texts, so neither the driver nor a worker holds more than one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

#: Bytes of the forms of one block.
BLOCK_BYTES = 16 << 20


def forms(entities: DataFrame) -> DataFrame:
    """namespace, entity_id, form: each name and alias once an entity; empty ones aren't forms."""
    every = F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    rows = entities.select("namespace", F.col("id").alias("entity_id"), F.explode(every).alias("form"))
    return rows.where(F.col("form").isNotNull() & (F.col("form") != ""))


def _word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


def occurrences(automaton: ahocorasick.Automaton, text: str) -> Iterator[object]:
    """The values of the forms that stand in text, once for each place; where a form begins or ends with a word character, no other may
    stand beside it."""
    for end, (form, value) in automaton.iter(text):
        start = end - len(form) + 1
        if (_word(form, 0) and _word(text, start - 1)) or (_word(form, len(form) - 1) and _word(text, end + 1)):
            continue
        yield value


def known_names(texts: DataFrame, entities: DataFrame, id: str = "id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, entity_id, times: how often a text has the name or an alias of an entity of its namespace, as whole words and in the case given.

    Overlapping forms all count, also one inside another. Null texts have no names; a null namespace is one. Entities that share a form are
    each found. Repeated texts each give rows. Blocks are cut by the hash of the entity, so all its forms lie in one, each row is whole when it is
    made and no row is shuffled."""
    spark = ship(texts.sparkSession)
    rows = forms(entities)
    total = rows.agg(F.sum(F.octet_length("form") + F.octet_length("entity_id"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    kind = texts.schema[id].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("entity_id", T.StringType()), T.StructField("times", T.LongType())])
    source = texts.select(F.col(id).alias("id"), "namespace", F.col(text).alias("text"))

    def part(number: int) -> DataFrame:
        own: dict[str, dict[str | None, list[str]]] = {}
        for r in rows.where(F.pmod(F.xxhash64("entity_id"), F.lit(count)) == number).select("form", "namespace", "entity_id").toLocalIterator():
            own.setdefault(r["form"], {}).setdefault(r["namespace"], []).append(r["entity_id"])
        sent = spark.sparkContext.broadcast(own)  # one block

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for form, value in sent.value.items():
                automaton.add_word(form, (form, value))
            automaton.make_automaton()
            for batch in batches:
                at, entity, times = [], [], []
                for row, (namespace, value) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    found: dict[str, int] = {}
                    for owners in occurrences(automaton, value) if value and len(automaton) else ():
                        for e in owners.get(namespace, ()):
                            found[e] = found.get(e, 0) + 1
                    at += [row] * len(found)
                    entity += found
                    times += found.values()
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(entity, pa.string()), pa.array(times, pa.int64())], names=schema.names)

        return source.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, [part(n) for n in range(count)])
