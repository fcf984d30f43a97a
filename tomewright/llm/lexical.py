"""Ranked lexical search as a blocked sparse matrix product.

Scores are the product of two sparse integer matrices, item-term multiplicities and term-document impacts. Items are cut into blocks of
a bounded size, documents into blocks of rows inside their tasks. A pass over the texts stores each document block as term rows
(the documents and frequencies of each term of the items), from which document frequencies are counted; then each block is
multiplied in the manner of Gustavson: for each item the rows of its terms are scaled and merged into one line of sums. The best k of
every item stay in each block, then in each task, then in parts of the documents, and last overall.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_memory, stash, texts_in_small_batches

TOP = 20
#: Bytes of an item block: its terms, and twelve for each item and term. The driver and every task hold one block at a time.
BLOCK_BYTES = 8 << 20
#: A document block ends with so many documents or entries.
BLOCK_DOCUMENTS, BLOCK_ENTRIES = 8_192, 2_000_000
#: Parts of the documents in which the best rows of an item meet first.
PARTS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes to bytes: letters of ASCII small, all other bytes that no term has to spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def split_terms(text: str | None) -> list[bytes]:
    """The terms of a whole text, with repeats, in UTF-8; none for a null text."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def term_array(text: Column) -> Column:
    """The same terms as a column of strings."""
    cut = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    return F.filter(cut, lambda t: t != "")


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """item, term, times: how often an item has each of its terms."""
    return items.select(F.col(key).alias("item"), F.explode(term_array(F.col(text))).alias("term")).groupBy("item", "term").agg(F.count("*").alias("times"))


def item_blocks(terms: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """terms with block: items dealt by hash to so many blocks that each has at most `most` bytes, or a single item."""
    size = F.octet_length("term") + 12
    count = max(1, -(-(terms.agg(F.sum(size)).first()[0] or 0) // most))
    while True:
        dealt = terms.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(count)).cast("int"))
        largest = dealt.groupBy("block", "item").agg(F.sum(size).alias("n")).groupBy("block").agg(F.sum("n").alias("n"), F.count("*").alias("items")).where((F.col("n") > most) & (F.col("items") > 1))
        if count == 1 << 20 or largest.isEmpty():
            return dealt
        count *= 2


def documents_by_term(documents: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """A row per document block: its documents with terms, all their terms, and the block's part of the matrix, packed (see _packed)."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)  # an item block's, so of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        held, entries = [], 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for doc, value in zip(keys, batch.column(1), strict=True):
                words = split_terms(value.as_py())
                if not words:
                    continue
                at, times = np.unique(np.array([p for p in map(place.get, words) if p is not None], np.int64), return_counts=True)
                held.append((doc, len(words), at, times))
                entries += len(at)
                if len(held) >= BLOCK_DOCUMENTS or entries >= BLOCK_ENTRIES:
                    yield _packed(held)
                    held, entries = [], 0
        if held:
            yield _packed(held)
        free_memory()

    return texts_in_small_batches(documents).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("t")).mapInArrow(run, _BLOCK)


_BLOCK = "n_documents long, n_terms long, docs array<long>, lengths binary, terms binary, ends binary, cells binary"
_BLOCK_NAMES = [part.split()[0] for part in _BLOCK.split(", ")]


def _packed(held: list[tuple]) -> pa.RecordBatch:
    """terms: the block's terms, ascending; ends: where the row of each ends in cells; cells: pairs of a document's place in docs and a frequency."""
    of = np.repeat(np.arange(len(held)), [len(h[2]) for h in held])
    at, times = (np.concatenate([h[i] for h in held]) for i in (2, 3))
    order = np.lexsort((of, at))
    terms, first = np.unique(at[order], return_index=True)
    cells = np.stack([of[order], np.minimum(times[order], (1 << 32) - 1)], axis=1).astype("<u4")
    lengths = np.array([h[1] for h in held], "<i8")
    binary = [lengths, terms.astype("<u4"), np.append(first[1:], len(at)).astype("<u4")[: len(terms)], cells]
    columns = [pa.array([len(held)], pa.int64()), pa.array([int(lengths.sum())], pa.int64()), pa.array([[h[0] for h in held]], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([*columns, *[pa.array([b.tobytes()], pa.binary()) for b in binary]], names=_BLOCK_NAMES)


def document_frequencies(blocks: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term of the item block. A task adds its blocks up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            for terms, ends in zip(batch.column(0), batch.column(1), strict=True):
                df[np.frombuffer(terms.as_py(), "<u4")] += np.diff(np.frombuffer(ends.as_py(), "<u4").astype(np.int64), prepend=0)
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(df[found], pa.int64())], names=["term", "df"])

    rows = blocks.select("terms", "ends").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    out = np.zeros(n_terms, np.int64)
    for r in rows:
        out[r["term"]] = r["df"]
    return out


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def impacts(w: np.ndarray, times: np.ndarray, lengths: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """Of cells: the term's weight by the saturated frequency, in a document of so many terms. 64-bit integers, all divisions down."""
    m = 75 + (25 * lengths * documents) // all_terms
    return w * ((1_000_000_000 * times) // (1000 * times + 12 * m))


def multiplied(rows: list[tuple[np.ndarray, np.ndarray]], terms: np.ndarray, starts: np.ndarray, docs: np.ndarray, worth: np.ndarray, n_docs: int, k: int, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each item (its terms and their multiplicities): the item's place, and the places and scores of its best k documents of the block, those
    of no score left out. ids: by which ties are broken."""
    line = np.zeros(n_docs, np.int64)
    for item, (own, times) in enumerate(rows):
        found = np.searchsorted(terms, own)
        there = (found < len(terms)) & (terms[np.minimum(found, len(terms) - 1)] == own) if len(terms) else np.zeros(len(own), bool)
        if not there.any():
            continue
        line[:] = 0
        for row, often in zip(found[there].tolist(), times[there].tolist(), strict=True):
            a, b = starts[row], starts[row + 1]
            line[docs[a:b]] += often * worth[a:b]  # a document occurs once in a row
        yield item, *best(np.flatnonzero(line), line, ids, k)


def best(places: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    own = scores[places]
    if len(places) > k > 0:
        least = np.partition(own, len(own) - k)[len(own) - k]
        places = places[own >= least]
    places = places[np.lexsort((ids[places], -scores[places]))[:k]]
    return places, scores[places]


def _scored(blocks: DataFrame, items: list, rows: list[tuple[np.ndarray, np.ndarray]], w: np.ndarray, documents: int, all_terms: int, k: int, schema: T.StructType) -> DataFrame:
    shared = blocks.sparkSession.sparkContext.broadcast((items, rows, w))  # an item block
    last = np.iinfo(np.int64).max  # null ids come after all others

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, rows, w = shared.value
        kept: dict[int, list[tuple[np.ndarray, ...]]] = {}

        def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
            scores, ids, absent = (np.concatenate([p[i] for p in parts]) for i in range(3))
            order = np.lexsort((absent, ids, -scores))[:k]
            return scores[order], ids[order], absent[order]

        for batch in batches:
            for at in range(batch.num_rows):
                docs, lengths, terms, ends, cells = (batch.column(i)[at] for i in range(5))
                values = docs.values
                absent = np.asarray(values.is_null())
                ids = values.fill_null(last).to_numpy()
                lengths, terms = np.frombuffer(lengths.as_py(), "<i8"), np.frombuffer(terms.as_py(), "<u4").astype(np.int64)
                starts = np.concatenate([[0], np.frombuffer(ends.as_py(), "<u4").astype(np.int64)])
                cells = np.frombuffer(cells.as_py(), "<u4").reshape(-1, 2).astype(np.int64)
                place = cells[:, 0]
                worth = impacts(np.repeat(w[terms], np.diff(starts)), cells[:, 1], lengths[place], documents, all_terms)
                for item, top, scores in multiplied(rows, terms, starts, place, worth, len(ids), k, ids):
                    held = kept.setdefault(item, [])
                    held.append((scores, ids[top], absent[top]))
                    if len(held) >= 16:
                        kept[item] = [merged(held)]
        for item, parts in kept.items():
            scores, ids, absent = merged(parts)
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array([items[item]] * len(ids), kind), pa.array(ids, pa.int64(), mask=absent), pa.array(scores, pa.int64())], names=schema.names)
        free_memory()

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(schema[0].dataType)
    return blocks.select("docs", "lengths", "terms", "ends", "cells").mapInArrow(run, schema)


def search(documents: DataFrame, items: DataFrame, k: int = TOP, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_key, rank (from 1), key (as long), score: the k documents of the highest score above 0 for each item, ties by the smaller key.

    Null texts have no terms. Rows of items with the same id (null is one) are one item, with all their terms; each row of documents is a
    document of its own, so repeated rows take ranks of their own. Null keys come last among equals. Other columns aren't read. Empty tables
    give no rows. A pass over the documents is made for each block of items, one for up to block_bytes of distinct item terms."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    spark: SparkSession = documents.sparkSession
    dealt = stash(item_blocks(stash(item_terms(items, item_key, item_text), "item-terms"), block_bytes), "item-blocks")
    kind = items.schema[item_key].dataType
    schema = T.StructType([T.StructField("item", kind), T.StructField("doc", T.LongType()), T.StructField("score", T.LongType())])
    found: DataFrame | None = None
    for number in sorted(r[0] for r in dealt.select("block").distinct().collect()):
        own: dict[object, list[tuple[bytes, int]]] = {}
        for r in dealt.where(F.col("block") == number).select("item", "term", "times").toLocalIterator():
            own.setdefault(r["item"], []).append((r["term"].encode("utf-8", "surrogatepass"), r["times"]))
        vocabulary = {t: i for i, t in enumerate(sorted({t for terms in own.values() for t, _ in terms}))}
        names = sorted(own, key=lambda x: (x is None, x if x is not None else 0))
        rows = [(np.array([vocabulary[t] for t, _ in own[i]], np.int64), np.array([n for _, n in own[i]], np.int64)) for i in names]
        blocks = stash(documents_by_term(documents, vocabulary, key, text), "term-rows")
        count = blocks.agg(F.sum("n_documents").alias("n"), F.sum("n_terms").alias("all")).first()
        if not count["n"]:
            break
        w = weights(document_frequencies(blocks, len(vocabulary)), count["n"])
        some = stash(_scored(blocks, names, rows, w, count["n"], count["all"], k, schema), "best")
        found = some if found is None else found.unionByName(some)
    if found is None:
        found = spark.createDataFrame([], schema)
    order = [F.desc("score"), F.asc_nulls_last("doc")]
    ranked = found.withColumn("part", F.pmod(F.xxhash64("doc", "score"), F.lit(PARTS)))
    for by in (["item", "part"], ["item"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_key), "rank", F.col("doc").alias(key), "score")
