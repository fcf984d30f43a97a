"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed terms (words and word beginnings, lower-cased); how often or where a term occurs doesn't matter, so one
insult in a long text counts as much as in a short one. The machine's score is
    b + sum of w[t] + sum over pairs t < u of <v[t], v[u]>
whose pair part lets two terms mean together what neither means alone, such as an insult and the mention of a group.

Fitting: the labelled rows of a bounded sample give, in Spark, the number of documents of each class with each hashed term. The terms that
tell most about the class are kept; the driver gets the sample's rows as sets of these terms and fits the machine.
Scoring is one pass over the scan without an exchange.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_memory, stash, texts_in_small_batches

#: Bounds of the fitting sample, in documents of each class, and of the terms that are kept.
MOST_TOXIC, MOST_CLEAN, MOST_TERMS = 8_000, 16_000, 2_048
#: A kept term is in so many documents of the sample, and tells so much about the class (G-squared, with one degree of freedom).
LEAST_DOCUMENTS, LEAST_TOLD = 3, 8.0
FACTORS, PASSES, STEPS, BATCH, RATE, SHRINK, SPARE, SEED = 8, 30, 300, 256, 0.02, 2e-3, 4e-4, 7
#: Lengths of the word beginnings that are terms beside the word.
BEGINNINGS = (4, 6)
WORD = re.compile(r"[^\W\d_]+")
#: Words that a worker remembers the terms of.
MEMO = 200_000


def word_terms(word: str) -> list[int]:
    """The hashed terms of a lower-cased word."""
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in (word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n))]


def terms(text: str | None) -> np.ndarray:
    """The distinct hashed terms of a whole text, ascending. None for a null text."""
    words = set(WORD.findall((text or "").lower()))
    return np.array(sorted({t for w in words for t in word_terms(w)}), np.uint32)


@dataclass(frozen=True)
class ToxicityModel:
    """terms: kept hashed terms, ascending; weights and factors: a row for each."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    learned: bool = True

    def logit(self, rows: list[list[int]]) -> np.ndarray:
        """Of texts as lists of places in terms."""
        out = np.full(len(rows), self.bias)
        for i, row in enumerate(rows):
            if row:
                v = self.factors[row]
                out[i] += self.weights[row].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return out

    def score(self, rows: list[list[int]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(rows), -30, 30)))


def nothing_learned(rate: float = 0.5) -> ToxicityModel:
    return ToxicityModel(np.zeros(0, np.uint32), math.log(rate / (1 - rate)), np.zeros(0), np.zeros((0, FACTORS)), learned=False)


def slopes(x: np.ndarray, error: np.ndarray, factors: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Gradient of the summed loss by bias, weights and factors. x: rows x terms of 0 and 1; error: score less label, a row each."""
    by_term = error @ x
    return float(error.sum()), by_term, x.T @ (error[:, None] * (x @ factors)) - by_term[:, None] * factors


def machine(x: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Logits of rows of 0 and 1."""
    return bias + x @ weights + 0.5 * (((x @ factors) ** 2).sum(1) - x @ (factors**2).sum(1))


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, kept: np.ndarray, shift: float = 0.0) -> ToxicityModel:
    """Adam on the logistic loss in batches, with factors shrunk and weights pulled to exactly zero where they earn too little. rows: places in
    kept. shift: what the sample's odds have more than the table's, as a logarithm."""
    n, k = len(rows), len(kept)
    packed = np.zeros((n, (k + 7) // 8), np.uint8)  # a bit for each row and term
    for i, row in enumerate(rows):
        bits = np.zeros(k, bool)
        bits[row] = True
        packed[i] = np.packbits(bits)
    random = np.random.default_rng(SEED)
    rate = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    w = [np.array([math.log(rate / (1 - rate))]), np.zeros(k), random.normal(0, 0.05, (k, FACTORS))]
    first, second, step = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w], 0
    passes = max(PASSES, min(STEPS, STEPS * BATCH // n))  # a small sample is gone over more often
    for done in range(passes):
        pace = RATE * (1 - done / passes)
        for at in np.array_split(random.permutation(n), max(1, n // BATCH)):
            step += 1
            x = np.unpackbits(packed[at], axis=1, count=k).astype(np.float32)
            error = 1 / (1 + np.exp(-np.clip(machine(x, w[0][0], w[1], w[2]), -30, 30))) - labels[at]
            b, by_weight, by_factor = slopes(x, error.astype(np.float32), w[2].astype(np.float32))
            for i, g in enumerate((np.array([b]) / len(at), by_weight / len(at), by_factor / len(at) + SHRINK * w[2])):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g**2
                w[i] = w[i] - pace * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-6)
            w[1] = np.sign(w[1]) * np.maximum(np.abs(w[1]) - pace * SPARE / 1e-2, 0)
    used = (np.abs(w[1]) > 0) | ((w[2] ** 2).sum(1) > 1e-4)
    return ToxicityModel(kept[used], float(w[0][0] - shift), w[1][used], w[2][used])


def _hashed(df: DataFrame) -> DataFrame:
    """k, y, t (a text) to k, y, terms."""
    kind = df.schema["k"].dataType
    schema = T.StructType([T.StructField("k", kind), T.StructField("y", T.IntegerType()), T.StructField("terms", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(v.as_py()).tobytes() for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=schema.names)
        free_memory()

    return texts_in_small_batches(df).select("k", "y", "t").mapInArrow(run, schema)


def _counted(hashed: DataFrame) -> DataFrame:
    """term, toxic, clean: documents of each class with the term, added up in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.array(batch.column(0).to_pylist(), bool)
            parts = [np.frombuffer(v.as_py(), np.uint32) for v in batch.column(1)]
            every = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            of = np.repeat(y, [len(p) for p in parts])
            found, place = np.unique(every, return_inverse=True)
            toxic = np.bincount(place[of], minlength=len(found))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in (found, toxic, np.bincount(place, minlength=len(found)) - toxic)], names=["term", "toxic", "clean"])

    made = hashed.select("y", "terms").mapInArrow(run, "term long, toxic long, clean long")
    return made.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def told(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """G-squared of the class and the presence of a term."""
    n, both = float(n_toxic + n_clean), toxic + clean
    part = lambda seen, row, column: F.when(seen > 0, seen * F.log(seen * F.lit(n) / (row * column))).otherwise(F.lit(0.0))
    here = part(toxic, both, F.lit(float(n_toxic))) + part(clean, both, F.lit(float(n_clean)))
    gone = part(F.lit(n_toxic) - toxic, F.lit(n) - both, F.lit(float(n_toxic))) + part(F.lit(n_clean) - clean, F.lit(n) - both, F.lit(float(n_clean)))
    return 2 * (here + gone)


def fit(documents: DataFrame, labels: DataFrame, where: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Learn from the labelled documents that hold for where (a test of key).

    The sample is bounded: of each class the keys with the smallest hashes, at most MOST_TOXIC and MOST_CLEAN. Keys with labels of both
    classes, null keys and null labels aren't learned from; of repeated documents of a key one counts, the one with the greatest set of terms as
    bytes. Other columns don't matter. Without terms that tell the classes apart the model gives all texts the share of
    toxic labels (0.5 without labels); learned is then False."""
    given = labels.select(F.col(key).alias(key), F.col(label).alias("_y")).where(F.col(key).isNotNull() & F.col("_y").isNotNull())
    given = given if where is None else given.where(where)
    one = given.groupBy(F.col(key).alias("k")).agg(F.min("_y").alias("y"), F.max("_y").alias("high")).where("y = high and y in (0, 1)").select("k", F.col("y").cast("int").alias("y"))
    totals = {r["y"]: r["count"] for r in one.groupBy("y").count().collect()}
    if not totals.get(0) or not totals.get(1):
        return nothing_learned(0.5)
    order = F.xxhash64("k", F.lit(SEED))
    chosen = one.where("y = 1").orderBy(order, "k").limit(MOST_TOXIC).unionByName(one.where("y = 0").orderBy(order, "k").limit(MOST_CLEAN))
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")  # bounded by the limits
    hashed = stash(_hashed(rows).groupBy("k", "y").agg(F.max("terms").alias("terms")), "terms")
    there = {r["y"]: r["count"] for r in hashed.groupBy("y").count().collect()}
    n_toxic, n_clean = there.get(1, 0), there.get(0, 0)
    if not n_toxic or not n_clean:
        return nothing_learned(0.5)
    shift = math.log(n_toxic / n_clean) - math.log(totals[1] / totals[0])
    worth = _counted(hashed).where(F.col("toxic") + F.col("clean") >= LEAST_DOCUMENTS).withColumn("g", told(F.col("toxic"), F.col("clean"), n_toxic, n_clean))
    best = worth.where(F.col("g") >= LEAST_TOLD).orderBy(F.desc("g"), "term").limit(MOST_TERMS).select("term").collect()
    if not best:
        return nothing_learned(totals[1] / (totals[0] + totals[1]))
    kept = np.array(sorted(r["term"] for r in best), np.uint32)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.searchsorted(kept, np.intersect1d(np.frombuffer(v.as_py(), np.uint32), kept)).astype("<u2").tobytes() for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["y", "places"])

    sample = sorted((r["y"], bytes(r["places"])) for r in hashed.select("y", "terms").mapInArrow(places, "y int, places binary").collect())
    return fit_rows([np.frombuffer(p, "<u2").astype(int) for _, p in sample], np.array([y for y, _ in sample], float), kept, shift)


def score(df: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None, out: str = "toxicity") -> DataFrame:
    """df (or its columns keep) with out (0 to 1, higher: likelier toxic), from the whole text. Null texts and texts without words get the
    machine's score of no terms. An input column named like out is replaced; repeated rows and other columns pass."""
    keep = [c for c in (keep or df.columns) if c.lower() != out.lower()]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {int(t): i for i, t in enumerate(model.terms)}
        memo: dict[str, tuple[int, ...]] = {}

        def of(word: str) -> tuple[int, ...]:
            found = tuple(place[t] for t in word_terms(word) if t in place)
            if len(memo) < MEMO:
                memo[word] = found
            return found

        for batch in batches:
            rows = []
            for value in batch.column(text):
                own: set[int] = set()
                for word in set(WORD.findall((value.as_py() or "").lower())):
                    own.update(memo[word] if word in memo else of(word))
                rows.append(sorted(own))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(model.score(rows), pa.float64())], names=schema.names)
        free_memory()

    return texts_in_small_batches(df).select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
