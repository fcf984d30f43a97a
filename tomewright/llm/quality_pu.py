"""Quality classifier learned from trusted positives and unlabelled text.

Positive-unlabelled learning: with P trusted good documents, U web text of unknown quality and the
share pi of good documents in U, the risk of a scorer g is
    pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)])
whose second term, the risk on the unseen negatives, is held at zero or above (non-negative risk). pi is estimated from the
same sample: over regions of high scores of a first P-against-U scorer, the least ratio of U's share to P's share.

The scorer is a small network over surface statistics of a whole text. Fitting is on the driver over a
bounded sample of feature rows; scoring is one pass over the scan without an exchange.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_memory, texts_in_small_batches

#: Bounds of the fitting sample, in documents.
MOST_POSITIVE, MOST_UNLABELLED = 12_000, 24_000
HIDDEN, STEPS, RATE, DECAY, SEED = 16, 600, 0.02, 1e-4, 7
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
N_FEATURES = len(PUNCTUATION) + 18


def features(text: str | None) -> list[float]:
    """Surface statistics of a whole text: shares of character classes, repetition of words and lines,
    word and line lengths. A null or empty text has zeros."""
    raw = (text or "").encode("utf-8")
    words = raw.split()
    if not words:
        return [0.0] * N_FEATURES
    byte_count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    visible = max(1, int(byte_count[33:].sum()))
    upper, lower, digits, high = (int(byte_count[a:b].sum()) for a, b in ((65, 91), (97, 123), (48, 58), (128, 256)))
    n = len(words)
    counts = Counter(words)
    top = max(counts.values())
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = len(set(zip(words, words[1:], strict=False))) if n > 1 else 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    line_kinds = len(set(lines))
    root = lambda x: float(np.sqrt(x))
    return [
        *(root(byte_count[b] / visible) for b in PUNCTUATION),
        upper / max(1, upper + lower),
        digits / visible,
        high / visible,
        visible / n / 10,
        np.log1p(n) / 10,
        top / n,
        repeats / n,
        1 - pairs / max(1, n - 1),
        len(counts) / n,
        len(counts) / n**0.8,
        1 - line_kinds / len(lines),
        np.log1p(n / len(lines)) / 5,
        np.log1p(len(lines)) / 5,
        sum(len(x) < 60 for x in lines) / len(lines),
        max(map(len, words)) / visible,
        min(1.0, max(map(len, words)) / 100),
        len(zlib.compress(raw, 1)) / len(raw),
        1.0 if n < 10 else 0.0,
    ]


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, ...]
    prior: float
    learned: bool = True

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(_forward(self.weights, _standard(x, self.mean, self.scale))[1])


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -8, 8)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _forward(w: tuple[np.ndarray, ...], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ w[0] + w[1])
    return hidden, hidden @ w[2] + w[3]


def _train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None) -> tuple[np.ndarray, ...]:
    """Adam on the non-negative risk; with prior None, on the plain balanced loss of P against U."""
    random = np.random.default_rng(SEED)
    d = positive.shape[1]
    w = [random.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), random.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
    x = np.vstack([positive, unlabelled])
    n_p, n_u = len(positive), len(unlabelled)
    for step in range(1, STEPS + 1):
        hidden, z = _forward(tuple(w), x)
        p, u = _sigmoid(z[:n_p]), _sigmoid(z[n_p:])
        # Logistic loss: its slope is sigmoid - 1 for a positive and sigmoid for a negative.
        if prior is None:
            slope = np.concatenate([(p - 1) / n_p, u / n_u])
        else:
            negative_risk = -np.log(1 - u + 1e-12).mean() - prior * -np.log(1 - p + 1e-12).mean()
            if negative_risk >= 0:
                slope = np.concatenate([prior * (p - 1) / n_p - prior * p / n_p, u / n_u])
            else:  # step back from where the estimate of the negatives' risk has gone below zero
                slope = np.concatenate([prior * p / n_p, -u / n_u])
        back = np.outer(slope, w[2]) * (1 - hidden**2)
        grads = [x.T @ back, back.sum(0), hidden.T @ slope, np.array([slope.sum()])]
        for i, g in enumerate(grads):
            g = g + DECAY * w[i] * (i in (0, 2))
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g**2
            w[i] = w[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return tuple(w)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives in unlabelled: the least ratio of U's to P's share over the regions 'scored at least c', each with a
    margin for the sample's size. Scores come from a P-against-U scorer fitted on the other half of both."""
    ratios = []
    for half in (0, 1):
        w = _train(positive[half::2], unlabelled[half::2], None)
        p, u = (np.sort(_forward(w, x[1 - half :: 2])[1]) for x in (positive, unlabelled))
        cuts = np.quantile(p, np.linspace(0, 0.9, 91))
        share_p = 1 - np.searchsorted(p, cuts) / len(p)
        share_u = 1 - np.searchsorted(u, cuts) / len(u)
        margin = np.sqrt(1 / len(p)) + np.sqrt(1 / len(u))
        best = np.argmin((share_u + margin) / share_p)
        ratios.append(share_u[best] / share_p[best])
    # Less the sample's error: a prior too high leaves the risk of negatives at its bound, and junk unlearned; one a
    # little too low only lowers good documents' scores by its share.
    return float(np.clip(np.mean(ratios) - len(positive) ** -0.5, 0.05, 0.99))


def fit_rows(positive: np.ndarray, unlabelled: np.ndarray) -> QualityModel:
    """A model from feature rows. Without either kind of rows every document scores 0.5."""
    if len(positive) < 4 or len(unlabelled) < 4:
        zero = (np.zeros((N_FEATURES, 1)), np.zeros(1), np.zeros(1), np.zeros(1))
        return QualityModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), zero, 0.5, learned=False)
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 0.01
    p, u = _standard(positive, mean, scale), _standard(unlabelled, mean, scale)
    prior = estimate_prior(p, u)
    return QualityModel(mean, scale, _train(p, u, prior), prior)


def _feature_rows(df: DataFrame, text: str, most: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.asarray(features(v.as_py()), "<f4").tobytes() for v in batch.column(1)], pa.binary())], names=["k", "x"])
        free_memory()

    # A repeated text of a key counts once, and of a key's many texts no more than the limit come to the driver.
    made = texts_in_small_batches(df).select("k", text).mapInArrow(run, T.StructType([df.schema["k"], T.StructField("x", T.BinaryType())]))
    rows = made.distinct().orderBy(F.xxhash64("k", "x"), "x").limit(most).select("x").collect()
    return np.array(sorted((np.frombuffer(r["x"], "<f4") for r in rows), key=bytes), dtype=float).reshape(-1, N_FEATURES)


def fit(documents: DataFrame, labels: DataFrame, where: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "quality") -> QualityModel:
    """Learn from documents that hold for where. Trusted positives are documents all of whose labels are 1; zeros are not used.

    Both samples are bounded: the rows with the smallest key hashes, at most MOST_POSITIVE and about MOST_UNLABELLED (twice that at most). Rows of
    a null key aren't learned from; repeated rows count once; columns besides key, text and label don't matter; of ties by hash the least key is taken.
    Empty tables, or too few rows, give a model that scores everything 0.5 (learned is False)."""
    rows = (documents.where(where) if where is not None else documents).where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    order = F.xxhash64("k", F.lit(SEED))
    trusted = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(label).alias("low"), F.max(label).alias("high")).where("low = 1 and high = 1")
    if where is not None:
        trusted = trusted.where(where) if key == "k" else trusted.withColumnRenamed("k", key).where(where).withColumnRenamed(key, "k")
    ids = F.broadcast(trusted.orderBy(order, "k").limit(MOST_POSITIVE).select("k"))  # bounded by the limit
    positive = _feature_rows(rows.join(ids, "k"), "t", MOST_POSITIVE)
    share = min(1.0, MOST_UNLABELLED / max(1, rows.count()))
    unlabelled = _feature_rows(rows.where(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30))), "t", 2 * MOST_UNLABELLED)
    return fit_rows(positive, unlabelled)


def score(df: DataFrame, model: QualityModel, text: str = "text", keep: list[str] | None = None, out: str = "quality_score") -> DataFrame:
    """df (or its columns keep) with out (0 to 1, higher: label 1 likelier), from the whole text. Null and empty texts get the
    score of a text without words. An input column named like out is replaced; repeated rows and extra columns pass."""
    keep = [c for c in (keep or df.columns) if c.lower() != out.lower()]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(v.as_py()) for v in batch.column(text)], dtype=float).reshape(-1, N_FEATURES)
            made = model.score(x.astype("<f4").astype(float)) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(made, pa.float64())], names=schema.names)
        free_memory()

    return texts_in_small_batches(df).select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
