"""Entity extraction: patterns as data, hits as rows, a heuristic confidence."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trim_space

#: The default patterns, in their order.
DEFAULT_PATTERNS = (
    ("strain", r"\b[A-Z]{2,4}[A-Z0-9]{3,6}\b"),
    ("gene", r"\b[A-Z]{2,5}[0-9]{1,2}\b"),
    ("protein", r"\b[a-zA-Z]{2,4}[0-9]{1,3}\b"),
    ("email", r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"),
    ("doi", r"\b10\.\d{4,}/[-._;()/:a-zA-Z0-9]+\b"),
    ("pmid", r"\bPMID:?\s*(\d{7,8})\b"),
    ("accession", r"\b[A-Z]{1,3}\d{5,7}\b"),
)
#: Types whose format alone is strong evidence.
SURE_TYPES = ("email", "doi", "pmid")


@dataclass(frozen=True)
class PatternSet:
    """Named regular expressions. Changing one makes a new set."""

    patterns: tuple[tuple[str, str], ...] = DEFAULT_PATTERNS
    case_sensitive: bool = True
    min_confidence: float = 0.5

    def __post_init__(self):
        if not 0 <= self.min_confidence <= 1:
            raise ValueError("min_confidence must lie between 0 and 1")
        for kind, pattern in self.patterns:
            try:
                re.compile(pattern)
            except re.error as error:
                raise ValueError(f"pattern of {kind}: {error}") from error

    def check(self, spark: SparkSession) -> None:
        """Patterns run in the JVM, whose syntax differs in places: ValueError for what it doesn't take."""
        for kind, pattern in self.patterns:
            try:
                spark._jvm.java.util.regex.Pattern.compile(self.regex(pattern))
            except IllegalArgumentException as error:
                raise ValueError(f"pattern of {kind}: {error}") from error

    def add(self, kind: str, pattern: str) -> PatternSet:
        """With the pattern in kind's place, or at the end."""
        known = dict(self.patterns) | {kind: pattern}
        return replace(self, patterns=tuple(known.items()))

    def remove(self, kind: str) -> PatternSet:
        return replace(self, patterns=tuple(p for p in self.patterns if p[0] != kind))

    def names(self) -> list[str]:
        return [kind for kind, _ in self.patterns]

    def regex(self, pattern: str) -> str:
        return ("(?U)" if self.case_sensitive else "(?iuU)") + pattern


def confidence(name: Column, kind: Column) -> Column:
    """0.7, and more for six characters, mixed case, a digit, a sure type; 1 at most. The order of the sum is part of the definition."""
    part = lambda test, value: F.when(test, F.lit(value)).otherwise(F.lit(0.0))
    mixed = name.rlike(r"\p{Lu}") & name.rlike(r"\p{Ll}")
    bonus = part(F.length(name) >= 6, 0.1) + part(mixed, 0.1) + part(name.rlike(r"\p{Nd}"), 0.05) + part(kind.isin(*SURE_TYPES), 0.2)
    return F.least(F.lit(1.0), F.lit(0.7) + bonus)


def hits(text: Column, patterns: PatternSet) -> Column:
    """Array of (type, name, confidence): each name once for a type, in the patterns' order."""

    def of(kind: str, pattern: str) -> Column:
        found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(patterns.regex(pattern)), F.lit(0)), trim_space))
        return F.transform(found, lambda name: F.struct(F.lit(kind).alias("type"), name.alias("name"), confidence(name, F.lit(kind)).alias("confidence")))

    every = F.flatten(F.array(*[of(*p) for p in patterns.patterns]))
    return F.filter(every, lambda h: h["confidence"] >= patterns.min_confidence)


def extract(df: DataFrame, patterns: PatternSet | None = None, text: str = "text") -> DataFrame:
    """df with a row per hit: type, name, confidence. One pass over the texts for all patterns."""
    patterns = patterns or PatternSet()
    patterns.check(df.sparkSession)
    if not patterns.patterns:
        return df.select("*", F.lit("").alias("type"), F.lit("").alias("name"), F.lit(0.0).alias("confidence")).limit(0)
    return df.select("*", F.explode(hits(F.col(text), patterns)).alias("_hit")).select(*df.columns, "_hit.type", "_hit.name", "_hit.confidence")


class EntityExtractor:
    """What a custom extractor must offer: extract(text) gives (type, name, confidence) tuples. It runs in
    Arrow batches inside Python workers, and is the slow path beside patterns."""

    def extract(self, text: str) -> list[tuple[str, str, float]]:
        raise NotImplementedError

    def extract_batch(self, texts: list[str]) -> list[list[tuple[str, str, float]]]:
        return [self.extract(t) for t in texts]


def extract_with(df: DataFrame, extractor: EntityExtractor, text: str = "text") -> DataFrame:
    """extract() by a custom extractor. Confidences outside 0 to 1 are an error."""
    @F.pandas_udf("array<struct<type:string,name:string,confidence:double>>")
    def run(texts: pd.Series) -> pd.Series:
        found = extractor.extract_batch([t or "" for t in texts])
        for row in found:
            for kind, name, value in row:
                if not 0 <= value <= 1:
                    raise ValueError(f"confidence {value} of {kind} {name!r} isn't between 0 and 1")
        return pd.Series([[{"type": k, "name": n, "confidence": float(c)} for k, n, c in dict.fromkeys(row)] for row in found])

    return df.select("*", F.explode(run(F.col(text))).alias("_hit")).select(*df.columns, "_hit.type", "_hit.name", "_hit.confidence")
