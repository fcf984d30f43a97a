"""Extractors as table functions of SQL: SELECT s.id, e.* FROM segments AS s, LATERAL extract_entities(s.text, 'token', '\\b[A-Z]\\w+')."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..shipping import ship
from .extract import EntityExtractor

#: Columns that a caller may ask for beside type and name.
EXTRAS = {"confidence": DoubleType(), "position": IntegerType()}


def table_function(extractor: EntityExtractor):
    """A polymorphic table function: f(text) gives type and name, f(text, 'confidence,position') these columns as well; the schema follows from the
    constant second argument. position is the hit's place in the extractor's list. A null text has no rows, and hits that the extractor
    repeats are rows of their own once only."""

    class Extract:
        @staticmethod
        def analyze(text: AnalyzeArgument, extras: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not isinstance(text.dataType, StringType):
                raise ValueError("the first argument must be a string")
            if extras is not None and not extras.isConstantExpression:
                raise ValueError("the columns asked for must be a constant")
            wanted = [c.strip() for c in ((extras.value if extras is not None else None) or "").split(",") if c.strip()]
            schema = StructType().add("type", StringType()).add("name", StringType())
            for c in wanted:
                if c not in EXTRAS:
                    raise ValueError(f"no column {c}: {', '.join(EXTRAS)}")
                schema = schema.add(c, EXTRAS[c])
            return AnalyzeResult(schema=schema)

        def eval(self, text: str, extras: str | None = None) -> Iterator[tuple]:
            wanted = [c.strip() for c in (extras or "").split(",") if c.strip()]
            for place, (kind, name, value) in enumerate(dict.fromkeys(extractor.extract(text) if text is not None else ())):
                if not 0 <= value <= 1:
                    raise ValueError(f"confidence {value} of {kind} {name!r} isn't between 0 and 1")
                yield (kind, name, *({"confidence": float(value), "position": place}[c] for c in wanted))

    return udtf(Extract)


def register(spark: SparkSession, name: str, extractor: EntityExtractor) -> None:
    """Make the extractor callable in the session's SQL."""
    ship(spark).udtf.register(name, table_function(extractor))
