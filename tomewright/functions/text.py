"""Text as columns: white space, sentences, batches of sentences, previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip and str.split see it: Unicode's, and the separators 1C to 1F.
SPACE = r"[\s\x1C-\x1F]"
#: A sentence ends at one of .!? before white space and a capital of ASCII; shorter ones are dropped.
SENTENCE_END = rf"(?U)(?<=[.!?]){SPACE}+(?=[A-Z])"
LEAST_SENTENCE = 20


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def normalize(text: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"(?U){SPACE}+", " "))


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def sentences(text: Column) -> Column:
    """Trimmed sentences of 20 characters or more."""
    parts = F.transform(F.split(text, SENTENCE_END, -1), trim_space)
    return F.filter(parts, lambda s: F.length(s) >= LEAST_SENTENCE)


def batches(found: Column, per_segment: int) -> Column:
    """Groups of per_segment sentences: array of (sentence, sentence_count, text), sentence being the first one's place."""
    if per_segment < 1:
        raise ValueError("sentences_per_segment must be 1 or more")

    def batch(i: Column) -> Column:
        part = F.slice(found, i * per_segment + 1, F.lit(per_segment))
        return F.struct((i * per_segment).cast("int").alias("sentence"), F.size(part).alias("sentence_count"), F.array_join(part, " ").alias("text"))

    last = F.floor((F.size(found) - 1) / per_segment).cast("int")
    made = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), batch)
    return F.filter(made, lambda b: b["sentence_count"] > 0)


def preview(text: Column, size: int = 50) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)
