"""Language identification by compression: the dictionary that makes a text smallest names its language.

For each learned language a zstandard raw-content dictionary is filled with slices of its training
texts, lower-cased. A text is cut into blocks, each block is compressed with every dictionary, and the sizes add
up over the whole text, so that a long text is judged by all of it and not by its beginning.
The verdict is rejected if the best and second sizes lie too close.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_memory, texts_in_small_batches

UNKNOWN = "und"
#: Bounds of the training sample: texts a language, characters a text (a slice from a place set by the key's hash),
#: bytes of a dictionary (shared evenly by the texts), languages.
SAMPLE_TEXTS, SLICE_CHARS, DICTIONARY_BYTES, MOST_LANGUAGES = 200, 600, 110_000, 1_000
BLOCK_CHARS, LEVEL = 700, 6
#: Relative margins: below the first the verdict is rejected; at the second the score is 1.
REJECT_MARGIN, SURE_MARGIN = 0.01, 0.12
_letter = regex.compile(r"\p{L}").search


@dataclass(frozen=True)
class LanguageModel:
    dictionaries: tuple[tuple[str, bytes], ...]


def fit(df: DataFrame, where: Column | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_texts: int = SAMPLE_TEXTS, most_languages: int = MOST_LANGUAGES) -> LanguageModel:
    """Learn dictionaries from rows of df that hold for where, with a language and a text that has letters.

    The sample is bounded: the sample_texts texts with the smallest key hashes of each language, and each gives
    at most its even share of DICTIONARY_BYTES, in whole characters. More than most_languages languages are an error, as every task holds all
    dictionaries. Row counts of all languages set a hash limit first, so the window that picks texts sees about twice the
    sample. Repeated rows count as rows; rows of a null key aren't learned from."""
    rows = df.where(where) if where is not None else df
    rows = rows.where(F.col(key).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()}
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages to learn")
    if not counts:
        return LanguageModel(())
    limits = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, int((1 << 30) * min(1.0, 2 * sample_texts / n + 20 / n)))])
    offset = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - SLICE_CHARS, F.lit(1))) + 1
    picked = (
        rows.where(F.col("h") <= limits[F.col("lang")])
        .select("lang", "h", F.substring("text", offset.cast("int"), F.lit(SLICE_CHARS)).alias("slice"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "slice")))
        .where(F.col("rank") <= sample_texts)
        .orderBy("lang", "rank")
        .collect()
    )
    slices: dict[str, list[bytes]] = {}
    for r in picked:
        slices.setdefault(r["lang"], []).append(r["slice"].lower().encode("utf-8")[: DICTIONARY_BYTES // sample_texts - 1].decode("utf-8", "ignore").encode("utf-8"))
    made = []
    for name in sorted(slices):
        joined = b"\n".join(slices[name])
        while 0 < len(joined) < 1024:  # too short a dictionary is refused by the library
            joined += b"\n" + joined
        made.append((name, joined))
    return LanguageModel(tuple(made))


class Predictor:
    def __init__(self, model: LanguageModel):
        self.compressors = []
        for name, content in model.dictionaries:
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=LEVEL)
            options = {"dict_data": dictionary, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
            self.compressors.append((name, zstandard.ZstdCompressor(level=LEVEL, **options).compress))

    def sizes(self, text: str) -> list[tuple[int, str]]:
        text = text.lower()
        step = max(1, -(-len(text) // max(1, round(len(text) / BLOCK_CHARS))))
        blocks = [text[i : i + step].encode("utf-8") for i in range(0, len(text), step)]
        return sorted((sum(len(compress(b)) for b in blocks), name) for name, compress in self.compressors)

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, relative margin."""
        if text is None or not self.compressors or _letter(text) is None:
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(text)
        if len(sizes) == 1:
            return sizes[0][1], 1.0, 1.0
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        return sizes[0][1], min(1.0, margin / SURE_MARGIN), margin


def identify(df: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None, reject_margin: float = REJECT_MARGIN) -> DataFrame:
    """df (or its columns keep) with lang_best, lang_score (0 to 1), lang_margin, lang_rejected, and lang_id: lang_best,
    or 'und' if rejected. A null text, or one without a letter, is 'und' with score 0 and rejected; of equal sizes the first name
    wins, with margin 0. A text is compressed whole, in blocks, however long it is; repeated rows each give a row; columns named like made
    ones are replaced. One pass, no exchange."""
    made = [("lang_best", T.StringType()), ("lang_score", T.DoubleType()), ("lang_margin", T.DoubleType()), ("lang_rejected", T.BooleanType()), ("lang_id", T.StringType())]
    taken = {name for name, _ in made}
    keep = [c for c in (keep or df.columns) if c.lower() not in taken]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(name, kind) for name, kind in made])

    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(sent.value)
        for batch in batches:
            found = [predictor.predict(v.as_py()) for v in batch.column(text)]
            best, score, margin = ([f[i] for f in found] for i in range(3))
            rejected = [m < reject_margin for m in margin]
            columns = [pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_()), pa.array([UNKNOWN if r else b for b, r in zip(best, rejected, strict=True)], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + columns, names=schema.names)
        free_memory()

    return texts_in_small_batches(df).select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
