"""From raw documents to token ids in five stages: classify quality, deduplicate lines, deduplicate documents,
remove benchmark contamination, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents, also those named like
a column that an operator makes. Null and empty texts are documents like others until a stage says otherwise; repeated rows share
their fate; ids need not be unique; empty tables give no rows.
What a stage returns is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.llm import bpe, decontam, line_dedup, minhash, quality_pu
from tomewright.llm.common import held_out, set_aside, stash, table

#: Documents of a lower quality score go.
LEAST_SCORE = 0.7
#: Bytes of dropped documents' ids and hashes that may be broadcast; beyond that, a shuffled join drops them.
BROADCAST_DROPPED = 16_000_000


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the positive-unlabelled classifier scores 0.7 or more. Without labels nothing can be learned, and all stay."""
    model = quality_pu.fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    if not model.learned:
        return docs
    inner, restored = set_aside(docs, "quality_score")
    return restored(quality_pu.score(inner, model).where(F.col("quality_score") >= LEAST_SCORE))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines, and those one word edit from an earlier one, out of texts; a document that so loses its last word goes. n_chars
    follows the text. Bounds that grow with the length make pairs grow with the square of a hot passage's lines (README)."""
    inner, restored = set_aside(docs, "n_lines", "n_exact", "n_near")
    cleaned = line_dedup.dedup_lines(inner, words_per_edit=None)
    emptied = (F.col("n_exact") + F.col("n_near") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    changed = F.col("n_exact") + F.col("n_near") > 0
    counted = {"n_chars": F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {}
    return restored(cleaned.where(~F.coalesce(emptied, F.lit(False))).withColumns(counted))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least id, of each group of near duplicates: five-word shingles, similarity 0.8. Documents go by id and
    text, so another text under the same id stays; one without an id goes if a document with an id is its copy."""
    gone = minhash.near_duplicates(docs, hashes=True).where("not kept or (doc_id is null and component_id is not null)").select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_text")).distinct()
    gone = stash(gone, "dropped")
    size = gone.agg(F.sum(F.octet_length(F.col("_gone_id").cast("string")) + 16)).first()[0] or 0
    gone = F.broadcast(gone) if size <= BROADCAST_DROPPED else gone
    same = F.col("doc_id").eqNullSafe(F.col("_gone_id")) & (minhash.text_hash("text") == F.col("_gone_text"))
    return docs.join(gone, same, "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that benchmark passages cover to a twentieth of their words or more."""
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each text, and digests of the ids and of the bytes decoded from them."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN, ids="token_ids")


STAGES = [
    ("quality_classifier", classify_quality),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", dedup_documents),
    ("benchmark_decontamination", decontaminate),
    ("byte_bpe", encode),
]

#: The classifier, the components and the merges aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stash(docs, name)
    return docs
