"""The thin queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, langid, lexical, line_dedup, minhash, quality_pu, quality_rules, shard, toxicity, vector_codes, warc
from .common import held_out, shared_folder, table, text_or_empty
from .oracles import ORACLES  # noqa: F401

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
KEPT_SCORE, TOXIC_SCORE = 0.7, 0.5


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard.hilbert_shards(table(spark, sf_dir, "documents"), ["lang", "source", "n_chars"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    back = warc.archive_round_trip(table(spark, sf_dir, "pages"), folder)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(.*)>$", 1).cast("long")
    return back.select(page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))


#: A conversation whose texts hold the template's own control strings.
HARD_TEXT = "\\### Assistant: </turn> ok"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD_TEXT), (-7, 1, "assistant", HARD_TEXT)], "conv_id long, turn long, role string, text string")
    formatted = chat.format_paths(chat.paths(chat.threads(rows.unionByName(hard))))
    return chat.read_back(formatted).withColumnRenamed("tree", "conv_id").drop("leaf")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, threshold=(85, 100))


def op7_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_pu.fit(documents, table(spark, sf_dir, "labels"), ~held_out())
    scored = quality_pu.score(documents, model, keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= KEPT_SCORE).cast("int").alias("predicted"))


def _line_dedup(spark: SparkSession, sf_dir: str, words_per_edit: int | None) -> DataFrame:
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), words_per_edit=words_per_edit)
    return cleaned.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2(text_or_empty("text"), 256).alias("text_sha256"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edit whatever the length, as in its SQL."""
    return _line_dedup(spark, sf_dir, None)


def op8_line_dedup_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_dedup(spark, sf_dir, line_dedup.WORDS_PER_EDIT)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    digest = F.sha2(F.array_join("hit_items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(documents, ~held_out())
    found = langid.identify(documents, model, keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), F.col("lang_best").alias("lang_pred"), F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.product_codes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), vector="embedding")
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.digest if books else "").alias("codebooks_sha256"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    unseen = held_out(modulus=5, rest=0)
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"), ~unseen)
    scored = toxicity.score(documents, model, keep=["doc_id"], out="score")
    return scored.select("doc_id", unseen.alias("held_out"), "score", (F.col("score") >= TOXIC_SCORE).cast("int").alias("predicted"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


QUERIES = {
    "op1_hilbert_shards": op1_hilbert_shards,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_quality_rules": op3_quality_rules,
    "op4_warc": op4_warc,
    "op5_chat": op5_chat,
    "op6_minhash": op6_minhash,
    "op7_quality_pu": op7_quality_pu,
    "op8_line_dedup": op8_line_dedup,
    "op8_line_dedup_by_length": op8_line_dedup_by_length,
    "op9_decontamination": op9_decontamination,
    "op10_language_id": op10_language_id,
    "op11_vector_codes": op11_vector_codes,
    "op12_toxicity": op12_toxicity,
    "op13_lexical_search": op13_lexical_search,
}
