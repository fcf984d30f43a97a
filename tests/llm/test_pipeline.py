"""The pipeline against brute-force versions of its stages on a small corpus."""

import hashlib
import random

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tomewright.llm import bpe, quality_pu
from tomewright.llm.common import held_out

from . import test_decontam, test_line_dedup, test_minhash


def tables(spark, folder):
    draw = random.Random(9)
    vocabulary = [a + b for a in ("the", "ing", "er", "an", "wh", "ou") for b in ("st", "nd", "ly", "ble", "tion", "")]
    sentence = lambda: " ".join(draw.choices(vocabulary, k=draw.randint(6, 25)))
    bench = [(i, " ".join(draw.choices(vocabulary, k=20))) for i in range(6)]
    docs, labels = [], []
    for i in range(260):
        lines = [sentence() for _ in range(draw.randint(2, 8))]
        kind = draw.random()
        if kind < 0.2:
            lines = [" ".join(w.upper() + "!!" for w in x.split()) for x in lines]
        elif kind < 0.3 and docs:
            lines = draw.choice(docs)[1].split("\n")
        elif kind < 0.4 and docs:
            words = draw.choice(docs)[1].replace("\n", " ").split()
            words[draw.randrange(len(words))] = "edited"
            lines = [" ".join(words)]
        elif kind < 0.5:
            lines[0] = draw.choice(bench)[1]
        docs.append((i, "\n".join(lines), "en", f"src{i % 3}", 0))
        if i % 2:
            labels.append((i, int(kind >= 0.2), 0))
    docs = [(i, t, a, b, len(t)) for i, t, a, b, _ in docs]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, bench


def test_run(spark, tmp_path):
    docs, bench = tables(spark, tmp_path)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality_pu.fit(frame, spark.read.parquet(f"{tmp_path}/labels.parquet"), ~held_out())
    good = {r[0] for r in quality_pu.score(frame, model).where(F.col("quality_score") >= 0.7).select("doc_id").collect()}
    assert 100 < len(good) < len(docs)
    rows = [(i, t) for i, t, *_ in docs if i in good]
    cleaned = [(i, t) for i, t, _, exact, close in test_line_dedup.brute(rows) if t.split() or not exact + close]
    kept = {i for i, _, _, first in test_minhash.brute(cleaned, 5, 80, 100) if first}
    rows = [(i, t) for i, t in cleaned if i in kept]
    clean = {i for i, *_, bad in test_decontam.brute(rows, bench) if not bad}
    assert len(clean) < len(rows) < len(docs)
    ranks = bpe.read_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: (library.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows if i in clean}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["token_ids"], r["decoded_sha256"]) for r in got} == want and len(got) == len(want)


def test_stages_keep_columns(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for empty in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, empty, str(tmp_path))
            assert out.dtypes == docs.dtypes and out.count() <= empty.count()


def test_near_duplicates_go_by_id_and_text(spark, tmp_path):
    """Another text under a dropped id stays, a copy without an id goes, and columns named like made ones keep their values."""
    words = [f"w{i}" for i in range(200)]
    copied, other, lone = " ".join(words[:60]), " ".join(words[60:120]), " ".join(words[120:])
    rows = [(1, copied, "a"), (2, copied, "b"), (2, other, "c"), (None, copied, "d"), (None, lone, "e"), (3, None, "f"), (4, "", "g"), (1, copied, "h")]
    df = spark.createDataFrame([(i, t, k, 5) for i, t, k in rows], "doc_id long, text string, component_id string, kept int")
    got = corpus_pipeline.dedup_documents(spark, df, str(tmp_path))
    assert got.columns == df.columns and sorted(r["component_id"] for r in got.collect()) == list("acefgh")


def test_made_names_pass_through(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumns({c: F.lit(f"own {c}") for c in ("quality_score", "n_lines", "N_exact", "n_near", "n_words", "n_hit", "contaminated", "text_hash", "kept")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert all(r[c] == f"own {c}" for r in out.collect() for c in docs.columns[5:])
