"""Every query of the package runs on the driver's smallest tables; those with SQL give DuckDB's rows, the others keep their contracts."""

import hashlib
import os
import struct
import zlib

import duckdb
import public_tokenizers
import pytest
import tiktoken

from tomewright.llm import bpe
from tomewright.llm.oracles import ORACLES
from tomewright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str(tuple(r[i] for i in order)) for r in found)


@pytest.fixture(scope="module")
def base():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, base, name):
    df, sql = QUERIES[name](spark, SF), base.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows(df.columns, df.collect()) == rows(sql.columns, sql.fetchall())


@pytest.fixture(scope="module")
def documents(base):
    return {r[0]: (r[1], r[2]) for r in base.sql("SELECT doc_id, text, lang FROM documents").fetchall()}


def test_op1(spark, documents):
    got = QUERIES["op1_hilbert_shards"](spark, SF).collect()
    by = {}
    for r in got:
        raw = (documents[r["doc_id"]][0] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(r["doc_id"] for r in got) == sorted(documents)
    assert sorted(by) == list(range(40)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    counts = [len(s) for s in by.values()]
    assert max(counts) - min(counts) <= 1


def test_op2(spark, documents):
    ranks = bpe.read_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op2_byte_bpe"](spark, SF).collect()}
    assert set(got) == set(documents)
    for key, (text, _) in documents.items():
        ids = library.encode_ordinary(text or "")
        assert got[key] == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


@pytest.mark.parametrize("name", ["op7_quality_pu", "op10_language_id"])
def test_models(spark, documents, name):
    got = QUERIES[name](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(documents)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        if "predicted" in r:
            assert r["predicted"] == int(r["score"] >= 0.7)
        else:
            text = documents[r["doc_id"]][0]
            assert r["lang_pred"] in {"en", "fr", "de", "es", "und"}
            assert (r["lang_pred"] == "und") == (text is None or not any(c.isalpha() for c in text))
