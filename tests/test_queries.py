"""Every registered query with SQL gives DuckDB's rows; nothing here needs the language-model package."""

import os

import duckdb
import pytest

from tomewright.plans.catalogue import QUERIES
from tomewright.plans.oracle import ORACLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: round(x, 6) if isinstance(x, float) else x
    return sorted(str(tuple(value(r[i]) for i in order)) for r in found)


@pytest.fixture(scope="module")
def base():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, base, name):
    df, sql = QUERIES[name](spark, SF), base.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows(df.columns, df.collect()) == rows(sql.columns, sql.fetchall())


def test_batch_of_every_fiftieth_vector(spark, base, monkeypatch):
    monkeypatch.setattr("tomewright.plans.catalogue.BATCH_QUERIES", 3)
    found = {r["query_id"] for r in QUERIES["semantic_topk_batch"](spark, SF).collect()}
    assert found == {r[0] for r in base.sql("SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0").fetchall()} and max(found) >= 10


@pytest.mark.parametrize("name", ["lookup_entity_untyped", "lookup_entity_alias", "exact_recall_by_name", "exact_recall", "segments_of_missing_resource"])
def test_found_something(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_chunk_is_appended(spark, tmp_path):
    langs = ["en", "fr", "de", "es", None]
    text = "some words that make a page of a chunk or two " * 3
    rows = [(i, text, lang) for i, lang in enumerate(langs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["legacy_append"](spark, str(tmp_path)).collect()
    assert {(r["source_pdf"] or "")[6:8] for r in got} == {"en", "fr", "de", "es", ""}
    assert sorted(r["id"] for r in got) == list(range(1, len(got) + 1))
    assert QUERIES["legacy_count"](spark, str(tmp_path)).first().asDict() == {"chunks": len(got), "max_id": len(got)}


def test_entry(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__.entry(spark).count() > 0


def test_tables_that_are_folders_stream_too(spark, tmp_path):
    for name in ("documents", "events"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("stream_ingest", "stream_tumbling"):
        got, want = ({tuple(r) for r in QUERIES[name](spark, d).collect()} for d in (str(tmp_path), SF))
        assert got == want and got


def test_components_near_zero_keep_their_sign(spark, base, tmp_path):
    """Rows are compared as texts, in which -0.0 isn't 0.0."""
    documents = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(d, [-1e-7, 1e-7, -0.0, 0.0, 0.5, -0.1234565, float("nan")]) for d in range(60)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    own = duckdb.connect()
    for name in ("documents", "embeddings"):
        own.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("upsert_embeddings", "embedding_lookup"):
        df, sql = QUERIES[name](spark, str(tmp_path)), own.sql(ORACLES[name])
        assert rows(df.columns, df.collect()) == rows(sql.columns, sql.fetchall())


@pytest.mark.parametrize("name", ["semantic_topk", "semantic_topk_batch"])
def test_search_goes_from_vectors_to_segments(spark, name):
    """A vector is found as the one of its document's first segment, not as a row of the given table."""
    segments = {r["id"] for r in QUERIES["segment_ids"](spark, SF).select("id").collect()}
    found = {r["segment_id"] for r in QUERIES[name](spark, SF).collect()}
    assert found and found <= segments


def test_a_file_each_in_folders_of_tasks(spark, tmp_path):
    """Small files are dealt to few tasks; before, each counted as 4 MB."""
    from tomewright.plans.fixtures import write_each
    from tomewright.sources.files import read_files

    texts = [(f"text number {i}",) for i in range(200)]
    write_each(spark.createDataFrame(texts, "text string").repartition(2), f"{tmp_path}/in")
    assert not [f for f in os.listdir(f"{tmp_path}/in") if f.endswith(".txt")]
    spark.conf.set("spark.sql.files.openCostInBytes", "4MB")
    try:
        found = read_files(spark, f"{tmp_path}/in", "files", "*.txt")
        assert found.rdd.getNumPartitions() <= 6
        assert {bytes(r["content"]).decode().strip() for r in found.collect()} == {t for (t,) in texts} and found.count() == 200
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_store_holds_what_was_asked_for_and_hits_are_made_once(spark, tmp_path, monkeypatch):
    """Before, the first query filled every table and searched each text three times."""
    from tomewright.plans import fixtures
    from tomewright.sources.store import TableStore

    searched = []
    extract = fixtures.extract
    monkeypatch.setattr(fixtures, "extract", lambda *a: searched.append(1) or extract(*a))
    x = fixtures.Fixture(spark, SF)
    store = TableStore(spark, f"{tmp_path}/kb", buckets=2)
    first = x.fill(store, ["entities"])
    assert first == {"segments", "hits", "entities"} and store.read("links").isEmpty()
    assert x.fill(store, fixtures.TABLES, first) == {"resources", "links", "mentions", "sketches", "embeddings"} and len(searched) == 1
    assert store.read("links").count() == store.read("mentions").count() == x.links.count()


def test_links_are_extracted_once_for_their_upsert(spark, monkeypatch):
    """Before, the plan searched the texts three times."""
    from tomewright.plans import fixtures

    searched = []
    extract = fixtures.extract
    monkeypatch.setattr(fixtures, "extract", lambda *a: searched.append(1) or extract(*a))
    plan = QUERIES["upsert_links"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(searched) == 1 and "regexp_extract_all" not in plan


def test_search_of_one_finds_vectors_without_a_segment(spark, base):
    """Before, only vectors of documents with a segment were searched: 200 of the 500 here at most."""
    got = QUERIES["semantic_topk"](spark, SF).collect()
    want = base.sql("SELECT vec_id FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) ORDER BY round(list_cosine_similarity(embedding::double[], q::double[]), 12) DESC, vec_id LIMIT 10").fetchall()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [v for (v,) in want]
    assert max(v for (v,) in want) >= base.sql("SELECT count(*) FROM documents").fetchall()[0][0]


def test_search_of_many_finds_vectors_without_a_segment(spark, base):
    """Before, only vectors of documents with a segment were searched."""
    got = QUERIES["semantic_topk_batch"](spark, SF).collect()
    best = {r["query_id"]: r["vec_id"] for r in got if r["rank"] == 1}
    documents = base.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    assert len(got) == 5 * len(best) and {q for q in best if q >= documents} and all(best[q] == q for q in best)
