import numpy as np
import pytest
from pyspark.sql import functions as F

from tomewright.functions.vectors import HashEmbedder, embed
from tomewright.operators import legacy, recall, search, upsert
from tomewright.schemas import TABLES
from tomewright.sources.store import TableStore


def test_upsert(spark):
    known = spark.createDataFrame([(1, "a", "old"), (2, "b", "old")], "id int, x string, kept string")
    incoming = spark.createDataFrame([(2, "c", "new"), (3, "d", "new"), (3, "e", "newer"), (2, None, "last")], "id int, x string, kept string")
    got = {r["id"]: (r["x"], r["kept"]) for r in upsert.upsert(known, incoming, ["id"], ["x"], F.length("kept")).collect()}
    assert got == {1: ("a", "old"), 2: (None, "old"), 3: ("e", "newer")}
    twice = upsert.upsert(known, known, ["id"], ["x"])
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, known.collect()))


def entities(spark):
    rows = [("1", "n", "t", "Alpha", ["Beta"]), ("2", "n", "t", "Beta", []), ("3", "n", "u", "Alpha", []), ("4", "m", "t", "Alpha", [])]
    return spark.createDataFrame(rows, "id string, namespace string, type string, name string, aliases array<string>")


def test_entity_resolution(spark):
    found = lambda *a: [r["id"] for r in recall.resolve_entity(entities(spark), *a).collect()]
    assert found("Beta", "n") == ["1"]  # the alias of an earlier name comes first
    assert found("Beta", "n", "t") == ["2"]  # aliases don't count with a type
    assert found("Alpha", "n") == ["1"] and found("Alpha", "n", "u") == ["3"] and found("alpha", "n") == []


def test_mentions(spark):
    links = spark.createDataFrame([("s1", "1", "mentions", 0.5), ("s1", "1", "cites", 0.5), ("s2", "2", "mentions", 0.5), ("gone", "3", "mentions", 0.5)], "segment_id string, entity_id string, link_type string, confidence float")
    segments = spark.createDataFrame([("s1", "r1"), ("s2", "lost")], "id string, ir_id string")
    counts = lambda least: [(r["id"], r["mention_count"]) for r in recall.most_first(recall.mention_counts(entities(spark), links, segments, "n", least=least)).collect()]
    assert counts(1) == [("1", 2), ("2", 1)]
    assert counts(0) == [("1", 2), ("2", 1), ("3", 0)]
    resources = spark.createDataFrame([("r1", "n", "u1")], "id string, namespace string, source_uri string")
    assert recall.count_segments(segments, resources).first()[0] == 2
    assert recall.count_segments(segments, resources, "n").first()[0] == 1
    rows = recall.segments_for_entity(entities(spark).where("id in ('1', '2')"), links, segments, resources).collect()
    assert sorted((r["segment_id"], r["link_type"], r["source_uri"]) for r in rows) == [("s1", "cites", "u1"), ("s1", "mentions", "u1"), ("s2", "mentions", None)]


def test_comparison(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "segment_id string")
    r = recall.compare(ids("a", "b", "c"), ids("c", "d"), "e").first()
    assert (r["exact_count"], r["semantic_count"], r["overlap_count"], r["missed_by_semantic_count"], r["false_positive_count"]) == (3, 2, 1, 2, 1)
    assert r["recall"] == pytest.approx(1 / 3) and r["precision"] == 0.5 and r["missed_segments"] == ["a", "b"]
    r = recall.compare(ids(), ids(), "e").first()
    assert (r["recall"], r["precision"], r["missed_segments"]) == (0.0, 0.0, [])
    r = recall.compare(ids(*map(str, range(30))), ids(), "e").first()
    assert len(r["missed_segments"]) == 10


def test_vector_search(spark):
    random = np.random.default_rng(3)
    vectors = random.normal(size=(60, 8)).astype(np.float32)
    rows = [(f"s{i:02d}", v.tolist()) for i, v in enumerate(vectors)] + [("zero", [0.0] * 8), ("short", [1.0] * 3), ("twin", vectors[0].tolist())]
    df = spark.createDataFrame(rows, "segment_id string, vector array<float>").repartition(4)
    query = vectors[0].astype(float)
    score = {k: float(np.dot(query, v) / np.linalg.norm(query) / np.linalg.norm(v)) for k, v in rows if len(v) == 8 and any(v)}
    want = sorted(score, key=lambda k: (-round(score[k], 12), k))
    assert [r["segment_id"] for r in search.top_k(df, query.tolist(), 7).collect()] == want[:7]
    assert search.top_k(df, query.tolist(), 0).count() == 0 and search.top_k(df, query.tolist(), 999).count() == len(want)
    with pytest.raises(ValueError):
        search.top_k(df, query.tolist(), -1)
    got = search.top_k_batch(df, {5: query.tolist(), 9: (-query).tolist()}, 4).collect()
    assert [r["segment_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 5] == want[:4]
    assert sum(r["query_id"] == 9 for r in got) == 4


def test_hash_embedder(spark):
    embedder = HashEmbedder(32)
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "n int, text string")
    got = {r["n"]: np.array(r["vector"]) for r in embed(df, embedder).collect()}
    assert np.allclose(got[1], embedder(["a b"])[0]) and np.linalg.norm(got[1]) == pytest.approx(1)
    assert not got[2].any() and not got[3].any()


def test_chunks(spark):
    pages = spark.createDataFrame([("a.pdf", 1, " ".join(map(str, range(100)))), ("a.pdf", 2, "one two"), ("b.pdf", 1, "")], "source_pdf string, page_num int, text string")
    got = sorted((r["source_pdf"], r["page_num"], r["chunk_index"], r["location"], r["content"].split()) for r in legacy.chunk_pages(pages, 40, 10).collect())
    assert [(g[1], g[2], g[3], len(g[4])) for g in got] == [(1, 0, "page_1_chunk_0", 40), (1, 1, "page_1_chunk_1", 40), (1, 2, "page_1_chunk_2", 40), (2, 0, "page_2_chunk_0", 2)]
    assert got[1][4][0] == "30" and got[2][4][-1] == "99"
    with pytest.raises(ValueError):
        legacy.chunk_pages(pages, 10, 10)


def test_legacy_append_and_migration(spark):
    pages = spark.createDataFrame([(f"/d/{k}.pdf", p, f"CCNA001 text {k} {p}") for k in "ba" for p in (2, 1)], "source_pdf string, page_num int, text string")
    chunks = legacy.chunk_pages(pages)
    empty = chunks.select(F.lit(0).cast("long").alias("id"), "source_pdf", "page_num", "chunk_index", "location", "content").limit(0)
    once = legacy.append_chunks(empty, chunks)
    assert [(r["source_pdf"], r["page_num"]) for r in once.orderBy("id").collect()] == [("/d/a.pdf", 1), ("/d/a.pdf", 2), ("/d/b.pdf", 1), ("/d/b.pdf", 2)]
    assert sorted(r["id"] for r in legacy.append_chunks(once, chunks).collect()) == list(range(1, 9))
    sources = {r["source_uri"]: r["content_hash"] for r in legacy.migrate_sources(once, "old", spark.createDataFrame([("/d/a.pdf", "h")], "source_pdf string, content_hash string")).collect()}
    assert sources == {"file:///d/a.pdf": "h", "file:///d/b.pdf": "legacy__d_b.pdf"}
    segments = legacy.migrate_segments(once, "old").collect()
    assert sorted((r["source_uri"], r["segment_index"], r["provenance"]["page"], r["provenance"]["legacy"]) for r in segments) == [(f"file:///d/{k}.pdf", i, i + 1, True) for k in "ab" for i in (0, 1)]


def test_upsert_of_null_keys(spark):
    rows = spark.createDataFrame([(None, "a", 1), ("n", None, 2), (None, None, 3)], "namespace string, source_uri string, v int")
    twice = upsert.upsert(rows, rows.withColumn("v", F.col("v") + 10), ["namespace", "source_uri"], ["v"])
    assert sorted(r["v"] for r in twice.collect()) == [11, 12, 13]


def test_changes_of_null_hashes(spark):
    schema = "namespace string, source_uri string, content_hash string"
    known = spark.createDataFrame([("n", "a", None), ("n", "b", "x"), ("n", "c", None), (None, "d", "x")], schema)
    current = spark.createDataFrame([("n", "a", "y"), ("n", "b", None), ("n", "c", None), (None, "d", "x"), ("n", "e", None)], schema)
    got = {r["source_uri"]: r["status"] for r in upsert.resource_changes(known, current).collect()}
    assert got == {"a": "changed", "b": "changed", "c": "unchanged", "d": "unchanged", "e": "new"}


def test_stale_segments_of_an_emptied_resource(spark):
    known = spark.createDataFrame([("s1", "r1"), ("s2", "r2"), ("s3", "r3")], "id string, ir_id string")
    current = spark.createDataFrame([("s9", "r2")], "id string, ir_id string")
    covered = spark.createDataFrame([("r1",), ("r2",)], "ir_id string")
    assert {r["id"] for r in upsert.stale_segments(known, current, covered).collect()} == {"s1", "s2"}


def test_negative_batch(spark):
    df = spark.createDataFrame([("a", [1.0])], "segment_id string, vector array<float>")
    with pytest.raises(ValueError):
        search.top_k_batch(df, {1: [1.0]}, -1)


def test_store(spark, tmp_path):
    """Merges touch their buckets; a reader of the generation before goes on; a generation without a manifest doesn't count."""
    store = TableStore(spark, f"file://{tmp_path}", buckets=8)
    with pytest.raises(ValueError):
        TableStore(spark, "x", buckets=0)
    assert store.read("segments").count() == 0
    row = lambda i, text: (f"s{i}", "r", None if i % 5 == 0 else f"n{i % 3}", i, text, None, "h", None)
    rows = lambda found, text: spark.createDataFrame([row(i, text) for i in found], TABLES["segments"])
    store.write("segments", rows(range(40), "old"))
    before = store.read("segments")
    assert len(store.merge("segments", rows([3], "new"))) == 1
    assert {r["id"] for r in store.read("segments").where("text = 'new'").collect()} == {"s3"} and store.read("segments").count() == 40
    assert before.where("text = 'old'").count() == 40
    store.merge("segments", rows([50, 51], "more"))
    store.merge("segments", rows([], "none"))
    store.delete("segments", spark.createDataFrame([("s50",), ("s0",)], "id string"))
    assert sorted(r["id"] for r in store.read("segments").collect()) == sorted(f"s{i}" for i in [*range(1, 40), 51])
    assert store.read("segments").where("namespace is null").count() == 7
    assert len(list((tmp_path / "segments" / "manifests").glob("*.json"))) == 2
    (tmp_path / "segments" / "gen=99").mkdir()
    assert TableStore(spark, f"file://{tmp_path}").read("segments").count() == 40
    for _ in range(2):
        store.delete("segments", store.read("segments"))
    assert store.read("segments").count() == 0


def test_store_appends_and_rebuckets(spark, tmp_path):
    """An append leaves what is there as it is; both generations of a bucket are read, merged and cleaned up as one."""
    store = TableStore(spark, f"file://{tmp_path}", buckets=2)
    rows = lambda found: spark.createDataFrame([(i, "s", 1, i, "l", "c", None) for i in found], TABLES["chunks"])
    store.append("chunks", rows(range(20)))
    old = set(store.read("chunks").inputFiles())
    store.append("chunks", rows(range(20, 30)))
    ids = lambda: sorted(r["id"] for r in store.read("chunks").collect())
    assert old < set(store.read("chunks").inputFiles()) and ids() == list(range(30))
    store.merge("chunks", rows([5, 25, 31]))
    assert ids() == [*range(30), 31]
    store.delete("chunks", spark.createDataFrame([(31,), (0,)], "id long"))
    assert ids() == list(range(1, 30))
    store.rebucket("chunks", 7)
    assert ids() == list(range(1, 30)) and len(store.touched("chunks", store.read("chunks"))) > 2
    assert TableStore(spark, f"file://{tmp_path}").merge("chunks", rows([3])) != [] and ids() == list(range(1, 30))


def test_bucket_of_texts(spark, tmp_path):
    """As Spark hashes them, ends and long texts included."""
    store = TableStore(spark, f"file://{tmp_path}", buckets=13)
    for value in ("", "a", "é漢🙂", "x" * 31, "x" * 32, "y" * 100):
        row = spark.createDataFrame([(value, f"{value}!")], "namespace string, source_uri string")
        assert [store.bucket_of("resources", value, f"{value}!")] == store.touched("resources", row)
        assert [store.bucket_of("mentions", value)] == store.touched("mentions", row.selectExpr("namespace AS entity_id"))


def test_what_stays_is_not_shuffled_by_a_deletion(spark, tmp_path, monkeypatch):
    """Before, deleting resources shuffled every row of segments, links, mentions and vectors, most of them twice."""
    import os
    import re

    from tomewright.operators import retention
    from tomewright.plans.fixtures import Fixture

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    plans, left = {}, []
    written = TableStore._written

    def seen(self, table, rows, *rest, **more):
        plans[table] = rows._jdf.queryExecution().executedPlan().toString()
        return written(self, table, rows, *rest, **more)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for few in (retention.FEW, 0):
            store = TableStore(spark, f"{tmp_path}/kb{few}", buckets=2)
            Fixture(spark, sf).fill(store, ["resources", "segments", "links", "mentions", "entities", "embeddings"])
            monkeypatch.setattr(retention, "FEW", few)
            with monkeypatch.context() as m:
                m.setattr(TableStore, "_written", seen)
                counts = retention.delete_resources(store, store.read("resources").where("source_uri like '%3'"))
            own = {t: sorted(map(str, store.read(t).collect())) for t in ("resources", "segments", "links", "mentions", "entities", "embeddings")}
            assert own["links"] and counts["links"] and len(own["mentions"]) == len(own["links"])
            left.append((counts, own))
            joins = {re.search(r"(\w+Join).*LeftAnti", plans[t])[1] for t in ("segments", "links", "mentions", "embeddings")}
            assert joins == {"BroadcastHashJoin" if few else "SortMergeJoin"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert left[0] == left[1]
