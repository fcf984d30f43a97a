import random
import re

import pyarrow as pa

from tomewright.llm import decontam


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, window=13):
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for item, phrase in items:
            p = words(phrase)
            if not p:
                continue
            size = min(window, len(p))
            for k in range(len(p) - size + 1):
                for i in range(len(w) - size + 1):
                    if w[i : i + size] == p[k : k + size]:
                        hit.update(range(i, i + size))
                        found.add(item)
        named = sorted(str(x) for x in found if x is not None)
        out.append((key, len(w), len(hit), len(found), named, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def data(seed):
    draw = random.Random(seed)
    some = lambda n, v: [draw.choice(v) for _ in range(n)]
    vocabulary = ["the", "cat", "sat", "ÜBER", "é1", "42", "dog", "ran"]
    items = [(i, " ".join(some(draw.randint(1, 30), vocabulary + ["rare"]))) for i in range(2, 14)] + [(1, ""), (15, None), (None, "the"), (7, "cat-sat; 42"), (16, "a " * 14)]
    docs = [(0, None), (1, ""), (2, "!!"), (3, "x " * 300), (4, "a " * 200)]
    for i in range(5, 60):
        text = some(draw.randint(0, 80), vocabulary + ["other", "word"] * 3)
        if draw.random() < 0.6:
            at = draw.randint(0, len(text))
            text[at:at] = [w.upper() for w in (draw.choice(items)[1] or "").split()]
        docs.append((i, draw.choice([" ", ", ", "\n"]).join(text)))
    return docs + docs[5:8], items


def result(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], list(r["hit_items"]), r["contaminated"]) for r in df.collect()), key=str)


def test_equal_to_brute_force(spark):
    docs, items = data(1)
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find(df, bench)
    assert found.columns.count("n_hit") == 1
    assert result(found) == brute(docs, items)
    # Several blocks of items and a shard for each few texts change nothing.
    many = decontam.find(df, bench, block_bytes=60)
    assert result(many) == brute(docs, items)
    assert many._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_small_shards(spark, monkeypatch):
    """Where shards end doesn't show: of a text each, of a few, of all."""
    docs, items = data(2)
    phrases = decontam.phrases_of([(None if i is None else str(i), t) for i, t in items if t])
    want = {(k, n) for k, _, n, *_ in brute(docs, items)}
    batch = pa.RecordBatch.from_pydict({"doc_id": [k for k, _ in docs], "text": pa.array([t for _, t in docs], pa.string())})
    for size in (1, 500, 10_000_000):
        monkeypatch.setattr(decontam, "SHARD_BYTES", size)
        got = set()
        for shard in decontam._shards(iter([batch.slice(0, 20), batch.slice(20)]), "text"):
            keys = [k.as_py() for part in shard for k in part.column("doc_id")]
            hits = decontam._hits([decontam.ids_of(t.as_py(), phrases.vocabulary) for part in shard for t in part.column("text")], phrases)
            got |= {(k, sum(b - a for a, b in spans)) for k, (spans, _, _) in zip(keys, hits, strict=True)}
        assert got == want


def test_long_text(spark):
    phrase = " ".join(f"p{i}" for i in range(20))
    text = "word " * 300_000 + phrase + " word" * 10
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (r,) = decontam.find(df, spark.createDataFrame([(None, phrase)], "item_id long, text string")).collect()
    assert (r["n_words"], r["n_hit"], r["n_items"], r["hit_items"], r["contaminated"]) == (300_030, 20, 1, [], False)


def test_empty_tables(spark):
    docs, items = data(3)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontam.find(df.limit(0), bench).count() == 0
    assert result(decontam.find(df, bench.limit(0))) == brute(docs, [])


def test_removal_leaves_other_columns_alone(spark):
    df = spark.createDataFrame([(1, "clean text", 7, "x", True), (2, None, 8, "y", None)], "doc_id long, text string, n_words int, N_HIT string, contaminated boolean")
    bench = spark.createDataFrame([(1, "some phrase")], "item_id long, text string")
    got = decontam.remove(df, bench)
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_removal(spark):
    phrase = " ".join(f"p{i}" for i in range(15))
    df = spark.createDataFrame([(1, f"Start, {phrase}! end here"), (2, "clean text"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, phrase)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontam.remove(df, bench).collect()) == [2, 3]
    cut = {r["doc_id"]: r["text"] for r in decontam.remove(df, bench, whole=False).collect()}
    assert cut == {1: "Start, ! end here", 2: "clean text", 3: None}
