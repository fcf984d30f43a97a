"""Known names, table functions, sketches and metadata against plain loops."""

import hashlib
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomewright.functions import metadata
from tomewright.functions.vectors import HashEmbedder
from tomewright.operators import dictionary, order_stats, sketches, table_functions
from tomewright.operators.extract import EntityExtractor

ENTITIES = [
    ("e1", "n", "Alpha", ["alpha", "Alpha"]),
    ("e2", "n", "Alpha Beta", None),
    ("e3", "n", "C++", []),
    ("e4", "m", "Alpha", ["Ärger"]),
    ("e5", None, "Alpha", []),
    ("e6", "n", "", [None, "beta", ""]),
    ("e7", "n", "alpha", []),
]
TEXTS = [(1, "n", "Alpha Beta and alpha, Alphas; C++! xAlpha Alpha_ alpha"), (2, "m", "Alpha Ärger Ärgern"), (3, None, "Alpha"), (4, "n", None), (5, "n", ""), (6, "k", "Alpha"), (1, "n", "beta")]


def brute():
    out = []
    for i, ns, text in TEXTS:
        for e, own, name, aliases in ENTITIES:
            if own != ns:
                continue
            times = 0
            for form in {f for f in [name, *(aliases or [])] if f}:
                before = r"(?<!\w)" if re.match(r"\w", form) else ""
                after = r"(?!\w)" if re.search(r"\w$", form) else ""
                times += len(re.findall(f"(?={before}{re.escape(form)}{after})", text or ""))
            if times:
                out.append((i, e, times))
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [dictionary.BLOCK_BYTES, 20])
def test_known_names(spark, block_bytes):
    entities = spark.createDataFrame(ENTITIES, "id string, namespace string, name string, aliases array<string>")
    texts = spark.createDataFrame([(*t, "x") for t in TEXTS], "id long, namespace string, text string, entity_id string")
    got = dictionary.known_names(texts, entities, block_bytes=block_bytes).collect()
    want = brute()
    if block_bytes == 20:  # rows of one text and entity are added up over blocks, so over repeated texts as well
        assert {(r["id"], r["entity_id"]) for r in got} == {w[:2] for w in want} and sum(r["times"] for r in got) == sum(w[2] for w in want)
    else:
        assert sorted(map(tuple, got)) == want
    assert dictionary.known_names(texts, entities.limit(0)).collect() == [] and dictionary.known_names(texts.limit(0), entities).collect() == []


class Words(EntityExtractor):
    def extract(self, text):
        return [("word", w, 0.5 if w.islower() else 2.0 if w == "BAD" else 1.0) for w in text.split()]


def test_table_function(spark):
    table_functions.register(spark, "words_of", Words())
    df = spark.createDataFrame([(1, "a B a"), (2, None), (3, "")], "id int, text string")
    rows = spark.sql("SELECT id, e.* FROM {df}, LATERAL words_of(text, 'position,confidence') AS e", df=df)
    assert rows.columns == ["id", "type", "name", "position", "confidence"]
    assert sorted(map(tuple, rows.collect())) == [(1, "word", "B", 1, 1.0), (1, "word", "a", 0, 0.5)]
    assert spark.sql("SELECT * FROM words_of('x y')").columns == ["type", "name"]
    for bad in ("words_of('x', 'size')", "words_of(1)"):
        with pytest.raises(Exception, match="no column size|must be a string"):
            spark.sql(f"SELECT * FROM {bad}").collect()
    with pytest.raises(Exception, match="between 0 and 1"):
        spark.sql("SELECT * FROM words_of('BAD')").collect()


def test_sketches_merge_and_are_near(spark):
    draw = random.Random(3)
    rows = [(f"s{draw.randint(0, 6000)}", draw.choice(["n", "m"]), draw.choice(["t", "u"])) for _ in range(30_000)]
    hits = spark.createDataFrame(rows, "id string, namespace string, type string")
    half = hits.where(F.xxhash64("id") % 2 == 0)
    stored = sketches.merged(sketches.states(half), sketches.states(hits), sketches.states(half))  # ingested again
    want = {(n, t, level): len({i for i, a, b in rows if n in (None, a) and t in (None, b)}) for n, t, level in [("n", "t", 0), ("m", "u", 0), ("n", None, 1), (None, None, 3)]}
    got = {(r["namespace"], r["type"], r["level"]): r["segments"] for r in sketches.rolled_up(stored).collect()}
    assert len(got) == 7
    for key, count in want.items():
        assert abs(got[key] - count) <= sketches.ERROR * count
    assert sketches.rolled_up(stored.limit(0)).where("level < 3").collect() == []


def test_metadata(spark):
    cases = [('{"a": 1, "b": {"c": [1, "x"]}}', '{"b": 2, "d": null}'), (None, '{"a": 5}'), ("", None), ('{"a": "text"}', "{}"), ("not json", '{"a": 7}')]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, old string, new string")
    m = metadata.merged(metadata.parsed(F.col("old")), metadata.parsed(F.col("new")))
    got = {r["i"]: (json.loads(r["j"]), r["a"]) for r in df.select("i", F.to_json(m).alias("j"), metadata.at(m, "$.a", "int").alias("a")).collect()}
    assert got == {0: ({"a": 1, "b": 2, "d": None}, 1), 1: ({"a": 5}, 5), 2: ({}, None), 3: ({"a": "text"}, None), 4: ({"a": 7}, 7)}
    nested = metadata.at(metadata.parsed(F.col("old")), "$.b.c[1]", "string")
    assert [r[0] for r in df.orderBy("i").select(nested).collect()] == ["x", None, None, None, None]


def test_dated_rows(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-02 03:04:05' AS a, TIMESTAMP_NTZ'2024-01-02 03:04:05.000600' AS b, CAST(NULL AS TIMESTAMP) AS c, 7 AS d")
    assert tuple(metadata.dated(df).first()) == ("2024-01-02T03:04:05", "2024-01-02T03:04:05.000600", None, 7)


def test_order_statistics(spark):
    draw = random.Random(5)
    values = {"a": [draw.random() for _ in range(501)], "b": [3.0] * 40 + [7.0], None: [1.0, 2.0], "c": [-5.0], "d": [draw.choice([1e-9, 1e9, 5.0]) for _ in range(200)]}
    rows = [(g, v) for g, own in values.items() for v in own] + [("a", None), ("e", None), ("a", float("nan"))]
    ranks = {"least": lambda n: F.lit(0), "below": lambda n: F.floor((n - 1) / 2), "p95": lambda n: F.floor(n * 0.95), "most": lambda n: n - 1}
    got = order_stats.order_statistics(spark.createDataFrame(rows, "g string, v double"), "g", "v", ranks, cells=16).collect()
    want = {g: (own := sorted(v), own[0], own[(len(v) - 1) // 2], own[int(len(v) * 0.95)], own[-1])[1:] for g, v in values.items()}
    assert {r["g"]: tuple(r)[1:] for r in got} == want


def test_embedder_is_one_feature_at_a_time():
    """Against the definition: the first eight hexadecimal digits of a feature's MD5 say the element, the ninth the sign."""
    texts = ["One two  two", "", None, "é\tÄ é", "x"] * 70
    for size in (7, 64):
        for text, row in zip(texts[:5], HashEmbedder(size)(texts)[-5:], strict=True):
            words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
            out = np.zeros(size)
            for f in [*words, *(" ".join(p) for p in zip(words, words[1:]))]:
                digits = hashlib.md5(f.encode()).hexdigest()
                out[int(digits[:8], 16) % size] += 1 if int(digits[8], 16) >= 8 else -1
            assert np.allclose(row, out / (np.linalg.norm(out) or 1), atol=1e-7)


def test_known_names_of_many_blocks_arent_shuffled(spark):
    """An entity's forms lie in one block, so its rows need no sum over blocks."""
    texts = spark.createDataFrame([("a", "n", "Alpha and alpha, Beta"), ("b", "n", "beta Alpha Alpha")], "id string, namespace string, text string")
    entities = spark.createDataFrame([(f"e{i}", "n", name, [name.lower()]) for i, name in enumerate(["Alpha", "Beta", "Gamma", "Alpha"])], "id string, namespace string, name string, aliases array<string>")
    found = dictionary.known_names(texts, entities, block_bytes=8)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("a", "e0", 2), ("a", "e1", 1), ("a", "e3", 2), ("b", "e0", 2), ("b", "e1", 1), ("b", "e3", 2)]


def test_exact_rollup_shuffles_no_row_thrice(spark):
    """A segment with several types counts once in each roll-up; the plan has no Expand over links."""
    links = spark.createDataFrame([("s1", "e1"), ("s1", "e2"), ("s1", "e1"), ("s2", "e2"), ("s3", "e3")], "segment_id string, entity_id string").withColumn("namespace", F.lit("x"))
    entities = spark.createDataFrame([("e1", "n", "t"), ("e2", "n", "u"), ("e3", "m", "t")], "id string, namespace string, type string")
    rows = sketches.exact(links, entities)
    assert "Expand" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, map(tuple, rows.collect()))) == sorted(map(str, [("n", "t", 0, 1), ("n", "u", 0, 2), ("m", "t", 0, 1), ("n", None, 1, 2), ("m", None, 1, 1), (None, None, 3, 3)]))
