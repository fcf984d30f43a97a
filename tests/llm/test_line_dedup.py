import random
import re

from tomewright.llm import line_dedup


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, min_words=5, near_words=10):
    places = [(key, no, line) for key, text in docs if text is not None for no, line in enumerate(text.split("\n"))]
    words = lambda line: tuple(re.findall(r"[^\x20\x09-\x0D]+", line.lower()))
    first = {}
    for key, no, line in sorted(places, key=lambda p: ((p[0] is not None, p[0] or 0), p[1])):
        if len(words(line)) >= min_words:
            first.setdefault(words(line), ((key is not None, key or 0), no))
    gone = {w for w, at in first.items() for v, before in first.items() if before < at and len(w) >= near_words <= len(v) and near(w, v)}
    out = []
    for key, text in docs:
        lines = (text or "").split("\n")
        kept, exact, close = [], 0, 0
        for no, line in enumerate(lines):
            w = words(line)
            if w in gone:
                close += 1
            elif w in first and first[w] != ((key is not None, key or 0), no):
                exact += 1
            else:
                kept.append(line)
        out.append((key, "\n".join(kept) if text is not None else None, sum(bool(words(x)) for x in lines), exact, close))
    return sorted(out, key=str)


def corpus(seed):
    draw = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(30)]
    bases = [[draw.choice(vocabulary) for _ in range(draw.choice([3, 5, 9, 10, 11, 24]))] for _ in range(15)] + [["same"] * 12, ["same"] * 13, ["same"] * 14]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(draw.randint(0, 8)):
            line = list(draw.choice(bases))
            for _ in range(draw.choice([0, 0, 1, 1, 2])):
                at = draw.randrange(len(line))
                kind = draw.randrange(3)
                line[at : at + (kind != 1)] = [] if kind == 0 and len(line) > 1 else [draw.choice(vocabulary)]
            text = draw.choice([" ", "  "]).join(line)
            lines.append(draw.choice([text, text.upper(), f" {text}\t"]))
        docs.append((i, "\n".join(lines)))
    return [*docs, (100, None), (101, ""), (102, "\n\n"), (None, docs[3][1]), docs[5]]


def test_equal_to_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        df = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], "doc_id long, text string, n_near string, _h int").repartition(3)
        got = line_dedup.dedup_lines(df)
        assert got.columns == ["doc_id", "text", "_h", "n_lines", "n_exact", "n_near"]
        rows = [(r["doc_id"], r["text"], r["n_lines"], r["n_exact"], r["n_near"]) for r in got.collect()]
        assert sorted(rows, key=str) == brute(docs)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup_lines(empty).collect() == []
    long = " ".join(f"w{i}" for i in range(30_000))
    df = spark.createDataFrame([(1, long), (2, long + " more"), (3, "short line\nshort line")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_exact"], r["n_near"]) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: (0, 0), 2: (0, 1), 3: (0, 0)}


def test_native(spark):
    df = spark.createDataFrame(corpus(1), "doc_id long, text string")
    plan = line_dedup.dedup_lines(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_bound_grows_with_length(spark):
    draw = random.Random(3)
    vocabulary = [f"v{i}" for i in range(40)]
    bases = [[draw.choice(vocabulary) for _ in range(n)] for n in (28, 29, 30, 31, 44, 45, 60, 61, 90, 150)] + [["same"] * 40, ["same"] * 43]
    docs = []
    for i in range(160):
        line = list(draw.choice(bases))
        for _ in range(draw.choice([0, 1, 2, 3, 4, 5, 6, 11])):
            at = draw.randrange(len(line))
            kind = draw.randrange(3)
            line[at : at + (kind != 1)] = [] if kind == 0 else [draw.choice(vocabulary)]
        docs.append((i, " ".join(line)))
    first, expected = {}, {}
    for key, text in docs:
        w = tuple(text.split())
        repeated = w in first
        if not repeated:
            first[w] = any(edits(w, v) <= max(1, max(len(w), len(v)) // 15) for v in first)
        expected[key] = (0, 1) if first[w] else (int(repeated), 0)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_exact"], r["n_near"]) for r in line_dedup.dedup_lines(df).collect()}
    assert got == expected and 20 < sum(near for _, near in expected.values()) < 155
    one = {r["doc_id"]: r["n_near"] for r in line_dedup.dedup_lines(df, words_per_edit=None).collect()}
    assert sum(one.values()) < sum(near for _, near in expected.values())
    plan = line_dedup.dedup_lines(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_query_of_all_lengths(spark, tmp_path):
    from tomewright.llm.queries import QUERIES

    words = [f"w{i}" for i in range(85)]
    spark.createDataFrame([(1, " ".join(words)), (2, " ".join(["x", *words[1:84], "y"]))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    near = lambda name: {r["doc_id"]: r["n_near"] for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert near("op8_line_dedup_by_length") == {1: 0, 2: 1}
