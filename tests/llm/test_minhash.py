import random
import re

import pytest

from tomewright.llm import minhash
from tomewright.llm.graph import connected_components


def shingles(text, n):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) or frozenset([tuple(words)])


def brute(rows, n, low, high):
    sets = [shingles(t, n) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and high * len(sets[i] & sets[j]) >= low * len(sets[i] | sets[j]) or rows[i][0] == rows[j][0]:
                label[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), key), key)
    return sorted((key, len(sets[i]), least[find(i)], key == least[find(i)]) for i, (key, _) in enumerate(rows))


def corpus(seed, groups=12, copies=14, far=25):
    """Chains and stars of edits around base texts, exact copies, short and empty texts."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, texts = [], ["", None, " ", "one", "One", "two words", "TWO  words", "three short words", "three short words "]
    for _ in range(groups):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([8, 20, 60, 150]))]
        texts.append(" ".join(base))
        walk = list(base)
        for _ in range(copies):
            at = draw.randrange(len(walk))
            walk = walk[:at] + [draw.choice(vocabulary)] + walk[at + 1 :]
            texts.append(" ".join(walk))
        for _ in range(far):
            some = list(base)
            for _ in range(draw.randint(1, 1 + len(base) // 15)):
                some[draw.randrange(len(some))] = draw.choice(vocabulary)
            texts.append("  ".join(some))
            if draw.random() < 0.2:
                texts.append(" ".join(some).upper())
    draw.shuffle(texts)
    for i, text in enumerate(texts):
        rows.append((i * 3, text))
    return rows


@pytest.mark.parametrize("block", [minhash.BLOCK_SHINGLES, 0])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
    rows = corpus(1)
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, component_id string").repartition(5)
    got = minhash.near_duplicates(df, words=3, threshold=(85, 100)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 3, 85, 100)


def test_default_threshold(spark):
    rows = corpus(2, groups=4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in minhash.near_duplicates(df).collect()) == brute(rows, 5, 80, 100)


def test_edges_of_input(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(df).collect() == []
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (5, None), (5, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in minhash.near_duplicates(df, words=3).collect()), key=str)
    assert got == sorted([(None, 1, 4, True), (4, 1, 4, True), (4, 1, 4, True), (5, 0, 5, True), (5, 0, 5, True)], key=str)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 3), (101, 100)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_block_names_links_once(spark):
    """A clique whose nodes are all outer: links of a task grow with its nodes, not with their pairs."""
    sets = [list(range(100)) + [1000 + i] for i in range(60)] + [list(range(5000 + 200 * i, 5100 + 200 * i)) for i in range(10)]
    rows = [(i, i, len(s), sorted(s)) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "node long, component long, size long, shingles array<long>").coalesce(1)
    links = [tuple(r) for r in minhash._against_block(df, df, (80, 100)).collect()]
    assert len(links) == 59
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(60)}


def test_hot_bucket_and_long_texts(spark):
    """A third of all texts are near copies of one; two very long texts differ in a few words."""
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*words, f"own{i}"])) for i in range(150)] + [(1000 + i, f"lone {i} " * 30) for i in range(300)]
    long = [f"x{i}" for i in range(200_000)]
    rows += [(5000, " ".join(long)), (5001, " ".join([*long[:-3], "a", "b", "c"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()}
    assert {got[i] for i in range(150)} == {0} and got[5001] == got[5000] == 5000
