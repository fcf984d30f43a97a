"""Lexical search against scores worked out one document and one item at a time."""

import math
import random
import re

import pytest

from tomewright.llm import lexical


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(documents, items, k):
    texts = [(i, words(t)) for i, t in documents]
    full = [w for _, w in texts if w]
    n_all, l_all = len(full), sum(map(len, full))
    asked = {}
    for i, t in items:
        asked.setdefault(i, []).extend(words(t))
    out = []
    for item, terms in asked.items():
        found = []
        for doc, own in texts:
            score = 0
            for t in terms:
                tf = own.count(t)
                if tf:
                    df = sum(t in w for w in full)
                    w = math.floor(1000 * math.log((2 * n_all + 2) / (2 * df + 1)))
                    m = 100 - 25 + (25 * len(own) * n_all) // l_all
                    score += w * ((1000000000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


VOCABULARY = ["the", "The", "THE", "Ärger", "ärger", "straße", "x1", "42", "naïve", "日本", "idiot", "of", "a", "co-op", "don't", "é", "a b", "\x85", "_"]


@pytest.mark.parametrize("most, k", [(lexical.BLOCK_BYTES, 20), (60, 3)])
def test_against_brute_force(spark, most, k):
    """Many ties and repeated rows; with a small bound, several blocks of items."""
    pick = random.Random(3)
    text = lambda n: pick.choice([" ", ", ", "\n", "\t"]).join(pick.choice(VOCABULARY) for _ in range(n))
    documents = [(i, text(pick.choice([0, 1, 2, 5, 30]))) for i in range(120)]
    documents += [(7, None), (None, "the straße"), (None, "the straße"), (3, "the straße"), (3, "the straße"), (500, "x1 " * 3000), (501, ""), (502, "!?")]
    items = [(i, text(pick.choice([1, 3, 8]))) for i in range(9)] + [(4, "the 42"), (None, "straße"), (None, "x1 x1"), (20, None), (21, ""), (22, "nowhere else")]
    rows = spark.createDataFrame([(*d, "y", 1) for d in documents], "doc_id long, text string, score string, rank int").repartition(5)
    asked = spark.createDataFrame([(*i, 1.5, "z") for i in items], "item_id long, text string, score double, doc_id string")
    found = lexical.search(rows, asked, k, block_bytes=most)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert got(found) == brute(documents, items, k)


def test_blocks_hold_whole_items(spark):
    items = spark.createDataFrame([(i, " ".join(f"t{i}x{j}" for j in range(10))) for i in range(30)], "item_id long, text string")
    dealt = lexical.item_blocks(lexical.item_terms(items), 400).collect()
    of, size = {}, {}
    for r in dealt:
        assert of.setdefault(r["item"], r["block"]) == r["block"]
        size.setdefault(r["block"], {}).setdefault(r["item"], 0)
        size[r["block"]][r["item"]] += len(r["term"]) + 12
    assert len(of) == 30 and all(sum(s.values()) <= 400 or len(s) == 1 for s in size.values())


def test_document_blocks_and_hot_terms(spark):
    """More documents than a block holds, all with the same term; the term's weight is nothing where all documents have it."""
    n = lexical.BLOCK_DOCUMENTS + 50
    documents = spark.range(n).selectExpr("id AS doc_id", "CASE WHEN id % 1000 = 7 THEN 'same rare' ELSE 'same' END AS text").coalesce(1)
    items = spark.createDataFrame([(1, "rare same"), (2, "same")], "item_id int, text string")
    found = got(lexical.search(documents, items, 4))
    assert [(r[0], r[1], r[2]) for r in found] == [(1, i + 1, 7 + 1000 * i) for i in range(4)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([("a", "x")], "item_id string, text string")
    assert lexical.search(none, items).collect() == []
    assert lexical.search(spark.createDataFrame([(1, "x")], "doc_id long, text string"), items.limit(0)).collect() == []
    with pytest.raises(ValueError):
        lexical.search(none, items, 0)
