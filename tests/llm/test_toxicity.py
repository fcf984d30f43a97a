"""The factorization machine: its gradient, pairs that no additive model tells, and the cases of the tables."""

import random

import numpy as np
import pytest

from tomewright.llm import toxicity as tx


def test_machine_and_gradient():
    r = np.random.default_rng(1)
    x = (r.random((6, 5)) < 0.5).astype(float)
    bias, w, v = 0.3, r.normal(size=5), r.normal(size=(5, 3))
    plain = [bias + x[n] @ w + sum(x[n, i] * x[n, j] * (v[i] @ v[j]) for i in range(5) for j in range(i)) for n in range(6)]
    assert np.allclose(tx.machine(x, bias, w, v), plain)
    model = tx.ToxicityModel(np.arange(5, dtype=np.uint32), bias, w, v)
    assert np.allclose(model.logit([np.flatnonzero(row).tolist() for row in x]), plain)
    y = np.array([0, 1, 1, 0, 1, 0])
    loss = lambda b, w, v: np.logaddexp(0, (1 - 2 * y) * tx.machine(x, b, w, v)).sum()
    db, dw, dv = tx.slopes(x, 1 / (1 + np.exp(-tx.machine(x, bias, w, v))) - y, v)
    e = 1e-6
    assert np.isclose(db, (loss(bias + e, w, v) - loss(bias - e, w, v)) / (2 * e), atol=1e-4)
    for i in range(5):
        one = np.eye(5)[i] * e
        assert np.isclose(dw[i], (loss(bias, w + one, v) - loss(bias, w - one, v)) / (2 * e), atol=1e-4)
        for f in range(3):
            step = np.zeros((5, 3))
            step[i, f] = e
            assert np.isclose(dv[i, f], (loss(bias, w, v + step) - loss(bias, w, v - step)) / (2 * e), atol=1e-4)


def test_learns_pairs():
    """Either of two terms alone is harmless, or both kinds of texts have each as often: only the pair tells."""
    rows = [np.array(p, int) for p in ([], [0], [1], [0, 1])] * 300
    labels = np.array([1.0, 0, 0, 1] * 300)
    model = tx.fit_rows(rows, labels, np.array([11, 22], np.uint32))
    assert (model.score([r.tolist() for r in rows[:4]]) > 0.5).tolist() == [True, False, False, True]


def made(n, seed=4):
    """Documents of random words; toxic ones have an insult, or an otherwise harmless word next to a group's name."""
    pick = random.Random(seed)
    plain = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]
    out = []
    for i in range(n):
        words = [pick.choice(plain) for _ in range(pick.choice([3, 20, 400]))]
        kind = i % 6
        words += {0: ["Zorbo!"], 1: ["verminous", "gnomes"], 2: ["verminous"], 3: ["gnomes"]}.get(kind, [])
        pick.shuffle(words)
        out.append((i, " ".join(words), int(kind < 2)))
    return out


@pytest.fixture(scope="module")
def learned(spark):
    rows = made(900)
    documents = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows] + [(5000, "zorbo gnomes", "x", 0.5)], "doc_id long, text string, toxic string, toxicity double")
    # Conflicting, null and repeated labels; a hot id whose repeats must not weigh more; ids without documents.
    labels = [(i, y) for i, _, y in rows] + [(0, 1), (5000, 0), (5000, 1), (6000, 1), (None, 1), (3, None)]
    return tx.fit(documents, spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_finds_insults_and_pairs_in_unseen_texts(spark, learned):
    rows = made(300, seed=9)
    df = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows], "doc_id long, text string, Toxicity double")
    scored = tx.score(df, learned).collect()
    wrong = [r["doc_id"] for r in scored if (r["toxicity"] >= 0.5) != bool(rows[r["doc_id"]][2])]
    assert learned.learned and len(scored) == 300 and wrong == []


def test_scores_of_odd_texts(spark, learned):
    long = "wak wbl " * 60_000
    df = spark.createDataFrame([(1, None), (2, ""), (3, "!! 12"), (4, long + "zorbo"), (5, long), (5, long), (None, "ZORBO")], "doc_id long, text string")
    got = [(r["doc_id"], r["toxicity"] >= 0.5) for r in tx.score(df, learned, keep=["doc_id"]).collect()]
    assert sorted(got, key=str) == sorted([(1, False), (2, False), (3, False), (4, True), (5, False), (5, False), (None, True)], key=str)
    same = {r["toxicity"] for r in tx.score(df.where("doc_id <= 3"), learned).collect()}
    assert len(same) == 1 and 0 <= same.pop() <= 1


def test_score_is_that_of_the_terms(spark, learned):
    text = "Zorbo wak gnomes, VERMINOUS"
    places = np.flatnonzero(np.isin(learned.terms, tx.terms(text))).tolist()
    df = spark.createDataFrame([(text,)], "text string")
    assert tx.score(df, learned).first()["toxicity"] == pytest.approx(learned.score([places])[0])


def test_a_hot_id_counts_once(spark):
    rows = made(120) + [(2, "zorbo " * 3, 0)] * 400
    documents = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in made(120)], "doc_id long, toxic int")
    model = tx.fit(documents, labels)
    got = tx.score(spark.createDataFrame([("zorbo",)], "text string"), model).first()["toxicity"]
    assert got >= 0.5


def test_without_labels(spark):
    documents = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 1)], [(1, 1), (1, 0)], [(1, 1), (2, 0)]):
        model = tx.fit(documents, spark.createDataFrame(labels, "doc_id long, toxic int"))
        scores = {r["toxicity"] for r in tx.score(documents, model).collect()}
        assert scores == {0.5} and not model.learned
    assert tx.score(documents.limit(0), model).collect() == []
