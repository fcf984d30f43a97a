import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomewright.llm import langid, quality_pu
from tomewright.llm.common import held_out

SYLLABLES = {"aa": ["the", "ing", "tion", "er", "an", "wh"], "bb": ["ße", "ung", "sch", "ein", "keit"], "cc": ["que", "ción", "os", "ñas", "el"]}


def texts(n, seed=2):
    draw = random.Random(seed)
    for i in range(n):
        lang = draw.choice(list(SYLLABLES))
        yield i, " ".join("".join(draw.choices(SYLLABLES[lang], k=draw.randint(1, 3))) for _ in range(draw.randint(20, 300))), lang


def test_held_out_accuracy(spark):
    rows = [*texts(600), (700, None, "aa"), (701, "", "bb"), (702, "12 !!", "bb"), (703, "text without label", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, lang_score int")
    model = langid.fit(df, ~held_out(), sample_texts=40)
    assert [name for name, _ in model.dictionaries] == ["aa", "bb", "cc"]
    found = langid.identify(df, model)
    assert found.columns.count("lang_score") == 1 and found.count() == len(rows)
    tested = found.where(held_out() & (F.col("doc_id") < 600))
    assert tested.where("lang_best = lang").count() >= 0.97 * tested.count()
    assert {(r["lang_best"], r["lang_score"]) for r in found.where("doc_id in (700, 701, 702)").collect()} == {("und", 0.0)}
    assert found.where("lang_score < 0 or lang_score > 1").count() == 0


def test_narrow_margins_are_rejected(spark):
    df = spark.createDataFrame([(i, t, lang) for i, t, lang in texts(200)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    unlike = spark.createDataFrame([(1, "0x9f zzqk yyxw")], "doc_id long, text string")
    r = langid.identify(unlike, model).first()
    assert r["lang_best"] in SYLLABLES and r["lang_rejected"] and r["lang_id"] == "und"


def test_language_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.fit(empty)
    assert langid.identify(empty, model).count() == 0
    some = spark.createDataFrame([(1, "a text", "xx"), (1, "a text", "xx")], "doc_id long, text string, lang string")
    assert [r["lang_best"] for r in langid.identify(some, model).collect()] == ["und", "und"]
    assert [r["lang_best"] for r in langid.identify(some, langid.fit(some)).collect()] == ["xx", "xx"]


def quality_tables(spark, n=900):
    draw = random.Random(6)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(draw.choices(SYLLABLES["aa"], k=2)) for _ in range(draw.randint(20, 200))]
        bad = draw.random() < 0.25
        if bad:
            words = draw.choice([[w.upper() + "!!" for w in words], [w for w in words[:12] for _ in range(9)], [w + "###" for w in words]])
        docs.append((i, " ".join(words), int(not bad)))
        if i % 2:
            labels.append((i, int(not bad)))
    docs += [(n + 1, None, 1), (n + 2, "", 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, truth int"), spark.createDataFrame(labels + labels[:3], "doc_id long, quality int")


def test_positive_unlabelled(spark):
    docs, labels = quality_tables(spark)
    model = quality_pu.fit(docs.select("doc_id", "text"), labels, ~held_out())
    assert 0.6 < model.prior < 0.9  # three quarters are good
    scored = quality_pu.score(docs.withColumn("quality_score", F.lit("old")), model)
    assert scored.count() == docs.count() and dict(scored.dtypes)["quality_score"] == "double"
    tested = scored.where(held_out() & F.col("text").isNotNull() & (F.col("text") != ""))
    assert tested.where((F.col("quality_score") >= 0.7) == (F.col("truth") == 1)).count() >= 0.97 * tested.count()
    assert scored.where("quality_score is null or quality_score < 0 or quality_score > 1").count() == 0


def test_quality_edges(spark):
    docs, labels = quality_tables(spark, 40)
    model = quality_pu.fit(docs.select("doc_id", "text"), labels.limit(0))
    assert not model.learned
    assert {r[0] for r in quality_pu.score(docs, model).select("quality_score").collect()} == {0.5}
    assert quality_pu.score(docs.limit(0), model).count() == 0


def test_prior_estimate():
    random = np.random.default_rng(1)
    p = random.normal(0, 1, (3000, 4))
    for share in (0.3, 0.7):
        u = np.vstack([random.normal(0, 1, (int(4000 * share), 4)), random.normal(3, 1, (int(4000 * (1 - share)), 4))])
        assert abs(quality_pu.estimate_prior(p, u) - share) < 0.12


def risk(weights, positive, unlabelled, prior):
    """The non-negative risk and whether its bound is met, term by term."""
    loss = lambda z, y: float(np.mean(np.log1p(np.exp(-z if y else z))))
    p, u = (quality_pu._forward(weights, x)[1] for x in (positive, unlabelled))
    negative = loss(u, 0) - prior * loss(p, 0)
    return prior * loss(p, 1), negative


def test_gradient_of_the_non_negative_risk(monkeypatch):
    """One step of plain descent (the slope, before Adam) against finite differences of the risk, on both sides of its bound."""
    random = np.random.default_rng(4)
    positive, unlabelled = random.normal(1, 1, (30, 5)), random.normal(0, 1, (50, 5))
    monkeypatch.setattr(quality_pu, "STEPS", 1)
    monkeypatch.setattr(quality_pu, "DECAY", 0.0)
    start = np.random.default_rng(quality_pu.SEED)
    begin = (start.normal(0, 5**-0.5, (5, quality_pu.HIDDEN)), np.zeros(quality_pu.HIDDEN), start.normal(0, quality_pu.HIDDEN**-0.5, quality_pu.HIDDEN), np.zeros(1))
    sides = set()
    for prior in (0.2, 0.99):
        moved = quality_pu._train(positive, unlabelled, prior)
        above = risk(begin, positive, unlabelled, prior)[1] >= 0
        sides.add(above)
        # Adam's first step goes against the sign of each slope: of the whole risk above the bound, away from the negatives' risk below it.
        value = lambda w, above=above, prior=prior: (sum(risk(w, positive, unlabelled, prior)) if above else -risk(w, positive, unlabelled, prior)[1])
        for i, w in enumerate(begin):
            for at in list(np.ndindex(w.shape))[:12]:
                up, down = ([v.copy() for v in begin] for _ in range(2))
                up[i][at] += 1e-5
                down[i][at] -= 1e-5
                slope = (value(tuple(up)) - value(tuple(down))) / 2e-5
                if abs(slope) > 1e-6:
                    assert np.sign(moved[i][at] - w[at]) == -np.sign(slope)
    assert sides == {True, False} or sides == {True}


def test_sizes_are_the_librarys():
    """Sizes of a text are those of its blocks under each dictionary, compressed here one by one."""
    import zstandard

    model = langid.LanguageModel((("aa", b"the thing and then " * 100), ("bb", b"le chat que voici " * 100)))
    text = "The thing that THEN came " * 90
    lowered = text.lower()
    n = round(len(lowered) / langid.BLOCK_CHARS)
    step = -(-len(lowered) // n)
    want = []
    for name, content in model.dictionaries:
        compressor = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)
        want.append((sum(len(compressor.compress(lowered[i : i + step].encode())) for i in range(0, len(lowered), step)), name))
    assert langid.Predictor(model).sizes(text) == sorted(want)
    assert langid.Predictor(model).predict(text)[0] == "aa"


def test_long_texts(spark):
    docs, labels = quality_tables(spark, 200)
    model = quality_pu.fit(docs.select("doc_id", "text"), labels)
    long = spark.createDataFrame([(1, "the ing er an " * 100_000)] * 2, "doc_id long, text string")
    assert len({r["quality_score"] for r in quality_pu.score(long, model).collect()}) == 1
    some = spark.createDataFrame([(i, t, lang) for i, t, lang in texts(60)], "doc_id long, text string, lang string")
    assert {r["lang_best"] for r in langid.identify(long, langid.fit(some)).collect()} == {"aa"}


def test_too_many_languages_are_an_error(spark):
    df = spark.createDataFrame([(i, "some words", f"l{i}") for i in range(5)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.fit(df, most_languages=4)
    assert [name for name, _ in langid.fit(df, most_languages=5).dictionaries] == [f"l{i}" for i in range(5)]


def test_dictionaries_share_their_bytes_evenly(spark):
    """Texts of three-byte characters fill a dictionary with all their slices, none cut inside a character."""
    rows = [(i, "".join(chr(0x4E00 + (i * 37 + j * 11) % 5000) for j in range(900)), "zh") for i in range(langid.SAMPLE_TEXTS)]
    ((_, content),) = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).dictionaries
    lines = content.decode("utf-8").split("\n")
    assert len(content) <= langid.DICTIONARY_BYTES and len(lines) == langid.SAMPLE_TEXTS and len({len(x) for x in lines}) == 1


def test_a_hot_id_is_bounded_in_the_quality_sample(spark, monkeypatch):
    monkeypatch.setattr(quality_pu, "MOST_POSITIVE", 10)
    monkeypatch.setattr(quality_pu, "MOST_UNLABELLED", 20)
    rows = [(1, f"text number {i}") for i in range(300)] + [(2, "the same text")] * 300 + [(i, f"other {i} words") for i in range(3, 20)]
    seen = []
    monkeypatch.setattr(quality_pu, "fit_rows", lambda p, u: seen.append((len(p), len(u))))
    quality_pu.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int"))
    assert seen[0][0] <= 10 and seen[0][1] <= 40
