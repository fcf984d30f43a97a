import re

import pytest
from pyspark.sql import functions as F

from tomewright.operators.extract import DEFAULT_PATTERNS, EntityExtractor, PatternSet, extract, extract_with

IDEM = "The CCNA001 strain was tested. It grew in media A. BRCA1 was analysed. No findings in the control group."
TEXTS = [IDEM, "mail researcher@example.com, doi 10.1234/abc.DEF-5 and PMID: 12345678 or PMID 1234567.", "AB12345 RESULTS Übung BRCA1BRCA1 p53 HER2", "", "x_BRCA1_y ²BRCA2"]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "n int, text string")


def names(df):
    return sorted((r["n"], r["type"], r["name"]) for r in df.collect())


def test_same_hits_as_python(spark):
    want = sorted({(n, kind, m.group(0).strip()) for n, t in enumerate(TEXTS[:4]) for kind, p in DEFAULT_PATTERNS for m in re.finditer(p, t)})
    assert names(extract(frame(spark, TEXTS[:4]))) == want
    assert {x[1:] for x in want if x[0] == 0} == {("strain", "CCNA001"), ("strain", "BRCA1"), ("gene", "BRCA1"), ("protein", "CCNA001"), ("protein", "BRCA1")}


def test_confidence_table(spark):
    got = {(r["name"], r["type"]): r["confidence"] for r in extract(frame(spark)).collect()}
    assert got["BRCA1", "gene"] == 0.75
    assert got["CCNA001", "strain"] == 0.85
    assert got["RESULTS", "strain"] == 0.7999999999999999
    assert got["researcher@example.com", "email"] == 1.0
    assert got["10.1234/abc.DEF-5", "doi"] == 1.0
    stored = extract(frame(spark, [IDEM])).where("name = 'CCNA001'").select(F.col("confidence").cast("float")).first()[0]
    assert stored == 0.8500000238418579


def test_pattern_sets(spark):
    base = PatternSet((("lower", r"\b[a-z]{5}\b"),))
    assert names(extract(frame(spark, ["Alpha gamma"]), base)) == [(0, "lower", "gamma")]
    loose = PatternSet(base.patterns, case_sensitive=False)
    assert names(extract(frame(spark, ["Alpha gamma"]), loose)) == [(0, "lower", "Alpha"), (0, "lower", "gamma")]
    more = base.add("digit", r"\d").remove("unknown")
    assert more.names() == ["lower", "digit"] and base.names() == ["lower"]
    assert more.remove("lower").names() == ["digit"]
    assert extract(frame(spark), PatternSet(())).count() == 0
    assert {r["confidence"] >= 0.8 for r in extract(frame(spark), PatternSet(min_confidence=0.8)).collect()} == {True}
    for bad in ({"patterns": (("x", "("),)}, {"min_confidence": 1.5}):
        with pytest.raises(ValueError):
            PatternSet(**bad)


class Twice(EntityExtractor):
    def __init__(self, value=0.5):
        self.value = value

    def extract(self, text):
        return [("word", w, self.value) for w in text.split()[:2]]


def test_custom_extractor(spark):
    assert names(extract_with(frame(spark, ["a b c", "d d", ""]), Twice())) == [(0, "word", "a"), (0, "word", "b"), (1, "word", "d")]
    with pytest.raises(Exception, match="confidence"):
        extract_with(frame(spark, ["a"]), Twice(1.5)).collect()


def test_patterns_that_java_refuses(spark):
    with pytest.raises(ValueError, match="pattern of x"):
        extract(frame(spark), PatternSet((("x", r"(?P<n>\d+)"),)))
