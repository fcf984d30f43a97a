import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tomewright.functions import ids
from tomewright.functions.text import batches, normalize, preview, sentences
from tomewright.operators.segment import keep_pages, segment_markdown, segment_pages, segment_text

TEXTS = [
    "",
    " \n\t ",
    "Too short. No.",
    "The CCNA001 strain was tested here. It grew well in media A today.  BRCA1 was analysed afterwards!\nNo findings appeared in group B? Über alles this does not split. Élan neither, as it is not ASCII.",
    "A.B without a space stays one sentence here. Next sentence follows after it.  Trailing space is odd.  Indeed it is rather odd.",
    "One\x1cTwo\x1d three is long enough to stay. \x1e Four comes after a separator sign.\r\nFive follows a line end of two signs.",
]


def sentences_of(text):
    return [s for s in (p.strip() for p in re.split(r"(?<=[.!?])\s+(?=[A-Z])", text)) if len(s) >= 20]


def segments_of(ns, uri, text, n, key):
    found = sentences_of(text)
    for i in range(0, len(found), n):
        body = " ".join(found[i : i + n])
        yield i, body, hashlib.sha256(f"{ns}|{uri}|{key(i)}|{' '.join(body.split())}".encode()).hexdigest()


def frame(spark, texts):
    return spark.createDataFrame([("r", "ns", f"doc://{i}", t) for i, t in enumerate(texts)], "ir_id string, namespace string, source_uri string, text string")


def test_sentences_and_normalize(spark):
    rows = frame(spark, TEXTS).select("text", sentences(F.col("text")).alias("s"), normalize(F.col("text")).alias("n")).collect()
    for r in rows:
        assert r["s"] == sentences_of(r["text"])
        assert r["n"] == " ".join(r["text"].split())


@pytest.mark.parametrize("n", [1, 2, 3, 50])
def test_text_segments(spark, n):
    got = segment_text(frame(spark, [*TEXTS, None]), n).collect()
    want = [(f"doc://{k}", i, body, id) for k, t in enumerate(TEXTS) for i, body, id in segments_of("ns", f"doc://{k}", t, n, str)]
    assert sorted((r["source_uri"], r["provenance"]["sentence"], r["text"], r["id"]) for r in got) == sorted(want)
    assert all(r["segment_index"] == r["provenance"]["sentence"] // n for r in got)
    with pytest.raises(ValueError):
        segment_text(frame(spark, TEXTS), 0)
    assert batches  # guarded there


def test_pages(spark):
    long = "This page has sentences that are long. " * 5
    pages = spark.createDataFrame([("r", "ns", "u", 1, "x" * 49), ("r", "ns", "u", 2, long.strip()), ("r", "ns", "u", 3, long.strip()), ("r", "ns", "u", 4, "y" * 50)], "ir_id string, namespace string, source_uri string, page_num int, text string")
    kept = keep_pages(pages)
    assert sorted(r["page_num"] for r in kept.collect()) == [2, 3, 4]
    got = sorted((r["segment_index"], r["provenance"]["page"], r["provenance"]["sentence"], r["provenance"]["sentence_count"]) for r in segment_pages(kept).collect())
    assert got == [(0, 2, 0, 3), (1, 2, 3, 2), (2, 3, 0, 3), (3, 3, 3, 2), (4, 4, 0, 1)]


def markdown_of(text, n=3):
    """Headings close sections; a section's first index is the sum of the running totals before it."""
    sections, heading, lines = [], "root", []
    for line in [*re.sub(r"\r\n?", "\n", text).split("\n"), "#"]:
        if line.startswith("#"):
            if lines:
                sections.append((heading, lines))
            heading, lines = line.lstrip("#").strip(), []
        elif line.strip():
            lines.append(line)
    start = made = 0
    for para, (heading, lines) in enumerate(sections):
        parts = list(segments_of("ns", "doc://0", " ".join(lines), n, lambda i, h=heading, p=para: f"{h}:{p}:{i}"))
        for k, (i, body, id) in enumerate(parts):
            yield heading, para, i, body, id, start + k
        made += len(parts)
        start += made


LINE = "A sentence that is long enough. Another sentence of some length.\n"
MARKDOWN = [
    "",
    LINE * 3 + "# One\n\n" + LINE + "\n\n" + LINE + "## Two\n#tag\n###\n" + LINE * 2,
    "# A\n" + LINE * 3 + "# B\n" + LINE + "# C\n" + LINE,
    "# only headings\n## none\n",
    "# A\nshort\n# B\r\n" + LINE + "\r\n#   Spaced title  #\n" + LINE,
]


@pytest.mark.parametrize("text", MARKDOWN)
def test_markdown(spark, text):
    got = segment_markdown(frame(spark, [text])).collect()
    rows = sorted((r["provenance"]["heading_path"], r["provenance"]["para"], r["provenance"]["sentence"], r["text"], r["id"], r["segment_index"]) for r in got)
    assert rows == sorted(markdown_of(text))


def test_markdown_indices(spark):
    three = "# A\n" + LINE * 3 + "# B\n" + LINE + "# C\n" + LINE
    index = lambda **o: sorted(r["segment_index"] for r in segment_markdown(frame(spark, [three]), **o).collect())
    assert index() == [0, 1, 2, 5]
    assert index(dense=True) == [0, 1, 2, 3]


def test_keys_and_previews(spark):
    row = spark.range(1).select(
        preview(F.lit("x" * 51)).alias("long"), preview(F.lit("x" * 50)).alias("short"), ids.placeholder_hash(F.lit("/a/b.pdf")).alias("gone"), ids.file_uri(F.lit("file:/a/b")).alias("one"), ids.file_uri(F.lit("file:///a/b")).alias("three"), ids.file_uri(F.lit("/a/b")).alias("none"), ids.content_hash(F.lit(b"ab")).alias("bytes")
    ).first()
    assert row["long"] == "x" * 50 + "..." and row["short"] == "x" * 50
    assert row["gone"] == "legacy__a_b.pdf"
    assert {row["one"], row["three"], row["none"]} == {"file:///a/b"}
    assert row["bytes"] == hashlib.sha256(b"ab").hexdigest()
