import itertools
import random
import zlib

import numpy as np
import pytest

from tomewright.llm import shard


@pytest.mark.parametrize(("d", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_every_cell_in_steps_of_one(d, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
    index = shard.hilbert_index(cells, bits)
    assert sorted(index) == list(range(len(cells)))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("law", ["rows", "bytes"])
@pytest.mark.parametrize("n", [0, 3, 1000])
def test_laws(spark, law, n):
    rows = [(i, None if i % 50 == 0 else "é" * (i % 37), "en" if i % 3 else None, f"src{i % 7 if i % 2 else 0}", i % 37, "x") for i in range(n)]
    if n > 10:
        rows += rows[:5]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string")
    got = shard.hilbert_shards(df, ["lang", "source", "n_chars"], 40, law).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] or "" for r in rows}
    for r in got:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    for members in by.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    if n == 1000 and law == "rows":
        assert {len(m) for m in by.values()} <= {25, 26} and len(by) == 40
    if n == 1000 and law == "bytes":
        sizes = [sum(r["size"] for r in m) for m in by.values()]
        assert len(by) == 40 and max(sizes) - min(sizes) <= 2 * (37 * 2 + 16)
    # Shards are runs of the curve.
    ends = sorted((s, min(r["hilbert"] for r in m), max(r["hilbert"] for r in m)) for s, m in by.items())
    assert all(a[2] <= b[1] for a, b in itertools.pairwise(ends))


def test_order_is_the_brute_force_order(spark):
    """Cells by quantiles of each dimension, computed here on sorted lists, give the same curve values."""
    draw = random.Random(7)
    sources = ["aaa"] + [f"https://site{i}.example/path" for i in range(9)]
    rows = [(i, "t" * draw.randint(0, 20), draw.choice(sources), draw.randint(0, 500)) for i in range(1, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n long").repartition(5)
    bits = 3
    got = {r["doc_id"]: r["hilbert"] for r in shard.hilbert_shards(df, ["source", "n"], 8, bits=bits).collect()}
    side = 1 << bits

    def text_cuts(values):
        cuts, seen = [], 0
        for value in sorted(set(values)):
            n = values.count(value)
            if (seen + n) * side // len(values) != seen * side // len(values):
                cuts.append(value)
            seen += n
        return cuts[: side - 1]

    cuts = text_cuts([r[2] for r in rows])
    codes = {r[0]: (sum(c < r[2] for c in cuts), r[3]) for r in rows}
    borders = []
    for i in range(2):
        values = sorted(c[i] for c in codes.values())
        borders.append(sorted({values[-(-len(values) * k // side) - 1] for k in range(1, side)}))
    for key, code in codes.items():
        cell = [sum(b < c for b in bs) * (side - 1) // max(1, len(bs)) for bs, c in zip(borders, code, strict=True)]
        assert got[key] == shard.hilbert_index(np.array([cell]), bits)[0]


def test_an_outlier_leaves_the_dimension_alive(spark):
    rows = [(i, "x", f"https://site{i % 5}", 1) for i in range(100)] + [(100, "x", "aaa", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    found = shard.hilbert_shards(df, ["source", "n"], 5).select("source", "hilbert").distinct().collect()
    assert len({r["hilbert"] for r in found if r["source"] != "aaa"}) == 5


def test_write_shards(spark, tmp_path):
    """Each row is written once, repeated rows and clashing names included."""
    rows = [(i, None if i == 3 else f"text {i % 9}", f"s{i % 4}", "old", i) for i in range(60)] + [(1, "text 1", "s1", "old", 0), (1, "another", "s1", "old", 0), (None, "no key", None, "old", 0)] + [(5, "text 5", "s1", "old", 0)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard string, slot long")
    placed = shard.hilbert_shards(df, ["source"], 6)
    shard.write_shards(df, placed, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    key = lambda r: str((r["doc_id"], r["text"], r["source"]))
    assert sorted(map(key, back.collect())) == sorted(str(r[:3]) for r in rows)
    where = {(r["doc_id"], r["text_crc32"]): set() for r in placed.collect()}
    for r in placed.collect():
        where[r["doc_id"], r["text_crc32"]].add((r["shard"], r["slot"]))
    assert all((r["shard"], r["slot"]) in where[r["doc_id"], zlib.crc32((r["text"] or "").encode())] for r in back.collect())


def test_long_texts(spark):
    df = spark.createDataFrame([(1, "é" * 2_000_000, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["size"] for r in shard.hilbert_shards(df, ["source"], 2).collect()} == {1: 4_000_016, 2: 16}
