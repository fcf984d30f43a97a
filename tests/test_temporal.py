"""Joins along time against loops over all pairs."""

import random
from datetime import datetime, timedelta

import pytest

from tomewright.operators import temporal

BEGAN = datetime(2024, 1, 1)


def made(seed, n):
    """Rows (id, key, time, value) with ties, null keys and times, and one key with a third of the rows."""
    draw = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if draw.random() < 0.34 else draw.choice(["a", "b", "c", None])
        time = None if draw.random() < 0.03 else BEGAN + timedelta(seconds=draw.choice([draw.randint(0, 500), draw.randint(0, 90_000)]))
        out.append((i, key, time, draw.choice([None, 1.5, 2.5])))
    return out + out[:5]


SCHEMA = "id long, key string, ts timestamp, met double"


def brute(left, right, tolerance, strict):
    out = []
    for row in left:
        found = [r for r in right if row[1] is not None and row[2] is not None and r[1] == row[1] and r[2] is not None and (r[2] < row[2] if strict else r[2] <= row[2])]
        best = max(found, key=lambda r: (r[2], r[0]), default=None)
        if best and tolerance is not None and (row[2] - best[2]).total_seconds() > tolerance:
            best = None
        out.append((row[0], best[0] if best else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("tolerance, strict, cell_rows", [(None, False, 10), (None, True, 10**6), (40, False, 25), (40.5, True, 7)])
def test_as_of(spark, tolerance, strict, cell_rows):
    left, right = made(1, 250), made(2, 120)
    got = temporal.as_of_join(spark.createDataFrame(left, SCHEMA).withColumnRenamed("met", "own"), spark.createDataFrame(right, SCHEMA), ["key"], tie="id", tolerance=tolerance, strict=strict, cell_rows=cell_rows)
    assert got.columns == ["id", "key", "ts", "own", "met"]
    assert sorted(((r["id"], r["met"]["id"] if r["met"] else None) for r in got.collect()), key=str) == brute(left, right, tolerance, strict)


def test_as_of_compares_no_pairs(spark):
    """No nested loop, and cells of a hot key are tasks of their own."""
    df = spark.createDataFrame(made(3, 50), SCHEMA)
    plan = temporal.as_of_join(df.drop("met"), df, ["key"], tie="id", cell_rows=10)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "_cell" in plan


@pytest.mark.parametrize("salts", [1, 3])
def test_span(spark, salts):
    left, right = made(4, 150), made(5, 150)
    got = temporal.span_join(spark.createDataFrame(left, SCHEMA).drop("met"), spark.createDataFrame(right, SCHEMA), ["key"], 60.5, salts=salts)
    want = sorted((a[0], b[0]) for a in left for b in right if a[1] is not None and a[1] == b[1] and a[2] and b[2] and 0 <= (a[2] - b[2]).total_seconds() <= 60.5)
    assert sorted((r["id"], r["met"]["id"]) for r in got.collect()) == want and len(want) > 50
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_empty_sides_and_bad_spans(spark):
    df, none = spark.createDataFrame(made(6, 10), SCHEMA).drop("met"), spark.createDataFrame([], SCHEMA)
    assert [r["met"] for r in temporal.as_of_join(df, none, ["key"]).collect()] == [None] * 15
    assert temporal.as_of_join(none.drop("met"), df, ["key"]).collect() == [] and temporal.span_join(df, none, ["key"], 1).collect() == []
    with pytest.raises(ValueError):
        temporal.span_join(df, none, ["key"], 0)
