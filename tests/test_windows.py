"""Windowed totals as streams: late rows, restarts, and the same answer as over the table."""

from datetime import datetime, timedelta

from tomewright.streaming import windows

BEGAN = datetime(2024, 1, 1)
SCHEMA = "ts timestamp, k string, value double"


def run(spark, tmp_path, batches, by, span, delay="1 hour", end=True):
    """A file for each batch, each in a run of its own on one checkpoint. The windows, and the rows dropped as late."""
    source, lost = f"{tmp_path}/in", 0
    schema = spark.createDataFrame([], SCHEMA).schema
    for number in range(len(batches) + end):
        if number < len(batches):
            rows = [(None if m is None else BEGAN + timedelta(minutes=m), k, v) for m, k, v in batches[number]]
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        else:
            windows.close(spark, schema, f"{tmp_path}/end")
        stream = windows.closing(spark.readStream.schema(schema).parquet(source), f"{tmp_path}/end")
        query = windows.write(windows.totals(stream, by, span, delay), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        query.awaitTermination()
        lost += windows.dropped(query)
    began = int((BEGAN - datetime(1970, 1, 1)).total_seconds())
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    return sorted(((r["k"], (r["starts"] - began) // 60, (r["ends"] - began) // 60, r["events"], r["total"]) for r in got), key=str), lost


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    """The watermark stands at 12:00 less an hour after the first batch: a row of 10:30 is of a closed window, one of 11:10 isn't."""
    first = [(60 * 10 + 5, "a", 1.0), (60 * 12, "a", 2.0)]
    second = [(60 * 10 + 30, "a", 100.0), (60 * 11 + 10, "a", 4.0), (None, "a", 8.0), (60 * 12 + 1, None, None)]
    got, lost = run(spark, tmp_path, [first, second], ["k"], windows.tumbling("1 hour"))
    assert got == sorted([("a", 600, 660, 1, 1.0), ("a", 660, 720, 1, 4.0), ("a", 720, 780, 1, 2.0), (None, 720, 780, 1, None)], key=str) and lost == 1


def test_open_windows_wait_for_the_end(spark, tmp_path):
    rows = [(5, "a", 1.0), (200, "a", 2.0)]
    got, _ = run(spark, tmp_path, [rows], ["k"], windows.tumbling("1 hour"), end=False)
    assert got == [("a", 0, 60, 1, 1.0)]


def test_stream_equals_table(spark, tmp_path):
    rows = [(m * 7 % 400, "ab"[m % 2], float(m)) for m in range(60)]
    schema = spark.createDataFrame([], SCHEMA).schema
    table = spark.createDataFrame([(BEGAN + timedelta(minutes=m), k, v) for m, k, v in rows], schema)
    for name, span in (("sliding", windows.sliding("1 hour", "20 minutes")), ("session", windows.session("9 minutes"))):
        (tmp_path / name).mkdir()
        got, lost = run(spark, tmp_path / name, [rows], ["k"], span)
        began = int((BEGAN - datetime(1970, 1, 1)).total_seconds())
        want = [(r["k"], (r["starts"] - began) // 60, (r["ends"] - began) // 60, r["events"], r["total"]) for r in windows.totals(table, ["k"], span, "1 hour").collect()]
        assert got == sorted(want, key=str) and lost == 0 and len(got) > 4
