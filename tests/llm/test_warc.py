import base64
import gzip
import hashlib

import pytest

from tomewright.llm import warc


def test_round_trip(spark, tmp_path):
    pages = [(i, f"http://a/{i} x\r\n", t) for i, t in enumerate(["same", "other", "same", "", None, "é漢🙂\r\n\r\nWARC/1.1\r\n\r\n", "x" * 300_000, "same"])] + [(0, "u", "same"), (None, None, "same"), (None, None, "lone")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, record int").repartition(3)
    folder = f"file://{tmp_path}"
    got = warc.archive_round_trip(df, folder).collect()
    assert len(got) == len(pages)
    by_text = {}
    for i, _, t in pages:
        by_text.setdefault(t or "", []).append(i)
    seen = sorted((r["record_id"], r["record_type"], r["payload_digest"], r["payload_length"], r["refers_to"]) for r in got)
    want = []
    for i, _, t in pages:
        raw, keys = (t or "").encode(), [k for k in by_text[t or ""] if k is not None]
        first = min(keys) if keys and len(by_text[t or ""]) > 1 else None
        revisit = first is not None and i != first
        digest = "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want.append((f"<urn:page:{'' if i is None else i}>", "revisit" if revisit else "response", digest, len(raw), f"<urn:page:{first}>" if revisit else None))
    assert sorted(seen, key=str) == sorted(want, key=str)
    stored = {bytes(r["payload"]) for r in got if r["record_type"] == "response"}
    assert stored == {t.encode() for t in by_text}
    assert not (tmp_path / "monolithic").exists()
    offsets = 0
    for path in (tmp_path / "members").glob("*.warc.gz"):
        raw = path.read_bytes()
        for line in (path.parent / (path.name + ".idx")).read_text().splitlines():
            at, size, record_id, _ = line.split("\t")
            assert f"WARC-Record-ID: {record_id}\r\n".encode() in gzip.decompress(raw[int(at) : int(at) + int(size)])
            offsets += 1
    assert offsets == len(pages)


def test_least_bytes(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = {r["record_id"]: r["record_type"] for r in warc.archive_round_trip(df, f"file://{tmp_path}", least_bytes=3).collect()}
    assert got == {"<urn:page:1>": "response", "<urn:page:2>": "response", "<urn:page:3>": "response", "<urn:page:4>": "revisit"}


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_round_trip(df, f"file://{tmp_path}").collect() == []


def test_streams():
    raw = b"".join(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % len(b) + b + b"\r\n\r\n" for b in (b"", b"ab\r\n\r\ncd", b"z" * 5000))
    whole = gzip.compress(raw)
    for content in (whole, gzip.compress(raw[:40]) + gzip.compress(raw[40:])):
        pieces = (content[i : i + 7] for i in range(0, len(content), 7))
        assert b"".join(warc.split_records(warc.inflated(pieces))) == raw
    with pytest.raises(ValueError):
        list(warc.split_records(warc.inflated([whole[:-9]])))
    with pytest.raises(ValueError):
        list(warc.split_records([raw[:-3]]))
    with pytest.raises(ValueError):
        list(warc.split_records([b"HTTP/1.1 200\r\n\r\n"]))


def test_damaged_archive(spark, tmp_path):
    """A payload that isn't the one its headers name is an error, and so is an archive that ends early."""
    df = spark.createDataFrame([(1, "u", "first text"), (2, "v", "second text")], "page_id long, url string, html string")
    warc.write_monolithic(warc.records(df).coalesce(1), f"file://{tmp_path}/a")
    (part,) = (tmp_path / "a").glob("*.gz")
    whole = gzip.decompress(part.read_bytes())
    assert whole.count(b"WARC/1.1\r\n") == 2 and part.read_bytes().count(b"\x1f\x8b\x08\x00") == 1
    for name, content in (("b", gzip.compress(whole.replace(b"second", b"secund"))), ("c", gzip.compress(whole)[:-12])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.gz").write_bytes(content)
        with pytest.raises(Exception, match="isn't the one|ends early"):
            warc.read_back(warc.normalise(spark, f"file://{tmp_path}/{name}", f"file://{tmp_path}/{name}-out")).collect()


def test_records_of_a_named_index(spark, tmp_path):
    """One archive of many records, read through its sidecar."""
    df = spark.range(700).selectExpr("id as page_id", "'u' as url", "repeat(cast(id as string), 50) as html")
    warc.write_monolithic(warc.records(df).coalesce(1), f"file://{tmp_path}/a")
    manifest = warc.normalise(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/b")
    assert [r["n_records"] for r in manifest.collect()] == [700]
    got = {r["record_id"]: bytes(r["payload"]) for r in warc.read_back(manifest).collect()}
    assert got == {f"<urn:page:{i}>": (str(i) * 50).encode() for i in range(700)}


def test_batches_are_bounded_by_bytes(spark, tmp_path):
    """Large payloads don't gather in one batch: each of these is as large as a batch may be."""
    rows = [(i, "http://x", f"{i}" * (8 << 20)) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    back = warc.archive_round_trip(df, f"file://{tmp_path}/archives")
    assert sorted((r["payload_length"], r["record_type"]) for r in back.select("payload_length", "record_type").collect()) == [(8 << 20, "response")] * 5
    sizes = back.mapInArrow(lambda batches: (b.select(["payload_length"]) for b in batches), "payload_length long")
    assert sizes.count() == 5


def test_headers_that_come_in_small_pieces():
    record = b"WARC/1.0\r\nContent-Length: 3\r\nX: " + b"y" * 50 + b"\r\n\r\nabc\r\n\r\n"
    stream = record * 3
    for size in (1, 2, 3, 7, 1000):
        assert list(warc.split_records(stream[i : i + size] for i in range(0, len(stream), size))) == [record] * 3
