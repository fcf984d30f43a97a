"""WARC archives: write records, normalise monolithic gzip files, read records back by offset.

Crawlers at times compress a whole archive as one gzip stream; to reach one record, everything before it must be inflated. The
normaliser inflates such a file once, as a stream, rewrites each record as a gzip member of its own, and writes a
sidecar index (a line a record: offset, length and the named headers), after which any record is one ranged read.

Monolithic archives are written by Spark's text writer. They are read as streams, so a task holds a piece of an archive and one record
of it, however large the archive is. Normalised archives and sidecars are written by the tasks under names of their own
attempt; only names in the stored manifest count, so a task that runs again does no harm.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_at_end, stash

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records of one monolithic archive, the unit of work of the normaliser.
RECORDS_PER_FILE = 4_000
#: A batch of records read back ends with so many, or with so many bytes of payloads.
BATCH_RECORDS, BATCH_BYTES = 256, 8 << 20
#: Bytes of an archive that are read at once.
PIECE = 1 << 16
#: Digests of repeated payloads that may be broadcast (about 60 MB); beyond that, a shuffled join finds them.
BROADCAST_GROUPS = 1_000_000
HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: each five hexadecimal digits are four of base 32."""
    hexadecimal = F.sha1(payload)
    parts = [F.lpad(F.upper(F.conv(F.substring(hexadecimal, i, 5), 16, 32)), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """A WARC record (column record, text) per row. Of equal payloads of least_bytes or more the row with the least key is
    the response, others are revisits that name it; rows that repeat that key are responses too. A null payload is empty,
    a null key comes after all others and is written as an empty header."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = df.select(F.col(key).cast("string").alias("_id"), F.col(key).alias("_key"), F.coalesce(F.col(url), F.lit("about:blank")).alias("_url"), body.alias("_body"), F.octet_length(body).cast("long").alias("_bytes"), F.sha1(F.encode(body, "UTF-8")).alias("_sha"))
    light = df.select(F.col(key).alias("_key"), F.sha1(F.encode(body, "UTF-8")).alias("_sha"), F.octet_length(body).alias("_bytes")).where(F.col("_bytes") >= least_bytes)
    first = stash(light.groupBy("_sha").agg(F.min("_key").alias("_first"), F.count("*").alias("n")).where("n > 1").select("_sha", "_first"), "repeated")
    first = F.broadcast(first) if first.count() <= BROADCAST_GROUPS else first
    rows = rows.join(first, "_sha", "left").withColumn("_revisit", (F.col("_bytes") >= least_bytes) & F.col("_first").isNotNull() & ~F.col("_key").eqNullSafe(F.col("_first")))
    shown = F.when(F.col("_revisit"), F.lit("")).otherwise(F.col("_body"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("_revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce("_id", F.lit("")), F.lit(">")),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("_url", r"[\x00-\x20\x7F]", "%20")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_sha1(F.encode("_body", "UTF-8"))),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("_bytes").cast("string")),
        F.when(F.col("_revisit"), F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("_first").cast("string"), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(shown) + len(HEAD)).cast("string")),
    ]
    return rows.select(F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n" + HEAD), shown, F.lit("\r\n")).alias("record"))


def write_monolithic(record_rows: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Archives in path, each one gzip stream over all its records."""
    record_rows.write.option("compression", "gzip").option("lineSep", "\r\n").option("maxRecordsPerFile", records_per_file).text(path)


def inflated(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The content of a gzip stream of one or more members, piece by piece. A stream that ends early is an error."""
    machine, begun = zlib.decompressobj(31), False
    for chunk in chunks:
        while chunk:
            begun = True
            yield machine.decompress(chunk)
            chunk = machine.unused_data
            if machine.eof:
                machine, begun = zlib.decompressobj(31), False
    if begun and not machine.eof:
        raise ValueError("the gzip stream ends early")


def split_records(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """Whole WARC records, from their version line to the two line ends that close them."""
    buffer, pieces, seen = bytearray(), iter(pieces), 0

    def fill() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            buffer.extend(piece)
        return piece is not None

    while True:
        while (head_end := buffer.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(buffer) - 3)  # what has been searched isn't searched again
            if not fill():
                if buffer.strip():
                    raise ValueError("the archive ends inside a record's header")
                return
        lines = bytes(buffer[:head_end]).split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        size = next(int(x.split(b":", 1)[1]) for x in lines[1:] if x.lower().startswith(b"content-length:"))
        end = head_end + 4 + size + 4
        while len(buffer) < end:
            if not fill():
                raise ValueError("the archive ends inside a record")
        yield bytes(buffer[:end])
        del buffer[:end]
        seen = 0


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-cased names) and the payload: what follows the HTTP head in the block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.decode("utf-8").partition(":")
        headers[name.lower()] = value.strip()
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _join(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    """Spark names local files with one slash, which isn't a whole URI."""
    return fs.FileSystem.from_uri(f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def _pieces(filesystem: fs.FileSystem, path: str) -> Iterator[bytes]:
    with filesystem.open_input_stream(path, compression=None) as file:
        while piece := file.read(PIECE):
            yield piece


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite each gzip archive of folder source in folder target with a member a record, and write a sidecar
    index (tab-separated: offset, length, record id, type) beside it. Returns the manifest: archive, sidecar, n_records. An archive that
    ends early, or holds something else than records, is an error; one without records gives an empty archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = fs.FileSystem.from_uri(target)
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                name = f"{uuid.uuid4().hex}.warc.gz"
                offset, lines = 0, []
                with filesystem.open_output_stream(f"{base}/{name}", compression=None) as out:
                    for record in split_records(inflated(_pieces(*_opened(uri)))):
                        headers, _ = parse(record)
                        member = gzip.compress(record, 6, mtime=0)
                        out.write(member)
                        lines.append(f"{offset}\t{len(member)}\t{headers.get('warc-record-id', '')}\t{headers.get('warc-type', '')}\n")
                        offset += len(member)
                with filesystem.open_output_stream(f"{base}/{name}.idx", compression=None) as out:
                    out.write("".join(lines).encode("utf-8"))
                yield pa.RecordBatch.from_arrays([pa.array([_join(target, name)]), pa.array([_join(target, f"{name}.idx")]), pa.array([len(lines)], pa.int64())], names=["archive", "sidecar", "n_records"])

    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(target)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop_path)
    # Spark lists the folder and deals out the files by their sizes; without the content column it doesn't read them.
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")
    return stash(archives.mapInArrow(run, "archive string, sidecar string, n_records long"), "manifest")


def _proved(headers: dict[str, str], payload: bytes) -> tuple[str, int]:
    """Digest and length of a record's full payload. A revisit has only its headers to say so."""
    said = headers["warc-payload-digest"], int(headers["warc-payload-length"])
    if headers["warc-type"] == "revisit":
        return said
    read = f"sha1:{base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()}", len(payload)
    if read != said:
        raise ValueError(f"{headers['warc-record-id']}: the payload isn't the one its headers name")
    return read


def read_back(manifest: DataFrame) -> DataFrame:
    """A row per record of the manifest's archives, each fetched by its offset in the sidecar: record_id, record_type, target_uri,
    payload_digest, payload_length (of the full payload), refers_to, payload (empty for revisits). Digest and length of a
    response are those of the payload that was read; where its headers say something else, that is an error. A payload of any size is
    one value, held with its record in memory."""
    names = ["record_id", "record_type", "target_uri", "payload_digest", "payload_length", "refers_to", "payload"]
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, sidecar in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                filesystem, path = fs.FileSystem.from_uri(archive)
                _, index_path = fs.FileSystem.from_uri(sidecar)
                with filesystem.open_input_file(index_path) as file:
                    entries = [line.split("\t") for line in file.read().decode("utf-8").splitlines()]
                rows, size = [], 0
                with filesystem.open_input_file(path) as file:
                    for offset, length, *_ in entries:
                        file.seek(int(offset))
                        headers, payload = parse(gzip.decompress(file.read(int(length))))
                        rows.append((headers["warc-record-id"], headers["warc-type"], headers.get("warc-target-uri"), *_proved(headers, payload), headers.get("warc-refers-to"), payload))
                        size += len(payload)
                        if len(rows) >= BATCH_RECORDS or size >= BATCH_BYTES:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    # An archive is a task's unit; the manifest's few rows are dealt out again, by their number alone.
    dealt = manifest.select("archive", "sidecar").repartition(max(manifest.sparkSession.sparkContext.defaultParallelism, manifest.count() // 4))
    return dealt.mapInArrow(run, "record_id string, record_type string, target_uri string, payload_digest string, payload_length long, refers_to string, payload binary")


def archive_round_trip(df: DataFrame, folder: str, **options) -> DataFrame:
    """Write df's rows to monolithic archives in folder, normalise them, and read all records back. The monolithic archives go once
    they are normalised, the folder when the JVM ends."""
    spark = df.sparkSession
    delete_at_end(spark, folder)
    write_monolithic(records(df, **options), _join(folder, "monolithic"))
    manifest = normalise(spark, _join(folder, "monolithic"), _join(folder, "members"))
    done = spark._jvm.org.apache.hadoop.fs.Path(_join(folder, "monolithic"))
    done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, True)
    return read_back(manifest)
