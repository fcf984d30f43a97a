"""What the operators of this package share: reading tables, cutting lineage, null-safe text."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: White space of the word definitions, as a character class body (space, tab to carriage return).
ASCII_SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: Column | str = "text") -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit(""))


#: Rows of an Arrow batch of texts. The default of 10,000 holds tens of megabytes in the JVM and again in each Python worker.
BATCH_ROWS = 2_000


def texts_in_small_batches(df: DataFrame) -> DataFrame:
    """Before a Python pass over texts: lower the session's Arrow batch size to BATCH_ROWS, if it is higher."""
    ship(df.sparkSession)  # the workers need this package
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(df.sparkSession.conf.get(key))
    if rows <= 0 or rows > BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def free_memory() -> None:
    """At the end of a task's Python pass: give freed memory back to the system, since the worker stays for later tasks."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the one the session was given. Only where there is none and all runs on one
    machine (tests) a local one is made; on a cluster that is an error, as each executor would write to its own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tomewright-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def delete_at_end(spark: SparkSession, path: str) -> None:
    """The folder goes when the JVM ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)


@contextlib.contextmanager
def _shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """What runs inside removes its shuffle files when it ends. The session's own setting comes back after."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut, a lost executor costs
    no recomputation, and later joins know the true size. The shuffle files of the write go with its end, as nothing
    reads them again; the folder goes when the JVM ends."""
    spark = ship(df.sparkSession)
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    with _shuffles_cleaned(spark):
        df.write.parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column | str = "doc_id", modulus: int = 4, rest: int = 2) -> Column:
    """Rows that learning must not see: crc32 of the id as text, modulo 4, is 2 (or as said)."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def set_aside(df: DataFrame, *made: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with its columns of the names `made` under names of their own, and what gives a result df's columns back."""
    taken = {m.lower() for m in made}
    aside = {c: f"_{i}_own" if c.lower() in taken else c for i, c in enumerate(df.columns)}
    return df.withColumnsRenamed({c: a for c, a in aside.items() if c != a}), lambda out: out.select(*[F.col(a).alias(c) for c, a in aside.items()])


def other_columns(df: DataFrame, *made: str) -> list[str]:
    """Columns of df that an operator passes through: all but those it makes itself."""
    taken = {m.lower() for m in made}
    return [c for c in df.columns if c.lower() not in taken]
