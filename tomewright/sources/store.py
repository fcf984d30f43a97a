"""Tables as buckets of Parquet files: a merge writes the buckets it touches anew and leaves the others alone."""

from __future__ import annotations

import json
from collections.abc import Sequence

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.upsert import UPDATED, upsert
from ..schemas import BUCKETED_BY, KEYS, SORTED_BY, TABLES

#: Tables laid out by namespace inside their buckets, so that a query of one namespace reads only its files.
PARTITIONED = {"resources", "segments", "entities", "links", "mentions", "embeddings"}
BUCKETS = 16
#: Ids are hexadecimal digests, which snappy leaves as long as they are.
CODEC = "zstd"


class TableStore:
    """Single writer. A row's bucket is the hash of its table's bucket columns. Each write is a generation: a folder of the buckets that it wrote. The
    manifest of the generation names, for each bucket, the generations that hold it (more than one after appends); it is put in
    place last, by a rename, so a failed write leaves the last manifest in force. buckets counts for tables that don't exist yet (16
    serve small tables; a bucket should come to some gigabytes); rebucket deals a table that has grown to more."""

    def __init__(self, spark: SparkSession, path: str, keep_versions: int = 2, buckets: int = BUCKETS):
        if buckets < 1:
            raise ValueError("buckets must be 1 or more")
        self.spark, self.path, self.keep_versions, self.buckets = spark, path.rstrip("/"), max(1, keep_versions), buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # Manifests

    def _generations(self, table: str) -> list[int]:
        folder = self._hadoop(f"{self.path}/{table}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def _manifest(self, table: str, generation: int) -> dict:
        stream = self._fs.open(self._hadoop(f"{self.path}/{table}/manifests/{generation:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _last(self, table: str) -> tuple[int, dict]:
        known = self._generations(table)
        return (known[-1], self._manifest(table, known[-1])) if known else (0, {"buckets": self.buckets, "live": {}})

    def _publish(self, table: str, generation: int, manifest: dict) -> None:
        folder = f"{self.path}/{table}/manifests"
        written = self._hadoop(f"{folder}/writing")
        stream = self._fs.create(written, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        self._fs.rename(written, self._hadoop(f"{folder}/{generation:08d}.json"))
        self._clean(table)

    def _clean(self, table: str) -> None:
        """Old manifests go, and generations that none of the kept ones names."""
        known = self._generations(table)
        kept = known[-self.keep_versions :]
        named = {g for k in kept for held in self._manifest(table, k)["live"].values() for g in held}
        for old in known[: -self.keep_versions]:
            self._fs.delete(self._hadoop(f"{self.path}/{table}/manifests/{old:08d}.json"), False)
        for status in self._fs.listStatus(self._hadoop(f"{self.path}/{table}")):
            name = status.getPath().getName()
            if name.startswith("gen=") and int(name[4:]) not in named and int(name[4:]) <= known[-1]:
                self._fs.delete(status.getPath(), True)

    # Rows

    def _bucket(self, table: str, count: int) -> Column:
        return F.pmod(F.xxhash64(*BUCKETED_BY[table]), F.lit(count)).cast("int")

    def read(self, table: str, buckets: Sequence[int] | None = None) -> DataFrame:
        """The table, or some of its buckets. Buckets that newer generations replaced are left out by their folder names alone."""
        schema, (_, manifest) = TABLES[table], self._last(table)
        held: dict[int, list[int]] = {}
        for bucket, generations in manifest["live"].items():
            for generation in generations if buckets is None or int(bucket) in buckets else ():
                held.setdefault(generation, []).append(int(bucket))
        if not held:
            return self.spark.createDataFrame([], schema)
        full = T.StructType([*schema.fields, T.StructField("gen", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
        folder = f"{self.path}/{table}"
        rows = self.spark.read.schema(full).option("basePath", folder).parquet(*[f"{folder}/gen={g}" for g in sorted(held)])
        live = F.lit(False)
        for generation, own in held.items():
            live = live | ((F.col("gen") == generation) & F.col("bucket").isin(own))
        return rows.where(live).select(*schema.names)

    def _written(self, table: str, rows: DataFrame, generation: int, count: int, lie: bool = False) -> set[int]:
        """Write rows as a generation; the buckets that have rows. Rows that lie by folder already are written by the tasks that have them."""
        folder = f"{self.path}/{table}/gen={generation}"
        self._fs.delete(self._hadoop(folder), True)  # what a failed write left
        laid = ["bucket", *(["namespace"] if table in PARTITIONED else [])]
        ready = rows.select(*TABLES[table].names).withColumn("bucket", self._bucket(table, count))
        # One shuffle by folder. Spark deals it by size: small folders share a task, a large one is split over as many as it fills.
        dealt = ready if lie else ready.hint("rebalance", *laid)
        dealt.sortWithinPartitions(*laid, *SORTED_BY.get(table, [])).write.partitionBy(*laid).option("compression", CODEC).parquet(folder)
        found = [s.getPath().getName() for s in self._fs.listStatus(self._hadoop(folder))]
        return {int(n.removeprefix("bucket=")) for n in found if n.startswith("bucket=")}

    def write(self, table: str, rows: DataFrame, buckets: int | None = None, lie: bool = False) -> None:
        """The whole table anew, in as many buckets as it has or in the number given. rows may read the table as it is. lie says that each task's
        rows are of few buckets and namespaces, so that no shuffle is needed to keep files few."""
        last, manifest = self._last(table)
        count = buckets or manifest["buckets"]
        filled = self._written(table, rows, last + 1, count, lie)
        self._publish(table, last + 1, {"buckets": count, "live": {str(b): [last + 1] for b in sorted(filled)}})

    def rebucket(self, table: str, buckets: int) -> None:
        """The same rows in another number of buckets."""
        self.write(table, self.read(table), buckets)

    def append(self, table: str, rows: DataFrame) -> list[int]:
        """Add rows whose keys the table doesn't have. What is there is neither read nor written."""
        last, manifest = self._last(table)
        filled = self._written(table, rows, last + 1, manifest["buckets"])
        live = {**manifest["live"], **{str(b): [*manifest["live"].get(str(b), []), last + 1] for b in filled}}
        self._publish(table, last + 1, {"buckets": manifest["buckets"], "live": live})
        return sorted(filled)

    def _replace(self, table: str, touched: list[int], rows: DataFrame, lie: bool = False) -> None:
        last, manifest = self._last(table)
        filled = self._written(table, rows, last + 1, manifest["buckets"], lie)
        live = {b: g for b, g in manifest["live"].items() if int(b) not in touched} | {str(b): [last + 1] for b in filled}
        self._publish(table, last + 1, {"buckets": manifest["buckets"], "live": live})

    def bucket_of(self, table: str, *values: str) -> int:
        """The bucket of a row with these texts in the table's bucket columns, without a job: each column's hash is the next one's seed."""
        held = 42
        for value in values:
            held = xxhash.xxh64_intdigest(value.encode("utf-8"), seed=held)
        return (held - (1 << 64) if held >= 1 << 63 else held) % self._last(table)[1]["buckets"]

    def touched(self, table: str, rows: DataFrame) -> list[int]:
        """The buckets of rows, which have the table's bucket columns; as many numbers as there are buckets at most."""
        _, manifest = self._last(table)
        return sorted(r[0] for r in rows.select(self._bucket(table, manifest["buckets"]).alias("b")).distinct().collect())

    def merge(self, table: str, incoming: DataFrame, order: Column | None = None) -> list[int]:
        """Upsert incoming by the table's keys. Only the buckets that it has rows of are read and written; returns them."""
        touched = self.touched(table, incoming)
        if touched:
            self._replace(table, touched, upsert(self.read(table, touched), incoming, KEYS[table], UPDATED[table], order))
        return touched

    def delete(self, table: str, gone: DataFrame, on: Sequence[str] | None = None, buckets: Sequence[int] | None = None, few: bool = False) -> list[int]:
        """Take out the rows that agree with a row of gone in the columns on, or in all of the table's bucket and key columns that gone has. If
        these have the bucket columns, only their buckets are read and written, otherwise all, or those given, which must hold all that goes.
        Returns those that were written. few says that gone may be sent to every task; then what stays isn't shuffled."""
        on = list(on or [c for c in dict.fromkeys([*BUCKETED_BY[table], *KEYS[table]]) if c in gone.columns])
        live = sorted(map(int, self._last(table)[1]["live"]))
        if buckets is None and set(BUCKETED_BY[table]) <= set(on):
            buckets = self.touched(table, gone)
        touched = live if buckets is None else [b for b in buckets if b in live]
        if touched:
            rows, out = self.read(table, touched).alias("t"), gone.select(*on).distinct()
            out = (F.broadcast(out) if few else out).alias("g")
            self._replace(table, touched, rows.join(out, [F.col(f"t.{c}").eqNullSafe(F.col(f"g.{c}")) for c in on], "left_anti"), lie=few)
        return touched

    def keys(self, table: str) -> list[str]:
        return KEYS[table]
