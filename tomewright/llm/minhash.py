"""Near-duplicate documents by one-permutation MinHash, banded buckets and star-shaped candidate edges.

1. One pass hashes each text's distinct word shingles once. The 64-bit range is cut into bins; a bin's value is the least hash in
   it, and an empty bin borrows from the first filled bin of its own fixed random probe order (optimal densification).
   Bands of bins make bucket keys.
2. Texts with equal shingle sets are one node from here on, so a large group of copies is one row.
3. In each bucket of two or more nodes, edges run from one centre to the others: pairs grow with the members, not with
   their square. Edges are confirmed on the full sets; components of confirmed links make classes.
4. A star may miss a link between two of its outer nodes. In buckets whose members aren't one class yet, nodes that provably
   can't link to any other (too few of their shingles occur in any other open node) leave. Each pair still open has a node outside its
   bucket's largest class. If the shingles of those nodes are few enough to be sent to every task, one pass compares all open
   nodes with them. If not, further rounds of stars come first, with four times as many centres each round; a node that was a
   centre of a bucket is done there. In the end every pair that shares a bucket is in one class, was compared, or was excluded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_memory, stash, texts_in_small_batches
from .graph import connected_components

WORDS, THRESHOLD = 5, (80, 100)
BANDS = 42
#: Chance that a pair at the threshold shares no bucket.
MISS = 1e-8
#: Node ids that may be broadcast to pick texts (8 MB); beyond that, a shuffled join picks them.
BROADCAST_NODES = 1_000_000
#: Shingles of outer nodes that may be sent to all tasks at once (8 bytes each); beyond that, rounds of joins compare them.
BLOCK_SHINGLES = 2_000_000
MEMO_WORDS = 150_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def rows_per_band(threshold: tuple[int, int], bands: int = BANDS, miss: float = MISS) -> int:
    """The most rows a band may have, so that a pair at the threshold is missed with a chance of at most miss."""
    t, rows = threshold[0] / threshold[1], 1
    while rows < 12 and (1 - t ** (rows + 1)) ** bands <= miss:
        rows += 1
    return rows


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class Signer:
    """Shingle sets and band keys of texts; one for each task."""

    def __init__(self, words: int, bands: int, rows: int):
        self.words, self.bands, self.rows, self.bins = words, bands, rows, bands * rows
        self.memo = _WordHashes()
        random = np.random.default_rng(11)
        self.probes = random.integers(0, self.bins, (self.bins, 1024), dtype=np.int64)
        self.factors = random.integers(0, 1 << 63, self.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.band_salt = random.integers(0, 1 << 63, self.bands, dtype=np.uint64)
        # Drawn on their own: sets don't depend on the bands.
        self.shingle_factors = np.random.default_rng(12).integers(0, 1 << 63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.borders = np.array([(i << 64) // self.bins for i in range(self.bins)], dtype=np.uint64)

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the text's shingles (A-Z lower-cased, words between ASCII white space)."""
        found = (text or "").encode("utf-8").lower().split()
        if not found:
            return np.zeros(0, np.uint64)
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        hashes = np.fromiter(map(self.memo.__getitem__, found), np.uint64, len(found))
        with np.errstate(over="ignore"):
            if len(found) < self.words:
                whole = np.uint64(len(found))
                for h in hashes:
                    whole = _mix(np.array([whole * _M1 + h], np.uint64))[0]
                return np.array([whole], np.uint64)
            n = len(found) - self.words + 1
            total = np.zeros(n, np.uint64)
            for k in range(self.words):
                total += hashes[k : k + n] * self.shingle_factors[k]
            return np.unique(_mix(total))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        at = np.searchsorted(shingles, self.borders)
        filled = np.diff(at, append=len(shingles)) > 0
        values = shingles[np.minimum(at, len(shingles) - 1)]
        empty = np.flatnonzero(~filled)
        start = 0
        while len(empty):
            end = 16 if start == 0 else 1024
            probes = self.probes[empty, start:end] if start < 1024 else (self.probes[empty] + start) % self.bins
            hit = filled[probes]
            found = hit.any(1)
            values[empty[found]] = values[probes[found, hit[found].argmax(1)]]
            empty, start = empty[~found], max(end, start + 1) if start < 1024 else start + 1
        return values

    def band_keys(self, shingles: np.ndarray) -> np.ndarray:
        if not len(shingles):
            return np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            table = self.signature(shingles).reshape(self.bands, self.rows)
            return _mix((table * self.factors).sum(1, dtype=np.uint64) ^ self.band_salt).view(np.int64)


def signatures(df: DataFrame, key: str, text: str, words: int, bands: int, rows: int) -> DataFrame:
    """doc, text_hash (of the text, null as empty), n_shingles, set_key (digest of the set; null without words), bands (bucket keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(words, bands, rows)
        for batch in batches:
            sizes, keys, buckets = [], [], []
            for value in batch.column(1):
                s = signer.shingles(value.as_py())
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                buckets.append(signer.band_keys(s))
            offsets = np.concatenate([[0], np.cumsum([len(b) for b in buckets])]).astype(np.int32)
            flat = np.concatenate(buckets) if buckets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc", "text_hash", "n_shingles", "set_key", "bands"])
        free_memory()

    schema = T.StructType([T.StructField("doc", df.schema[key].dataType), T.StructField("text_hash", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    return texts_in_small_batches(df).select(F.col(key).alias("doc"), F.col(text).alias("text"), text_hash(text)).mapInArrow(run, schema)


def text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash")


def _sets(df: DataFrame, key: str, text: str, nodes: DataFrame, words: int) -> DataFrame:
    """node, size, shingles (array of long) of the given nodes, from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(words, 1, 1)
        for batch in batches:
            sets = [signer.shingles(v.as_py()).view(np.int64) for v in batch.column(1)]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())], names=["node", "want", "size", "shingles", "got"])
        free_memory()

    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("node", kind), T.StructField("want", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType())), T.StructField("got", T.BinaryType())])
    picked = F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes
    rows = df.select(F.col(key).alias("node"), F.col(text).alias("text")).join(picked, "node")
    # An id may occur with several texts: only the one that the node stands for counts.
    found = rows.select("node", "text", "set_key").mapInArrow(run, schema).where("want = got")
    return stash(found.select("node", "size", "shingles"), "sets").dropDuplicates(["node"])


def _confirmed(edges: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Edges (a, b) whose sets' similarity reaches the threshold, tested in whole numbers."""
    low, high = threshold
    left = sets.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("shingles").alias("set_b"))
    small, large = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    sized = edges.join(left.drop("set_a"), "a").join(right.drop("set_b"), "b").where(small * high >= large * low).select("a", "b")
    shared = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    return sized.join(left, "a").join(right, "b").where(shared * high >= (F.col("size_a") + F.col("size_b") - shared) * low).select("a", "b")


def _still_possible(open_rows: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Nodes of open buckets that may link to another open node. A node that links to one of size m shares at
    least low / (low + high) * (size + m) shingles with it, and only shingles that another open node has can be shared."""
    low, high = threshold
    smallest = open_rows.join(sets.select("node", "size"), "node")
    # Stored, so that the join with a hot bucket's members stands alone and can be split.
    by_bucket = stash(smallest.groupBy("bucket").agg(F.min("size").alias("mate")), "mates")
    mates = smallest.select("bucket", "node").join(by_bucket, "bucket").groupBy("node").agg(F.min("mate").alias("mate"))
    exploded = sets.join(mates.select("node"), "node", "left_semi").select("node", F.explode("shingles").alias("shingle"))
    shared = exploded.groupBy("shingle").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last").select("shingle")
    counts = exploded.join(shared, "shingle", "left_semi").groupBy("node").agg(F.count("*").alias("shared"))
    least_mate = F.greatest(F.col("mate"), F.ceil(F.col("size") * low / high))
    return counts.join(sets.select("node", "size"), "node").join(mates, "node").where(F.col("shared") * (low + high) >= (F.col("size") + least_mate) * low).select("node")


def _in_open_buckets(labelled: DataFrame) -> DataFrame:
    """The rows (bucket, node, component) of buckets that hold more than one component."""
    labelled = stash(labelled, "labelled")
    split = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
    return stash(labelled.join(stash(split, "split"), "bucket", "left_semi"), "open")


def _relabelled(labels: DataFrame, found: DataFrame) -> DataFrame:
    """labels after links between components (a, b) merge them. Only the components that merge are worked on."""
    merged = stash(connected_components(found), "merged").select(F.col("node").alias("component"), F.col("component").alias("into"))
    moved = labels.join(merged, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    alone = merged.select(F.col("component").alias("node"), F.col("into").alias("component")).join(labels, "node", "left_anti")
    return stash(moved.unionByName(alone), "labels")


def _against_block(rows: DataFrame, block: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Links (a, b) between components of rows and of a block of bounded size, both (node, component, size, shingles). The block's shingles
    become an inverted index, sent to the tasks; each row is compared with the whole block by counting there. A task names at most one link for each
    component it meets: those that join classes it has not joined yet."""
    low, high = threshold
    held = block.select("component", "shingles").toArrow()
    names, sets = held["component"].to_pylist(), held["shingles"].combine_chunks()
    lengths = np.asarray(sets.value_lengths(), np.int64)
    flat = np.asarray(sets.flatten(), np.int64)
    order = np.argsort(flat, kind="stable")
    keys, starts = np.unique(flat[order], return_index=True)
    sent = rows.sparkSession.sparkContext.broadcast((names, lengths, keys, np.append(starts, len(flat)), np.repeat(np.arange(len(names)), lengths)[order]))
    kind = rows.schema["component"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, lengths, keys, starts, owners = sent.value
        joined: dict = {}

        def root(x):
            while joined.setdefault(x, x) != x:
                joined[x] = x = joined[joined[x]]
            return x

        for batch in batches:
            a, b = [], []
            for component, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = values.values.to_numpy()
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                at = at[keys[at] == own]
                counts = starts[at + 1] - starts[at]
                places = np.repeat(starts[at] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
                met, shared = np.unique(owners[places], return_counts=True)
                # A link that follows from the links the task has named already isn't named again.
                for i in met[shared * high >= (len(own) + lengths[met] - shared) * low]:
                    if (x := root(component)) != (y := root(names[i])):
                        joined[y] = x
                        a.append(component)
                        b.append(names[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, batch.schema.field(0).type), pa.array(b, batch.schema.field(0).type)], names=["a", "b"])

    return rows.select("component", "shingles").mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: tuple[int, int] = THRESHOLD, bands: int = BANDS, hashes: bool = False) -> DataFrame:
    """Per row of df: key, n_shingles (size of the set), component_id (smallest key of its class), kept (key = component_id), and with
    hashes text_hash, by which rows of one key with different texts are told apart.

    Texts are linked if high * intersection >= low * union of their distinct shingles, threshold = (low, high). A text of fewer words than a shingle
    is one shingle; a null text, or one without words, has no shingle and is a class of its own. A row without a key is
    kept. Rows with equal keys each give a row; if they are the least of several sets, the set of least digest is the one compared. Needs the folder of spark.checkpoint.dir: every step is stored there."""
    rows_in_band = rows_per_band(threshold, bands)
    signed = stash(signatures(df, key, text, words, bands, rows_in_band), "signed")
    nodes = stash(signed.where("set_key is not null").groupBy("set_key").agg(F.min(F.when(F.col("doc").isNotNull(), F.struct("doc", "bands"))).alias("least"), F.count("*").alias("copies")).select("set_key", "copies", F.col("least.doc").alias("node"), F.col("least.bands").alias("bands")), "nodes")
    buckets = nodes.where("node is not null").select("node", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre <> last").select("bucket", "centre")
    members = stash(buckets.join(stash(shared, "shared"), "bucket"), "members")
    wanted = members.select("node").distinct().join(nodes.groupBy("node").agg(F.min("set_key").alias("set_key")), "node")
    sets = _sets(df, key, text, stash(wanted, "wanted"), words)
    sets = stash(sets, "sets")
    first = members.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    links = stash(_confirmed(first, sets, threshold), "links")
    labels = stash(connected_components(links), "labels")
    open_rows = members.where("node <> centre").select("bucket", "node")  # a centre has met all members
    round_no = 0
    while True:
        labelled = _in_open_buckets(open_rows.join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component")))
        if labelled.isEmpty():
            break
        possible = stash(_still_possible(labelled.select("bucket", "node"), sets, threshold), "possible")
        labelled = _in_open_buckets(labelled.join(possible, "node", "left_semi"))
        if labelled.isEmpty():
            break
        # Every pair still to be compared has a node outside its bucket's largest class.
        weights = labels.groupBy("component").agg(F.count("*").alias("weight"))
        weighed = labelled.join(weights, "component", "left").withColumn("weight", F.coalesce("weight", F.lit(1).cast("long")))
        weighed = stash(weighed, "weighed")
        largest = stash(weighed.groupBy("bucket").agg(F.max(F.struct("weight", "component")).alias("x")).select("bucket", F.col("x.component").alias("largest")), "largest")
        outer = stash(weighed.join(largest, "bucket").where("component <> largest").select("node", "component").distinct(), "outer")
        if (outer.join(sets, "node").agg(F.sum("size")).first()[0] or 0) <= BLOCK_SHINGLES:
            nodes_open = labelled.select("node", "component").distinct()
            labels = _relabelled(labels, stash(_against_block(nodes_open.join(sets, "node"), outer.join(sets, "node"), threshold), "found"))
            break
        drawn = F.pmod(F.xxhash64("node", F.lit(round_no)), F.lit(1 << 30)) * F.col("n") < F.lit(4**round_no << 30)
        state = labelled.groupBy("bucket").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("node", F.lit(round_no))).alias("centre"))
        counted = stash(labelled.join(stash(state, "state"), "bucket"), "open")
        centres = stash(counted.where(drawn | (F.col("node") == F.col("centre"))).select("bucket", F.col("node").alias("a"), F.col("component").alias("component_a")), "centres")
        pairs = centres.join(counted.select("bucket", F.col("node").alias("b"), "component"), "bucket").where("a <> b and component_a <> component")
        found = _confirmed(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets, threshold)
        side = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"{x}_in"))
        found = found.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b"))
        labels = _relabelled(labels, stash(found, "found"))
        open_rows = counted.select("bucket", "node").join(centres.select("bucket", F.col("a").alias("node")), ["bucket", "node"], "left_anti")
        round_no += 1
    classes = nodes.join(labels, "node", "left").where("copies > 1 or component is not null").select("set_key", F.coalesce("component", "node").alias("class"))
    out = signed.select("doc", "text_hash", "n_shingles", "set_key").join(stash(classes, "classes"), "set_key", "left")
    component = F.coalesce("class", "doc")
    return out.select(F.col("doc").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"), *(["text_hash"] if hashes else []))
