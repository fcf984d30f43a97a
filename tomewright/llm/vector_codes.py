"""Product codes of vectors, learned by the filtering form of Lloyd's iteration.

Components become integers, floor(256 x), so all distances are exact. A vector is cut into equal consecutive parts and each part is
named by the nearest entry of its position's codebook. Every task cuts its rows into blocks and builds, for each block and part
position, a kd-tree whose nodes hold a bounding box, a count and the sum of their points; the trees are stored once and serve all
rounds. A round walks a tree with the codebook: an entry that is farther than another one from every place in a node's box leaves,
and a node with one entry left gives that entry its whole count and sum. Only points of leaves that keep several
entries are measured. What the driver gets of a round is a count and a sum per part position and entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .common import free_memory, stash

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows of a block, points of a leaf.
BLOCK_ROWS, LEAF_POINTS = 4096, 8
#: Integers are held between this and its negative, so that sums of squares of up to a thousand components fit 64 bits.
MOST = 1 << 25
#: Sums by label that may be broadcast.
BROADCAST_LABELS = 50_000


@dataclass(frozen=True)
class Tree:
    """Points of one part position in tree order. Node i of level l holds the points from starts(l)[i] to starts(l)[i + 1]."""

    points: np.ndarray  # n x d
    order: np.ndarray  # the place of each point in its block
    low: list[np.ndarray]  # for each level: nodes x d
    high: list[np.ndarray]
    total: list[np.ndarray]

    @property
    def depth(self) -> int:
        return len(self.low) - 1

    def starts(self, level: int) -> np.ndarray:
        return _starts(len(self.points), level)


def _starts(n: int, level: int) -> np.ndarray:
    return (n * np.arange((1 << level) + 1)) >> level


def build_tree(points: np.ndarray, leaf: int = LEAF_POINTS) -> Tree:
    """Halved again and again along the widest side, all nodes of a level at once."""
    n, d = points.shape
    depth = max(0, (n // leaf).bit_length() - 1)
    order = np.arange(n)
    for level in range(depth):
        starts = _starts(n, level)
        placed = points[order]
        wide = np.maximum.reduceat(placed, starts[:-1]) - np.minimum.reduceat(placed, starts[:-1])
        node = np.repeat(np.arange(1 << level), np.diff(starts))
        value = placed[np.arange(n), wide.argmax(1)[node]]
        order = order[np.lexsort((value, node))]
    return _with_nodes(points[order], order, depth)


def _with_nodes(placed: np.ndarray, order: np.ndarray, depth: int) -> Tree:
    """Boxes and sums of the leaves from their points, those of the levels above from their children."""
    first = _starts(len(placed), depth)[:-1]
    low, high, total = ([f.reduceat(placed, first)] for f in (np.minimum, np.maximum, np.add))
    for _ in range(depth):
        for levels, f in ((low, np.minimum), (high, np.maximum), (total, np.add)):
            levels.append(f(levels[-1][::2], levels[-1][1::2]))
    return Tree(placed, order, low[::-1], high[::-1], total[::-1])


def _farther(entries: np.ndarray, best: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """nodes x entries: whether an entry loses to best (an entry a node) everywhere in the node's box. |z - p|^2 - |b - p|^2 is linear in p, so
    its least value lies in the corner that is farthest along z - b. Where that is zero the lower index wins."""
    to = entries[None, :, :] - entries[best][:, None, :]
    corner = np.where(to > 0, high[:, None, :], low[:, None, :])
    least = (to * (entries[None, :, :] + entries[best][:, None, :] - 2 * corner)).sum(2)
    return (least > 0) | ((least == 0) & (np.arange(len(entries))[None, :] > best[:, None]))


def filtered(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The entry of each point in tree order, counts and sums of the entries, and the number of points that were measured."""
    k, (n, d) = len(entries), tree.points.shape
    assigned = np.zeros(n, np.int64)
    counts, sums, measured = np.zeros(k, np.int64), np.zeros((k, d), np.int64), 0
    nodes, left = np.zeros(1, np.int64), np.ones((1, k), bool)
    for level in range(tree.depth + 1):
        low, high, starts = tree.low[level][nodes], tree.high[level][nodes], tree.starts(level)
        # The entry nearest to the box's middle, in doubled coordinates. Any of those left would do.
        from_middle = ((2 * entries[None, :, :] - (low + high)[:, None, :]) ** 2).sum(2)
        best = np.where(left, from_middle, np.iinfo(np.int64).max).argmin(1)
        left = left & ~_farther(entries, best, low, high)
        alone = left.sum(1) == 1
        if alone.any():
            won, whole = best[alone], nodes[alone]
            size = starts[whole + 1] - starts[whole]
            np.add.at(counts, won, size)
            np.add.at(sums, won, tree.total[level][whole])
            assigned[_ranges(starts[whole], size)] = np.repeat(won, size)
        nodes, left = nodes[~alone], left[~alone]
        if not len(nodes):
            break
        if level < tree.depth:
            nodes, left = (2 * nodes[:, None] + np.arange(2)).ravel(), np.repeat(left, 2, axis=0)
            continue
        size = starts[nodes + 1] - starts[nodes]
        at = _ranges(starts[nodes], size)
        own = tree.points[at]
        measured = len(own)
        apart = (entries**2).sum(1)[None, :] - 2 * (own @ entries.T)  # less the point's own square, which is the same for all entries
        won = np.where(np.repeat(left, size, axis=0), apart, np.iinfo(np.int64).max).argmin(1)
        assigned[at] = won
        counts += np.bincount(won, minlength=k)
        np.add.at(sums, won, own)
    return assigned, counts, sums, measured


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the ranges that begin at starts, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def kept(vector: Column, size: int | None = None) -> Column:
    """Vectors without null or non-finite components, of the given length if there is one."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    test = vector.isNotNull() & (F.size(vector) > 0) & ~bad
    return F.coalesce(test if size is None else test & (F.size(vector) == size), F.lit(False))


def integers(rows: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """rows x parts x components: floor(256 x), held to MOST; the last part is filled up with zeros."""
    whole = np.floor(np.clip(rows.astype(np.float64) * SCALE, -MOST, MOST)).astype(np.int64)
    lacking = -whole.shape[1] % parts
    return np.pad(whole, ((0, 0), (0, lacking))).reshape(len(whole), parts, -1)


_TREES = T.StructType([T.StructField("points", T.BinaryType()), T.StructField("orders", T.BinaryType())])


def tree_blocks(df: DataFrame, keep: list[str], vector: str, size: int, parts: int) -> DataFrame:
    """A row per block: rows (an array of the columns keep) and the trees of its parts."""
    row = T.StructType([df.schema[c] for c in keep])
    schema = T.StructType([T.StructField("rows", T.ArrayType(row)), *_TREES.fields])

    def block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        flat = table.column(vector).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        trees = [build_tree(p) for p in integers(flat.reshape(-1, size), parts).transpose(1, 0, 2)]
        columns = [table.column(c).combine_chunks() for c in keep]
        named = pa.StructArray.from_arrays(columns, names=keep)
        lists = pa.ListArray.from_arrays(pa.array([0, len(named)], pa.int32()), named)
        points, orders = (b"".join(a.tobytes() for a in made) for made in ([t.points.astype("<i4") for t in trees], [t.order.astype("<i4") for t in trees]))
        return pa.RecordBatch.from_arrays([lists, pa.array([points], pa.binary()), pa.array([orders], pa.binary())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                if count and count + part.num_rows > BLOCK_ROWS:
                    yield block(held)
                    held, count = [], 0
                held.append(part)
                count += part.num_rows
        if count:
            yield block(held)
        free_memory()

    ship(df.sparkSession)
    return df.select(*keep, vector).mapInArrow(run, schema)


def read_trees(points: bytes, orders: bytes, parts: int, width: int) -> list[Tree]:
    """The trees of a block as they were built; boxes and sums follow from the points in tree order."""
    placed = np.frombuffer(points, "<i4").astype(np.int64).reshape(parts, -1, width)
    order = np.frombuffer(orders, "<i4").astype(np.int64).reshape(parts, -1)
    depth = max(0, (placed.shape[1] // LEAF_POINTS).bit_length() - 1)
    return [_with_nodes(p, o, depth) for p, o in zip(placed, order, strict=True)]


@dataclass(frozen=True)
class Codebooks:
    """entries: parts x entries x components, integers. size: the length of the vectors they were learned from."""

    entries: np.ndarray
    size: int

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _sums(blocks: DataFrame, books: Codebooks) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Of each part position and entry that has points: their count and sum. A task passes on one row for each."""
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for points, orders in zip(batch.column(0), batch.column(1), strict=True):
                for i, tree in enumerate(read_trees(points.as_py(), orders.as_py(), parts, width)):
                    _, c, s, _ = filtered(tree, books.entries[i])
                    counts[i] += c
                    sums[i] += s
        part, entry = np.nonzero(counts)
        found = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry], pa.int64())]
        yield pa.RecordBatch.from_arrays([*found, *[pa.array(sums[part, entry, j], pa.int64()) for j in range(width)]], names=names)
        free_memory()

    names = ["part", "entry", "n", *[f"s{j}" for j in range(width)]]
    made = blocks.select("points", "orders").mapInArrow(run, ", ".join(f"{c} {'int' if i < 2 else 'long'}" for i, c in enumerate(names)))
    rows = made.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names[2:]]).collect()  # parts * entries rows at most
    return {(r["part"], r["entry"]): (r["n"], [r[f"s{j}"] for j in range(width)]) for r in rows}


def start(df: DataFrame, key: str = "vec_id", vector: str = "vector", parts: int = PARTS, entries: int = ENTRIES) -> Codebooks | None:
    """The parts of the vectors with the smallest keys, ascending; None if no vector can be used. The length of the first of them is that
    of all: vectors of other lengths aren't coded. Null keys come last, equal keys by their vectors."""
    order = [F.asc_nulls_last(key), F.asc(vector)]
    first = df.where(kept(F.col(vector))).orderBy(*order).select(F.size(vector)).first()
    if first is None:
        return None
    rows = df.where(kept(F.col(vector), first[0])).orderBy(*order).limit(entries).select(vector).collect()
    return Codebooks(integers(np.array([r[0] for r in rows], dtype=np.float64), parts).transpose(1, 0, 2), first[0])


def learn(blocks: DataFrame, books: Codebooks, rounds: int = ROUNDS) -> Codebooks:
    """Lloyd rounds over all blocks. An entry becomes the floored mean of its parts; one without parts stays."""
    for _ in range(rounds):
        entries = books.entries.copy()
        for (part, entry), (n, total) in _sums(blocks, books).items():
            entries[part, entry] = [s // n for s in total]
        books = Codebooks(entries, books.size)
    return books


def assign(blocks: DataFrame, books: Codebooks) -> DataFrame:
    """A row for each row of the blocks: its columns, code (two hexadecimal digits a part) and error (squared distances, summed over parts)."""
    parts, _, width = books.entries.shape
    row = blocks.schema["rows"].dataType.elementType
    schema = T.StructType([*row.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                trees = read_trees(batch.column(1)[at].as_py(), batch.column(2)[at].as_py(), parts, width)
                n = len(trees[0].points)
                codes, error = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
                for i, tree in enumerate(trees):
                    won, *_ = filtered(tree, books.entries[i])
                    codes[tree.order, i] = won
                    error[tree.order] += ((tree.points - books.entries[i][won]) ** 2).sum(1)
                named = batch.column(0).slice(at, 1).flatten()
                hexed = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays([*named.flatten(), pa.array([hexed[j : j + 2 * parts] for j in range(0, len(hexed), 2 * parts)], pa.string()), pa.array(error, pa.int64())], names=schema.names)
        free_memory()

    return blocks.select("rows", "points", "orders").mapInArrow(run, schema)


def product_codes(df: DataFrame, key: str = "vec_id", vector: str = "vector", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """key, label, code, error and label_error (error summed over rows of the same label; null labels are one) of all rows with a usable vector, and
    the codebooks that were learned. At most 256 entries, as a code has two hexadecimal digits a part.

    Rows whose vector is null, empty, of another length than the one of the smallest key, or holds a null or non-finite component are
    left out; components beyond MOST / 256 count as that. A length that isn't a multiple of parts is filled up with
    zeros. Repeated rows are rows of their own; a null key is coded like any other; other columns aren't read. Without
    usable rows the result is empty and the codebooks are None."""
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256")
    books = start(df, key, vector, parts, entries)
    out = T.StructType([df.schema[key], df.schema[label], T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("label_error", T.LongType())])
    if books is None:
        return df.sparkSession.createDataFrame([], out), None
    blocks = stash(tree_blocks(df.where(kept(F.col(vector), books.size)), [key, label], vector, books.size, parts), "trees")
    books = learn(blocks, books, rounds)
    coded = stash(assign(blocks, books), "codes")
    sums = coded.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error"))
    if coded.select(F.approx_count_distinct(label)).first()[0] * 2 <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    return coded.join(sums, F.col(label).eqNullSafe(F.col("_label"))).select(*out.names), books
