"""Benchmark decontamination with an FM-index for each shard of the training texts.

A shard is a run of texts inside a task, of SHARD_BYTES. Its index text is a sequence of word ids over the benchmark's
vocabulary: a word outside it can't lie in an occurrence, so each maximal run of benchmark words stays, if it is as long as the
shortest phrase, and everything else becomes one separator. Over that sequence:
suffix array by prefix doubling -> Burrows-Wheeler transform -> wavelet matrix for ranks.
All phrases are searched backwards at once; occurrences are located by walking back to sampled suffix
positions; their spans are merged per text. Texts don't move between tasks, and the plan is one pass over the scan: the phrases of
benchmark items lie in the shared folder in blocks of a bounded size, and a task searches its shard for one block after the other.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import delete_at_end, free_memory, set_aside, shared_folder, texts_in_small_batches

WINDOW = 13
#: Benchmark bytes of one block. The driver and each task hold the phrases of one block at a time.
BLOCK_BYTES = 4_000_000
#: Text bytes after which a shard is indexed, and the distance of sampled suffix positions.
SHARD_BYTES, SAMPLE_RATE = 24_000_000, 16
#: Words: digits, letters a-z and all beyond ASCII, after A-Z are lower-cased; other ASCII parts them.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_FOLD).split()


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector a level, the high bit first."""

    def __init__(self, sequence: np.ndarray, most: int):
        self.levels = max(1, int(most).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        self.size = len(sequence)
        rest = sequence
        for level in range(self.levels - 1, -1, -1):
            bits = (rest >> level) & 1
            ones = np.zeros(len(bits) + 1, np.int32)
            np.cumsum(bits, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(bits) - int(ones[-1]))
            rest = np.concatenate([rest[bits == 0], rest[bits == 1]])
        # Where each symbol begins in the last order.
        self.first = np.searchsorted(self._codes(rest), self._codes(np.arange(1 << self.levels)))

    def _codes(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols are ordered by their reversed bits after the last level."""
        out, rest = np.zeros_like(symbols), symbols.copy()
        for _ in range(self.levels):
            out, rest = (out << 1) | (rest & 1), rest >> 1
        return out

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        for i, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = ((symbols >> (self.levels - 1 - i)) & 1).astype(bool)
            before = ones[at]
            at = np.where(one, zeros + before, at - before)
        return at - self._start(symbols)

    def _start(self, symbols: np.ndarray) -> np.ndarray:
        return self.first[symbols]

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at positions."""
        symbol = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            before = ones[at]
            one = (ones[at + 1] - before).astype(bool)
            symbol = (symbol << 1) | one
            at = np.where(one, zeros + before, at - before)
        return symbol


def suffix_order(sequence: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. Separators (0) are all unlike, earlier ones smaller, so no comparison runs past one."""
    n = len(sequence)
    separators = sequence == 0
    rank = sequence.astype(np.int64) + int(separators.sum())
    rank[separators] = np.arange(int(separators.sum()))
    step = 1
    order = np.argsort(rank, kind="stable")
    while True:
        following = np.zeros(n, np.int64)
        following[: n - step] = rank[step:] + 1
        key = rank * np.int64(n + int(rank.max()) + 2) + following if step == 1 else rank * np.int64(n + 2) + following
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        step *= 2
        if n == 0 or rank[order[-1]] == n - 1 or step >= n:
            return order


class FMIndex:
    """Backward search and location over a sequence of symbols, 0 being the separator, which ends the sequence."""

    def __init__(self, sequence: np.ndarray, alphabet: int, rate: int = SAMPLE_RATE):
        order = suffix_order(sequence)
        self.transform = sequence[order - 1]
        self.wavelet = WaveletMatrix(self.transform, alphabet)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=alphabet + 1))])
        # Sampled: every rate-th position and what follows a separator, so that a walk back never crosses one.
        sampled = (order % rate == 0) | (self.transform == 0)
        self.sample_rank = np.concatenate([[0], np.cumsum(sampled)])
        self.sampled, self.samples = sampled, order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase; phrases are right-aligned rows of symbols."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.transform), np.int64)
        live = np.arange(len(phrases))
        for step in range(phrases.shape[1]):
            live = live[(step < lengths[live]) & (low[live] < high[live])]
            if not len(live):
                break
            symbol = phrases[live, -1 - step]
            low[live] = self.starts[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.starts[symbol] + self.wavelet.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in rows."""
        places, rows, walked = np.zeros(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            done = self.sampled[rows[live]]
            ended = live[done]
            places[ended] = self.samples[self.sample_rank[rows[ended]]] + walked[ended]
            live = live[~done]
            symbol = self.wavelet.access(rows[live])
            rows[live] = self.starts[symbol] + self.wavelet.rank(symbol, rows[live])
            walked[live] += 1
        return places


@dataclass(frozen=True)
class Phrases:
    """A block of benchmark items: their distinct windows as right-aligned rows of word ids, and who has each (None: an item without an id)."""

    vocabulary: dict[bytes, int]
    table: np.ndarray
    lengths: np.ndarray
    owners: list[list[str | None]]


def phrases_of(items: list[tuple[str | None, str]], window: int = WINDOW) -> Phrases:
    vocabulary: dict[bytes, int] = {}
    names: list[str | None] = []
    rows, owner = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)]
    for item, text in items:
        ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)], np.int32)
        if not len(ids):
            continue
        padded = np.concatenate([np.zeros(max(0, window - len(ids)), np.int32), ids])
        rows.append(np.lib.stride_tricks.sliding_window_view(padded, window))
        owner.append(np.full(len(rows[-1]), len(names)))
        names.append(item)
    table, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
    owners: list[set[str | None]] = [set() for _ in table]
    for row, of in zip(which.ravel().tolist(), np.concatenate(owner).tolist(), strict=True):
        owners[row].add(names[of])
    return Phrases(vocabulary, table, (table != 0).sum(1), [sorted(o, key=lambda x: (x is not None, x or "")) for o in owners])


def ids_of(text: str | None, vocabulary: dict[bytes, int]) -> np.ndarray:
    """The text's words as ids, 0 for those that the benchmark lacks."""
    words = words_of(text)
    known = vocabulary.get
    return np.fromiter((known(w, 0) for w in words), np.int32, len(words))


def _hits(texts: list[np.ndarray], phrases: Phrases) -> list[tuple[list[tuple[int, int]], list[str], bool]]:
    """For each text (word ids) its merged spans of hit words [from, to), the items that occur in it, and whether one without an id does."""
    spans_of: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: dict[int, set[str | None]] = {}
    result = lambda: [(spans, sorted(x for x in items.get(i, ()) if x is not None), None in items.get(i, ())) for i, spans in enumerate(spans_of)]
    if not len(phrases.lengths):
        return result()
    shortest = int(phrases.lengths.min())
    pieces, owner, offset = [], [], []
    for number, ids in enumerate(texts):
        if len(ids) < shortest:
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], ids != 0, [0]])))
        begin, end = edges[::2], edges[1::2]
        for a, b in zip(begin[end - begin >= shortest].tolist(), end[end - begin >= shortest].tolist(), strict=True):
            pieces += [ids[a:b], np.zeros(1, np.int32)]
            owner.append(number)
            offset.append(a)
    if not pieces:
        return result()
    sequence = np.concatenate(pieces).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in pieces[::2]])])
    index = FMIndex(sequence, len(phrases.vocabulary))
    low, high = index.search(phrases.table, phrases.lengths)
    found = np.flatnonzero(high > low)
    counts = (high - low)[found]
    which = np.repeat(found, counts)
    rows = np.repeat(low[found] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(len(which))
    places = index.locate(rows)
    run = np.searchsorted(starts, places, "right") - 1
    text_of, word_of = np.array(owner)[run], places - starts[run] + np.array(offset)[run]
    order = np.lexsort((word_of, text_of))
    for t, w in np.unique(np.stack([text_of, which]), axis=1).T.tolist():
        items.setdefault(t, set()).update(phrases.owners[w])
    for t, a, size in zip(text_of[order].tolist(), word_of[order].tolist(), phrases.lengths[which[order]].tolist(), strict=True):
        spans = spans_of[t]
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], a + size))
        else:
            spans.append((a, a + size))
    return result()


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def excise(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters from each span's first word to its last."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join(out) + text[at:]


def _blocks(benchmark: DataFrame, key: str, text: str, block_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    """Items in blocks, read one after the other."""
    block, size = [], 0
    for row in benchmark.where(F.col(text).isNotNull()).select(F.col(key).cast("string"), F.col(text), F.octet_length(text)).toLocalIterator():
        if block and size + row[2] > block_bytes:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += row[2]
    if block:
        yield block


def _stored_phrases(spark: SparkSession, blocks: Iterator[list[tuple[str | None, str]]], window: int) -> list[str]:
    """The phrases of each block as a file in the shared folder; the files' names."""
    folder = f"{shared_folder(spark)}/phrases-{uuid.uuid4().hex}"
    delete_at_end(spark, folder)
    names = []
    for number, block in enumerate(blocks):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{number}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(pickle.dumps(phrases_of(block, window))))
        out.close()
        names.append(f"{folder}/{number}")
    return names


def _read_phrases(name: str) -> Phrases:
    filesystem, path = fs.FileSystem.from_uri(name if ":" in name else f"file://{name}")
    with filesystem.open_input_file(path) as file:
        return pickle.loads(file.read())  # written by this job's driver


def _all_hits(texts: pa.ChunkedArray, phrases: Iterator[Phrases]) -> tuple[list[int], list[tuple[list[tuple[int, int]], list[str], bool]]]:
    """Word counts of a shard's texts, and _hits of all blocks of phrases together."""
    counts: list[int] | None = None
    found: list[tuple[list[tuple[int, int]], list[str], bool]] = [([], [], False)] * len(texts)
    for block in phrases:
        ids = [ids_of(t.as_py(), block.vocabulary) for t in texts]
        counts = [len(i) for i in ids] if counts is None else counts
        own = _hits(ids, block)
        found = [a if not b[0] else b if not a[0] else (merge_spans(a[0] + b[0]), sorted({*a[1], *b[1]}), a[2] or b[2]) for a, b in zip(found, own, strict=True)]
    return [len(words_of(t.as_py())) for t in texts] if counts is None else counts, found


def _shards(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[list[pa.RecordBatch]]:
    """Runs of batches of SHARD_BYTES of text; a batch that is larger is cut."""
    shard, size = [], 0
    for batch in batches:
        rows = max(1, batch.num_rows * SHARD_BYTES // max(SHARD_BYTES, batch.column(text).nbytes))
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            shard.append(part)
            size += part.column(text).nbytes
            if size >= SHARD_BYTES:
                yield shard
                shard, size = [], 0
    if shard:
        yield shard


_MADE = [("n_words", T.LongType()), ("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), ("hit_items", T.ArrayType(T.StringType())), ("_nameless", T.BooleanType())]


def find(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """df (or its columns keep) with n_words, hit_spans (merged word spans [start, end)), hit_items (ids as strings,
    sorted), n_hit (hit words), n_items, contaminated (n_hit > 0 and 20 * n_hit >= n_words).

    Null and empty texts have no words and aren't contaminated. Items without words have no phrase; those without an id are searched as well,
    count as one item in n_items, and aren't in hit_items; repeated items count once. A text is indexed whole, however long it
    is. Input columns named like made ones are replaced; repeated rows each give a row."""
    taken = {"n_words", "hit_spans", "hit_items", "n_hit", "n_items", "contaminated", "_nameless"}
    keep = [c for c in (keep or df.columns) if c.lower() not in taken]
    carried = list(dict.fromkeys([*keep, text]))
    schema = T.StructType([df.schema[c] for c in carried] + [T.StructField(name, kind) for name, kind in _MADE])
    arrow_spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    names = _stored_phrases(df.sparkSession, _blocks(benchmark, item, item_text, block_bytes), window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _read_phrases(names[0]) if len(names) == 1 else None
        for shard in _shards(batches, text):
            column = pa.chunked_array([part.column(text) for part in shard])
            counts, hits = _all_hits(column, iter([kept]) if kept else map(_read_phrases, names))
            at = 0
            for part in shard:
                own = hits[at : at + part.num_rows]
                spans = pa.array([[{"start": a, "end": b} for a, b in spans] for spans, _, _ in own], arrow_spans)
                made = [pa.array(counts[at : at + part.num_rows], pa.int64()), spans, pa.array([items for _, items, _ in own], pa.list_(pa.string())), pa.array([n for _, _, n in own], pa.bool_())]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in carried] + made, names=schema.names)
                at += part.num_rows
        free_memory()

    out = texts_in_small_batches(df).select(*carried).mapInArrow(run, schema)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    out = out.select(*keep, "n_words", "hit_spans", "hit_items", n_hit.alias("n_hit"), (F.size("hit_items") + F.col("_nameless").cast("int")).cast("long").alias("n_items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def remove(df: DataFrame, benchmark: DataFrame, text: str = "text", whole: bool = True, **options) -> DataFrame:
    """df without its contaminated rows (whole), or with all hit spans cut out of the texts of those rows. Columns named like those
    that find makes pass through."""
    inner, restored = set_aside(df, *(name for name, _ in _MADE), "n_hit", "n_items", "contaminated")
    found = find(inner, benchmark, text=text, **options)
    if whole:
        return restored(found.where(~F.col("contaminated")))

    @F.pandas_udf("string")
    def cut(texts, spans, bad):
        return texts.combine(spans, lambda t, s: (t, s)).combine(bad, lambda ts, b: excise(ts[0], [(x["start"], x["end"]) for x in ts[1]]) if b else ts[0])

    return restored(found.withColumn(text, cut(text, "hit_spans", "contaminated")))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode("utf-8")).hexdigest()
