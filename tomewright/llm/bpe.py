"""Byte-level BPE: encode whole texts into vocabulary ids and decode ids back into bytes.

Texts are split by the vocabulary's pattern. The distinct words of a group of texts that aren't in the memo (of bounded
size) are folded together: their bytes are the first parts, and in each round every word merges the adjacent pair whose
concatenation has the lowest rank, the leftmost of equal ones, until none of its pairs has a rank. The rank map is a
literal of fixed size (the vocabulary file), sent to the workers as one broadcast. Decoding concatenates the pieces of the ids.

No row moves between tasks: the operator is one pass over the scan, whatever the key distribution.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import free_memory, texts_in_small_batches

#: Entries that a worker's memo may hold before it starts afresh; longer words aren't kept.
MEMO_WORDS = 150_000
MEMO_WORD_CHARS = 64
#: Words of a group of texts whose unknown words are folded together.
GROUP_WORDS = 200_000
#: Words with more bytes are merged by a heap, each on its own.
SCAN_PARTS = 48
NEVER = 1 << 30


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """The rank file's lines: base64 of the piece, a space, its rank."""
    ranks = {}
    for line in raw.splitlines():
        if line.strip():
            piece, rank = line.split()
            ranks[base64.b64decode(piece)] = int(rank)
    return ranks


def _checked(path: str) -> bytes:
    """The vocabulary file, which must have all single bytes (ValueError)."""
    with open(path, "rb") as file:
        raw = file.read()
    ranks = read_ranks(raw)
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"{path} lacks single bytes")
    return raw


def fold_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: fold the ranked merges over its bytes."""
    if not word:
        return []
    if word in ranks:
        return [ranks[word]]
    if len(word) > SCAN_PARTS:
        return _fold_by_heap(word, ranks)
    rank_of = ranks.get
    parts = [word[i : i + 1] for i in range(len(word))]
    pair_ranks = [rank_of(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
    while pair_ranks and (lowest := min(pair_ranks)) != NEVER:
        at = pair_ranks.index(lowest)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pair_ranks[at]
        if at < len(pair_ranks):
            pair_ranks[at] = rank_of(parts[at] + parts[at + 1], NEVER)
        if at:
            pair_ranks[at - 1] = rank_of(parts[at - 1] + parts[at], NEVER)
    return [ranks[p] for p in parts]


def _fold_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold in n log n steps: parts are spans in a linked list, stale heap entries are skipped."""
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i], after[i] = end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
            offer(i)
        if before[i] >= 0:
            offer(before[i])
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : end[i]]])
        i = after[i]
    return ids


class PairRanks:
    """The rank of two adjacent parts' concatenation, for arrays of parts named by their own ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        found = []
        for piece, rank in ranks.items():
            for i in range(1, len(piece)):
                left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
                if left is not None and right is not None:
                    found.append(((left << 32) | right, rank))
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        self.keys, self.values = np.append(pairs[:, 0], np.iinfo(np.int64).max), np.append(pairs[:, 1], NEVER)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = (left << 32) | right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.values[at], NEVER)


def fold_together(words: list[bytes], pairs: PairRanks) -> list[bytes]:
    """For each of many words (none empty, none over SCAN_PARTS) its ids as packed integers. A round merges one pair of every word that still
    has one; words that are done leave."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    name = np.arange(len(words))  # of the words still in the arrays below
    parts = pairs.bytes[np.frombuffer(b"".join(words), np.uint8)]
    rank = np.full(len(parts), NEVER, np.int64)  # of each part with the next one of its word
    inner = np.ones(len(parts), bool)
    inner[np.cumsum(size) - 1] = False
    at = np.flatnonzero(inner)
    rank[at] = pairs.of(parts[at], parts[at + 1])
    out: list[bytes] = [b""] * len(words)
    while len(name):
        ends = np.cumsum(size)
        lowest = np.minimum.reduceat(rank, ends - size)
        done = lowest == NEVER
        if done.any():
            gone = np.repeat(done, size)
            packed, stops = parts[gone].astype("<u4").tobytes(), (np.cumsum(size[done]) * 4).tolist()
            for word, start, stop in zip(name[done].tolist(), [0, *stops], stops, strict=False):
                out[word] = packed[start:stop]
            parts, rank, size, name, lowest = parts[~gone], rank[~gone], size[~done], name[~done], lowest[~done]
            if not len(name):
                break
            ends = np.cumsum(size)
        word = np.repeat(np.arange(len(name)), size)
        hit = np.flatnonzero(rank == lowest[word])
        owner = word[hit]
        first = np.ones(len(hit), bool)
        first[1:] = owner[1:] != owner[:-1]
        at = hit[first]  # one a word, in the words' order
        parts[at] = lowest
        stays = np.ones(len(parts), bool)
        stays[at + 1] = False
        parts, rank = parts[stays], rank[stays]
        at -= np.arange(len(at))
        size -= 1
        ends = np.cumsum(size)
        rank[at] = NEVER
        follows = at[at + 1 < ends]
        rank[follows] = pairs.of(parts[follows], parts[follows + 1])
        preceded = at[at > ends - size]
        rank[preceded - 1] = pairs.of(parts[preceded - 1], parts[preceded])
    return out


class Codec:
    """Encoder and decoder of one vocabulary, with the memo of one worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.pieces: dict[int, bytes] = {rank: piece for piece, rank in ranks.items()}
        self.memo: dict[str, bytes] = {}
        self.pairs = PairRanks(ranks)

    def packed(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        group, count = [], 0
        for text in texts:
            group.append(self.split(text))
            count += len(group[-1])
            if count >= GROUP_WORDS:
                yield from self._packed(group)
                group, count = [], 0
        yield from self._packed(group)

    def _packed(self, group: list[list[str]]) -> list[bytes]:
        memo, every = self.memo, set(chain.from_iterable(group))
        lacking = every - memo.keys()
        if len(memo) + len(lacking) > MEMO_WORDS:
            memo.clear()
            lacking = every
        own: dict[str, bytes] = {}
        open_words, raw_words = [], []
        for word in lacking:
            raw = word.encode("utf-8")
            kept = memo if len(word) <= MEMO_WORD_CHARS else own
            if raw in self.ranks or len(raw) > SCAN_PARTS:
                ids = fold_merges(raw, self.ranks)
                kept[word] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                open_words.append(word)
                raw_words.append(raw)
        memo.update(zip(open_words, fold_together(raw_words, self.pairs), strict=True))
        find = {**memo, **own}.__getitem__ if own else memo.__getitem__
        return [b"".join(map(find, words)) for words in group]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(next(self.packed([text])), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> bytes | None:
        """None if one of the ids has no piece."""
        try:
            return b"".join(map(self.pieces.__getitem__, ids))
        except KeyError:
            return None


_codecs: dict[int, Codec] = {}


def _codec(vocabulary, pattern: str) -> Codec:
    """One codec a worker and vocabulary: tasks that share a Python worker share its memo."""
    raw = vocabulary.value
    key = hash((raw, pattern))
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(read_ranks(raw), pattern)
    return _codecs[key]


def _map_texts(df: DataFrame, text: str, keep: list[str], vocabulary_path: str, pattern: str, made: list[tuple[str, pa.DataType, T.DataType]], row) -> DataFrame:
    """A pass that adds the columns made = row(codec, packed ids of the text)."""
    vocabulary = df.sparkSession.sparkContext.broadcast(_checked(vocabulary_path))
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(name, kind) for name, _, kind in made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary, pattern)
        for batch in batches:
            rows = [row(codec, packed) for packed in codec.packed(value.as_py() or "" for value in batch.column(text))]
            columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind, _) in enumerate(made)]
            del rows
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + columns, names=[*keep, *(name for name, _, _ in made)])
            del columns
        free_memory()

    return texts_in_small_batches(df).select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def encode(df: DataFrame, vocabulary_path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """df with one more column: the ids of the whole text (array of int). A null text counts as empty and gives [];
    an input column named like ids is replaced; other columns, repeated rows and empty tables pass through as they are. A text is split
    whole, however long it is; a long word is folded by a heap. The vocabulary must have all single bytes (ValueError)."""
    keep = [c for c in df.columns if c.lower() != ids.lower()]
    return _map_texts(df, text, keep, vocabulary_path, pattern, [(ids, pa.list_(pa.int32()), T.ArrayType(T.IntegerType()))], lambda codec, packed: (np.frombuffer(packed, "<u4").astype(np.int32),))


def decode(df: DataFrame, vocabulary_path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df with one more column: the bytes of the ids' pieces, concatenated. Null ids give empty bytes; an id that the vocabulary
    doesn't have, or a null among the ids, makes the result null. An input column named like out is replaced."""
    vocabulary = df.sparkSession.sparkContext.broadcast(_checked(vocabulary_path))
    keep = [c for c in df.columns if c.lower() != out.lower()]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary, "")
        for batch in batches:
            made = pa.array([codec.decode(v.as_py() or ()) for v in batch.column(ids)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [made], names=[*keep, out])

    return df.select(*dict.fromkeys([*keep, ids])).mapInArrow(run, schema)


def round_trip(df: DataFrame, vocabulary_path: str, pattern: str, key: str = "doc_id", text: str = "text", ids: str | None = None) -> DataFrame:
    """Digest of encode followed by decode, in one pass and without carrying the ids between processes:
    key, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256, and the ids if a name is given.
    A null text counts as empty: no tokens, the digests of nothing. Repeated rows and keys each give a row."""

    def row(codec: Codec, packed: bytes) -> tuple:
        numbers = np.frombuffer(packed, "<u4")
        back = codec.decode(numbers.tolist())
        digest = (len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(back).hexdigest())
        return (*digest, numbers.astype(np.int32)) if ids else digest

    made = [("n_tokens", pa.int64(), T.LongType()), ("ids_sha256", pa.string(), T.StringType()), ("decoded_sha256", pa.string(), T.StringType())]
    if ids:
        made.append((ids, pa.list_(pa.int32()), T.ArrayType(T.IntegerType())))
    return _map_texts(df, text, [key], vocabulary_path, pattern, made, row)
