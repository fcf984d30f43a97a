import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from tomewright.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(open(PATH, "rb").read())
CODEC = bpe.Codec(RANKS, public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = ["", " ", "a", "Hello, world's  end\n\n x", "<|endoftext|> as text", "naïve Straße 漢字 🙂👍🏽", "\t\tx y z", "ab" * 4000, "é" * 700, "1234567890" * 50, "don't DON'T", "a\x00b\x1f", "漢字仮名交じり文の長い単語" * 6, "=" * 250, "aaa" * 60]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_the_librarys(text):
    ids = CODEC.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


def test_heap_and_scan_agree():
    draw = random.Random(5)
    for _ in range(300):
        word = bytes(draw.choice(b"thena \xc3\xa9io") for _ in range(draw.randint(2, 60)))
        assert bpe._fold_by_heap(word, RANKS) == LIBRARY._encode_single_piece(word) == bpe.fold_merges(word, RANKS)


def test_memo_starts_afresh(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 2)
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    for text in TEXTS * 2:
        assert codec.encode(text) == LIBRARY.encode_ordinary(text)


def test_frames(spark):
    draw = random.Random(6)
    words = [" ".join("".join(draw.choice(["th", "e", "n", "é", "ß", "X", "ing", "9", "-"]) for _ in range(draw.randint(1, 12))) for _ in range(draw.randint(1, 40))) for _ in range(60)]
    rows = [(i, t, "x") for i, t in enumerate(TEXTS + words)] + [(999, None, None), (999, None, None), (None, "a b", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids string").repartition(3)
    encoded = bpe.encode(df, PATH, public_tokenizers.PATTERN)
    assert encoded.columns == ["doc_id", "text", "token_ids"]
    got = bpe.decode(encoded, PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["token_ids"] == LIBRARY.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_digests(spark):
    rows = [*enumerate(TEXTS), (99, None), (99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(df, PATH, public_tokenizers.PATTERN).collect()}
    for key, text in rows:
        ids = LIBRARY.encode_ordinary(text or "")
        assert got[key] == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert bpe.round_trip(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_ids_without_piece(spark):
    df = spark.createDataFrame([(1, [0, 1]), (2, [60_000]), (3, None), (4, [-1]), (5, [])], "doc_id long, token_ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(df, PATH).collect()}
    pieces = {rank: piece for piece, rank in RANKS.items()}
    assert got == {1: pieces[0] + pieces[1], 2: None, 3: b"", 4: None, 5: b""}


def test_vocabulary_without_bytes(spark, tmp_path):
    (tmp_path / "few").write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError):
        bpe.encode(spark.createDataFrame([("a",)], "text string"), f"{tmp_path}/few", public_tokenizers.PATTERN)


def test_folding_together_is_folding_each():
    """Words of few letters, so that equal ranks and overlaps are many; one byte to the longest."""
    draw = random.Random(6)
    words = [bytes(draw.choice(b"abet \xc3\xa9\xffhin") for _ in range(draw.randint(1, bpe.SCAN_PARTS))) for _ in range(2000)]
    words += [b"a" * n for n in range(1, bpe.SCAN_PARTS + 1)]
    words = [w for w in words if w not in RANKS]
    got = bpe.fold_together(words, CODEC.pairs)
    assert [list(struct.unpack(f"<{len(g) // 4}I", g)) for g in got] == [bpe.fold_merges(w, RANKS) for w in words]
    assert bpe.fold_together([], CODEC.pairs) == []


def test_groups_and_memo_change_nothing(monkeypatch):
    texts = [f"word{i} Zürich{i % 7} {'x' * (i % 90)} !?" for i in range(60)] + ["", "naïve naïve"]
    want = [CODEC.encode(t) for t in texts]
    for words, memo in ((1, 3), (50, 20), (10**6, 10**6)):
        monkeypatch.setattr(bpe, "GROUP_WORDS", words)
        monkeypatch.setattr(bpe, "MEMO_WORDS", memo)
        codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
        assert [list(struct.unpack(f"<{len(p) // 4}I", p)) for p in codec.packed(texts)] == want
