"""Byte-pair encoding by prefixes against the tokenizers library: every id, and every decoded text."""

import hashlib
import random
import struct

import pytest

pytest.importorskip("daywheel.llm")
from daywheel.llm import bpe, catalog

PIECES = ["a", "b", "the", "ing", " ", "'", "s", "'ll", "é", "́", "Σ", "1", "２", "!", "<", "|", ">", "endoftext", "<|endoftext|>", "Å", "ﬁ", "😀", "\n", "\t", "\x1c", "\x85", "İ", "ß", "한", "가", "؟", "ا", "</w>"]
ODD = ["", "   ", "é café   x", "'S 'ts ''ll don't we'VE", "ÀÉ ß ẞ ſ ª º ² ½ Ⅳ ١٢ 한국어 中文字", "ǅ Ǆ ŉ ʰ", "<|startoftext|><|endoftext|>a<|endoftext", "a" * 30_000, "ab" * 3_000 + " x"]


@pytest.fixture(scope="module")
def machine():
    return bpe.encoder()


def ids_of(data):
    return list(struct.unpack(f"<{len(data) // 4}I", data))


def want(machine, texts):
    return [x.ids for x in machine.library.encode_batch(texts, add_special_tokens=False)]


def test_odd_texts(machine):
    rnd = random.Random(4)
    texts = ODD + ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    assert [ids_of(x) for x in machine.encode(texts)] == want(machine, texts)


def test_random_words(machine):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghiopstzé") for _ in range(rnd.randint(1, 30))) for _ in range(8000)]
    assert [ids_of(x) for x in machine.encode(words)] == want(machine, words)


def test_both_ways_of_splitting(machine):
    plain = ["Don't we'LL 'tis ºC x² \xa0 a\x85b µ ß-Ö", "It's 12.5%!"]
    shown = [machine.library.pre_tokenizer.pre_tokenize_str(machine.library.normalizer.normalize_str(t)) for t in plain]
    assert all(machine.simple(t) == [bytes(map(machine._bytes.__getitem__, w)).decode() for w, _ in s] for t, s in zip(plain, shown, strict=True))
    assert machine.simple("α") is None and machine.simple("İ") is None


def test_texts_longer_than_a_piece(machine, monkeypatch):
    rnd = random.Random(6)
    text = "".join(rnd.choice(PIECES) for _ in range(5000))
    monkeypatch.setattr(bpe, "PIECE", 100)
    assert ids_of(machine.encode([text])[0]) == want(machine, [text])[0]
    monkeypatch.setattr(bpe, "CACHE", 3)
    texts = [text[i : i + 50] for i in range(0, 2000, 50)]
    assert [ids_of(x) for x in machine.encode(texts)] == want(machine, texts)


def naive(machine, symbols):
    ids = [machine.symbol[s] for s in symbols]
    while True:
        ranks = [(machine.rank[machine.merged[a << 32 | b]], i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if a << 32 | b in machine.merged]
        if not ranks:
            return ids
        i = min(ranks)[1]
        ids[i : i + 2] = [machine.merged[ids[i] << 32 | ids[i + 1]]]


def test_every_prefix_has_one_last_token(machine):
    """What the method stores, held against merging pairs one after the other."""
    rnd = random.Random(7)
    for _ in range(300):
        word = "".join(rnd.choice("aeinrst") for _ in range(rnd.randint(1, 14)))
        symbols = [*word.encode()]
        symbols[-1] += bpe.END
        assert ids_of(machine.learn([word])[word]) == naive(machine, symbols)
        for i in range(1, len(symbols)):
            ids = naive(machine, symbols[:i])
            assert all(machine._compatible(a, b) for a, b in zip(ids, ids[1:], strict=False))


def test_rows(spark, machine):
    rows = [(1, "It's café 12", 7), (1, "It's café 12", 7), (2, None, 8), (3, "", 9), (None, "x <|endoftext|>", 1), (5, "word " * 40_000, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, BPE_IDS int")
    made = bpe.decode(bpe.encode(docs))
    assert made.columns == ["doc_id", "text", "bpe_ids", "bpe_text"]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.bpe_ids, r.bpe_text) for r in made.collect())
    lists = want(machine, [t or "" for _, t, _ in rows])
    assert got == sorted((i is not None, i or 0, x, machine.library.decode(x, skip_special_tokens=False)) for (i, _, _), x in zip(rows, lists, strict=True))
    assert bpe.decode(bpe.encode(docs.limit(0))).count() == 0


def test_unknown_ids(spark, machine):
    rows = spark.createDataFrame([(1, [320, 10**6, -1, None, 49407]), (2, None), (3, [])], "k int, bpe_ids array<int>")
    got = {r.k: r.bpe_text for r in bpe.decode(rows).collect()}
    assert got == {1: machine.library.decode([320, 49407], skip_special_tokens=False), 2: "", 3: ""}


def test_query(spark, machine):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = catalog.op12_bpe_round_trip(spark, folder).collect()
    assert len(found) == len(texts)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r, ids in zip(found, want(machine, [texts[r.doc_id] for r in found]), strict=True):
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(machine.library.decode(ids, skip_special_tokens=False)))
