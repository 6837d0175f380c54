"""Chunk-wise encoding against the library, on given documents and on random awkward texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textpulse.llm import chunk_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def awkward(n, seed=0):
    r = random.Random(seed)
    signs = ["é", "é", "́", "Σ", "ς", "İ", "日本", "𝄞", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "\t", "\n", "\r\n", " ", "  ", "'s", "'LL", "!?", "3", "½", "<|endoftext|>", "<|startoftext|>", "<|endof", "ﬁ", "ﷺ", "\x00", "가", "ᄀ", "ᅡ"]
    plain = ["the", "Of", "training", "A", "running,", "it's", "x" * 70, "unter-", "(word)", "." * 9]
    out = []
    for _ in range(n):
        gap = r.choice([" ", "", " ", "\n"])
        out.append(gap.join(r.choice(signs if r.random() < 0.4 else plain) for _ in range(r.randrange(0, 400))))
    return out


def ids_of(raw):
    return np.frombuffer(raw, dtype="<u4").tolist()


@pytest.mark.parametrize("mean", [1, 4, 64, 512])
def test_equals_the_library(library, monkeypatch, mean):
    monkeypatch.setattr(chunk_bpe, "MEAN", mean)
    monkeypatch.setattr(chunk_bpe, "LEAST", min(mean, 64))
    texts = awkward(60, mean) + ["", " ", "a", "abc" * 900, "\n\n", "word " * 300, "日本語" * 700]
    encoder = chunk_bpe.ChunkEncoder(PATH)
    for _ in range(2):  # the second time from what is remembered
        assert [ids_of(x) for x in encoder.ids(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.repaired > 0 and encoder.whole == 0


def test_forced_cuts_and_long_words(library, monkeypatch):
    monkeypatch.setattr(chunk_bpe, "MOST", 50)
    texts = ["é" * 1000 + " end", "a" * 3000, ("b" * 49 + " ") * 40, "日" * 120]
    encoder = chunk_bpe.ChunkEncoder(PATH)
    assert [ids_of(x) for x in encoder.ids(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    for t in texts:
        raw = t.encode()
        ends = chunk_bpe.cuts(np.frombuffer(raw, dtype=np.uint8))
        pieces = [raw[a:b] for a, b in zip([0, *ends], ends)]
        assert b"".join(pieces) == raw and max(map(len, pieces)) <= 50 and all(p.decode() for p in pieces)


def test_shared_passages_are_encoded_once():
    words = [f"word{i * i % 99991}" for i in range(4000)]
    passage = " ".join(words)
    encoder = chunk_bpe.ChunkEncoder(PATH)
    encoder.ids([passage])
    before = encoder.chunks.made
    encoder.ids([f"Another beginning {i} of it, and then {passage} until the end {i}." for i in range(10)])
    assert encoder.chunks.made - before <= 10 * 4 < before  # those at the two ends


def test_a_join_that_does_not_agree_takes_the_whole_text(library, monkeypatch):
    monkeypatch.setattr(chunk_bpe.Join, "agreed", lambda self, ids: None)
    text = " ".join(f"Wörter{i}" for i in range(500))
    encoder = chunk_bpe.ChunkEncoder(PATH)
    assert ids_of(encoder.ids([text])[0]) == library.encode(text, add_special_tokens=False).ids and encoder.whole == 1


def test_what_is_remembered_is_bounded(library, monkeypatch):
    monkeypatch.setattr(chunk_bpe, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(chunk_bpe, "WORD_BYTES", 5_000)
    encoder = chunk_bpe.ChunkEncoder(PATH)
    texts = awkward(40, 9)
    for t in texts:
        assert ids_of(encoder.ids([t])[0]) == library.encode(t, add_special_tokens=False).ids
    assert len(encoder.words.now) + len(encoder.words.old) < 400
    encoder.forget()
    assert not encoder.words.now and not encoder.chunks.now


def test_columns_and_edges(spark, library):
    texts = [None, "", "The  same text", "The  same text", " \t\n", "<|endoftext|> x", *awkward(20, 4)]
    rows = [(i if i != 3 else 2, t, "kept", [9], "old") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, word string, ids array<int>, decoded string").repartition(3)
    out = chunk_bpe.with_text(chunk_bpe.with_ids(docs, PATH), PATH)
    assert out.columns == ["doc_id", "text", "word", "ids", "decoded"]
    for r in out.collect():
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == library.decode(want, skip_special_tokens=False) and r["word"] == "kept"
    none = chunk_bpe.with_text(chunk_bpe.with_ids(docs.limit(0), PATH), PATH)
    assert none.count() == 0 and chunk_bpe.digests(none, PATH).count() == 0
    odd = spark.createDataFrame([(1, [2, 10**6, -4, 3]), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in chunk_bpe.with_text(odd, PATH).collect()}
    assert got == {1: library.decode([2, 3], skip_special_tokens=False), 2: "", 3: ""}


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[r["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    got = chunk_bpe.op12_chunk_encoding(spark, folder).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    assert [f.dataType.simpleString() for f in chunk_bpe.op12_chunk_encoding(spark, folder).schema] == ["bigint", "bigint", "string", "string"]
