"""SentencePiece encoding and decoding against the sentencepiece library."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from corvane.llm import queries
from corvane.llm.pieces import Pieces, piece_decode, piece_encode

PATH = public_tokenizers.path("piece_bpe_32k.model")
EDGE = ["", " ", "  ", "▁", "▁▁a", "a▁ b", "<s>", "</s> <unk>", "<0x41>", "a\x00b", "\n\n", "日本 語", "\U0001f600\U0001f600x", "é é", " x", "　", "I'm  here\t!\r\n", "x" * 300, " " * 300 + "y"]


@pytest.fixture(scope="module")
def own():
    return Pieces(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def rows(own, texts):
    ids, count = own.encode(texts)
    ends = np.cumsum(count)
    return [ids[e - n : e].tolist() for e, n in zip(ends, count)]


def test_equals_the_library(own, library):
    rng = random.Random(5)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "▁", "日", "é", "\U0001f600", "か", "<s>", "0", "...", "\x00", "", "ß", "tion"]
    texts = EDGE + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice("abcdeéàinrst"[: rng.randrange(2, 13)]) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    texts += ["".join(library.id_to_piece(rng.randrange(259, 32000)) for _ in range(rng.randrange(1, 8))) for _ in range(3000)]
    want = library.encode(texts, add_bos=True, add_eos=True)
    got = rows(own, texts)
    assert [x for x, a, b in zip(texts, got, want) if a != b] == []
    flat, count = np.array([i for r in got for i in r]), np.array([len(r) for r in got])
    assert own.decode(flat, count) == [library.decode(r) for r in want]


def test_decodes_any_ids(own, library):
    rng = random.Random(6)
    runs = [[rng.choice([0, *range(3, 259), rng.randrange(259, 32000), 29871, 259]) for _ in range(rng.randrange(0, 6))] for _ in range(3000)]
    runs += [[1, *r, 2] for r in runs[:500]]
    assert own.decode(np.array([i for r in runs for i in r]), np.array([len(r) for r in runs])) == [library.decode(r) for r in runs]


def test_neighbours_that_do_not_fit(own):
    """Longest matches are not what merging gives, and the walk goes back where it must."""
    rng, differ = random.Random(7), 0
    for _ in range(500):
        word = "▁" + "".join(rng.choice("aeinrst") for _ in range(12))
        merged = own.merge(word)
        assert [own.text[i] for i in np.frombuffer(own.encode_words([word])[0], np.uint32)] == merged
        at, longest = 0, []
        while at < len(word):
            longest.append(own.text[own.longest(word, at)])
            at += len(longest[-1])
        differ += longest != merged
    assert differ > 50


def test_long_words_take_time_in_proportion(own, library):
    rng = random.Random(8)
    for word in ("ab" * 100_000, "".join(rng.choice("abcde") for _ in range(200_000)), " " * 200_000, "日本語" * 60_000):
        began = time.perf_counter()
        got = own.encode([word])[0]
        assert time.perf_counter() - began < 10
        assert got.tolist() == library.encode(word, add_bos=True, add_eos=True)


def test_segments_and_full_tables(own, library, monkeypatch):
    """Neither cutting a long text nor starting the tables anew changes a result."""
    from corvane.llm import pieces as module

    monkeypatch.setattr(module, "SEGMENT", 50)
    monkeypatch.setattr(module, "CACHE_WORDS", 3)
    monkeypatch.setattr(module, "CACHE_PAIRS", 3)
    texts = [("word  and another, \n" * 40), "", "a" * 200, None, "x y " * 60]
    assert rows(Pieces(PATH), texts) == library.encode([t or "" for t in texts], add_bos=True, add_eos=True)


def test_columns(spark, library):
    df = spark.createDataFrame([(1, None, 2), (1, "a b", 3), (None, "", 4)], "id long, text string, ids int")
    got = piece_decode(piece_encode(df, PATH, packed_col="text"), PATH, text_col="id").collect()
    ids = library.encode("a b", add_bos=True, add_eos=True)
    assert [(r.ids, r.id) for r in got] == [([1, 2], ""), (ids, "a b"), ([1, 2], "")]
    assert bytes(got[1].text) == np.array(ids, "<u4").tobytes()
    assert piece_encode(df.limit(0), PATH).count() == 0
    assert piece_encode(df, PATH, keep=[]).columns == ["ids"]


def test_query_op13(spark, sf_dir, library):
    got = {r.doc_id: r for r in queries.op13_sentencepiece(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids, r = library.encode(d.text or "", add_bos=True, add_eos=True), got[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
