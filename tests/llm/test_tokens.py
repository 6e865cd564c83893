"""BPE against the tokenizers library; packing against bounds and brute force."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm.bpe import Codec, bpe_decode, bpe_encode
from corvane.llm.packing import best_fit, bin_completion, complete, fillings, lower_bound, pack, pack_documents, search, token_pieces
from corvane.llm.queries import op1_bpe, op2_packing, tokenizer_files

TEXTS = ["", None, "<|endoftext|>", "a<|endoftext|> b<|endoft<|endoftext|>", "aaaaaaaaaaaaa" * 50, "   \n\n  x", "don't I'LL we're 12345 ½ ñandú 你好世界 🙂👩‍👩‍👧", " \x85\x1c a b", "x" * 20000, "的" * 3000, " " * 5000 + "a", "'s't're 's", "\r\n\t\x0b", "same", "same"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_files()[0])


def test_codec_equals_library(library):
    rng = np.random.default_rng(1)
    texts = TEXTS + ["".join(map(chr, rng.integers(32, 1000, 200))) for _ in range(100)]
    codec = Codec(tokenizer_files()[0])
    for _ in range(2):  # cold and with stored words
        ids, count = codec.encode(texts)
        at = np.r_[0, np.cumsum(count)]
        for t, a, b in zip(texts, at, at[1:]):
            assert ids[a:b].tolist() == library.encode(t or "", add_special_tokens=False).ids
        assert codec.decode(ids, count) == [t or "" for t in texts]
    assert codec.decode(np.array([128, 50256, 220]), np.array([3, 0])) == [library.decode([128, 50256, 220], skip_special_tokens=False), ""]


def test_encode_frame(spark, library):
    df = spark.createDataFrame([(i, t, "old", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string, decoded int")
    path = tokenizer_files()[0]
    out = bpe_decode(bpe_encode(df, path), path).collect()
    assert len(out) == len(TEXTS)
    for r in out:
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    assert bpe_decode(bpe_encode(df.limit(0), path), path).count() == 0


def test_query_op1(spark, sf_dir, library):
    from hashlib import sha256

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op1_bpe(spark, sf_dir).collect():
        ids = library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == sha256((docs[r.doc_id] or "").encode()).hexdigest()


def fewest(lengths, capacity):
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k, free in enumerate(bins):
            if free >= lengths[i]:
                place(i + 1, bins[:k] + [free - lengths[i]] + bins[k + 1 :])
        place(i + 1, bins + [capacity - lengths[i]])

    place(0, [])
    return best


def test_bins_are_fewest():
    rng = np.random.default_rng(3)
    cases = [rng.integers(1, 21, int(rng.integers(1, 9))) for _ in range(500)] + [np.array([4, 5, 7, 7, 7, 7, 8, 11])]
    for lengths in cases:
        bins, offset = bin_completion(lengths, 20)
        check_bins(lengths, bins, offset, 20)
        best = fewest(sorted(lengths.tolist(), reverse=True), 20)
        assert bins.max() + 1 == best >= lower_bound(lengths, 20)


def test_many_bins():
    rng = np.random.default_rng(3)
    big = rng.integers(1, 2048, 20000)
    bins, offset = bin_completion(big, 2048)
    check_bins(big, bins, offset, 2048)
    assert bins.max() + 1 <= lower_bound(big, 2048) * 1.002
    assert bins.max() + 1 <= len(best_fit(big.tolist(), 2048))
    assert sorted(map(len, best_fit([5, 5, 6], 10))) == [1, 2]


@pytest.mark.parametrize("seed", [0, 1])
def test_exact_triples(seed):
    """200 triples that fill a bin exactly come into 200 bins, beyond what one search covers."""
    rng = np.random.default_rng(seed)
    cuts = [sorted(rng.choice(np.arange(1, 2048), 2, replace=False).tolist()) for _ in range(200)]
    lengths = np.array([n for a, b in cuts for n in (a, b - a, 2048 - b)])
    bins, offset = bin_completion(lengths, 2048)
    check_bins(lengths, bins, offset, 2048)
    assert bins.max() + 1 == lower_bound(lengths, 2048) == 200


def test_fillings_are_undominated():
    """A filling stays unless a length left out could take the place of lengths that are no longer."""
    assert fillings([7, 5, 3], {7: 1, 5: 2, 3: 2}, 13, 13, [10**6]) == [(0, [7, 3, 3]), (0, [5, 5, 3]), (1, [7, 5])]
    assert fillings([6, 4, 3, 2], {6: 1, 4: 1, 3: 1, 2: 1}, 6, 6, [10**6]) == [(0, [6])]  # 4 and 2 could go where 6 is
    rng = np.random.default_rng(5)
    for _ in range(100):  # an optimal packing is never lost, whatever the dominance cuts
        lengths = rng.integers(1, 16, 9).tolist()
        best = fewest(sorted(lengths, reverse=True), 16)
        assert len(search(lengths, 16, best + 1)) == best and search(lengths, 16, best) is None


def test_skewed_ids(spark):
    """One id with all rows, nulls too, is dealt to many groups."""
    df = spark.range(70_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), (F.col("id") % 5 + 1).alias("length"))
    out = pack(df, 20).cache()
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 20 and out.count() == 70_000
    assert out.select((F.col("sequence_id") % 2).alias("g")).distinct().count() == 2


def check_bins(lengths, bins, offset, capacity):
    for b in set(bins.tolist()):
        own = sorted((o, n) for o, n, k in zip(offset.tolist(), lengths.tolist(), bins.tolist()) if k == b)
        at = 0
        for o, n in own:
            assert o == at
            at += n
        assert at <= capacity


def test_complete_finds_exact_filling():
    left = {3: 2, 5: 2, 7: 1}
    assert sum(complete([3, 5, 7], left, 13)) == 13  # best fit takes 7, 5 and wastes 1
    for room in range(1, 24):
        best = max(sum(c) for k in range(6) for c in itertools.combinations([3, 3, 5, 5, 7], k) if sum(c) <= room)
        assert sum(complete([3, 5, 7], dict(left), room)) == best


def test_pack_edges(spark):
    files = tokenizer_files()
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (2, "", 9), (None, "word " * 5000, 9), (3, "x", 9)], "doc_id long, text string, offset int")
    out = pack_documents(df, *files, size=64).toPandas()
    whole = out.groupby("sequence_id").length.sum()
    assert whole.max() <= 64 and len(whole) == -(-out.length.sum() // 64)
    long = out[out.doc_id.isna()].sort_values("piece")
    assert (long.length.iloc[1:] == 64).all() and (long.start == long.length.cumsum() - long.length).all()
    assert pack_documents(df.limit(0), *files).count() == 0
    clash = pack(spark.createDataFrame([(1, 0, 5, "a")], "doc_id long, piece int, length long, sequence_id string"), 8).collect()
    assert clash[0].offset == 0


def test_ids_equal_library(spark, library):
    """The faster library on the ranks of the same vocabulary gives the tokenizers library's ids."""
    rng = np.random.default_rng(9)
    texts = TEXTS + ["".join(map(chr, rng.integers(1, 0xD7FF, 300))) for _ in range(150)] + ["".join(rng.choice(list("ab 1\n\t'é你.<|endoftext|>"), 80)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    crc = {r.doc_id: r.ids_crc32 for r in token_pieces(df, *tokenizer_files(), size=1 << 30).collect()}
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert crc[i] == zlib.crc32(ids.tobytes()), t


def test_query_op2(spark, sf_dir, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = op2_packing(spark, sf_dir).toPandas()
    for d, own in out.groupby("doc_id"):
        ids = np.array([*library.encode(docs[d] or "", add_special_tokens=False).ids, 0], "<u4")
        own = own.sort_values("piece")
        assert own.length.sum() == len(ids) and (own.length.iloc[1:] == 2048).all()
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert (own.offset == own.length.cumsum() - own.length).all() and own.length.sum() <= 2048
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 2048) + 1
