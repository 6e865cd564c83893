"""The Merkle manifest against a tree built by hand, and against SQL."""

import random
import zlib
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from corvane.llm import merkle, queries


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def by_hand(leaves, fan=16):
    """{(group, place): (leaf, proof, subroot, root)} of [(group, order, leaf)]."""

    def tree(nodes):
        paths, level, width = [[] for _ in nodes], list(nodes), 1
        while len(level) > 1:
            for i, p in enumerate(paths):
                run = i // width // fan
                p += [level[k] for k in range(run * fan, min(len(level), run * fan + fan)) if k != i // width]
            level, width = [H(*level[k : k + fan]) for k in range(0, len(level), fan)], width * fan
        return level[0], paths

    groups = {}
    for g, order, leaf in leaves:
        groups.setdefault(g, []).append(((order is not None, order or 0), leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x for _, x in sorted(groups[g])]) for g in names}
    root, above = tree([trees[g][0] for g in names])
    return root, {g: (trees[g][0], [(x, p + up) for (_, x), p in zip(sorted(groups[g]), trees[g][1])]) for g, up in zip(names, above)}


def rows(n, groups, seed=1):
    rng = random.Random(seed)
    names = [None, "", "é", "z", *(f"g{i}" for i in range(groups))]
    return [(rng.choice(names) if rng.random() < 0.6 else "hot", i if rng.random() < 0.95 else rng.choice([None, 7]), H(str(i % 97)), i) for i in range(n)]


def compared(spark, data):
    df = spark.createDataFrame(data, "source string, doc_id long, leaf string, path long")
    root, want = by_hand([(g, o, x) for g, o, x, _ in data])
    got = {}
    told = merkle.merkle_manifest(df).withColumn("back", merkle.fold(F.col("leaf"), F.col("path"))).withColumn("other", merkle.fold(F.lit("x"), F.col("path"))).withColumn("sib", merkle.siblings(F.col("path")))
    assert told.columns[:6] == ["source", "doc_id", "leaf", "subroot", "root", "path"]
    for r in told.collect():
        assert r.root == r.back == root and r.other != root
        got.setdefault(r.source, []).append((r.leaf, list(r.sib), r.subroot))
    assert set(got) == set(want)
    for g, (sub, proofs) in want.items():
        assert {s for _, _, s in got[g]} == {sub}
        assert sorted((x, p) for x, p, _ in got[g]) == sorted(proofs)


def test_small_blocks(spark, monkeypatch):
    """Blocks of one level and a driver that may hold 2 nodes: all rounds of both trees are distributed."""
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 1)
    monkeypatch.setattr(merkle, "TOP", 2)
    compared(spark, rows(700, 30))


def test_two_levels(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 2)
    monkeypatch.setattr(merkle, "TOP", 20)
    compared(spark, rows(2000, 40))


def test_whole_blocks(spark):
    compared(spark, rows(9000, 5))
    compared(spark, [("a", 1, H("x"), 0)])
    compared(spark, [("a", i, H("same"), 0) for i in range(17)] + [("b", 1, H("y"), 0)] * 16)


def test_leaf_and_empty(spark):
    df = spark.createDataFrame([(1, "é", None), (None, "", "x")], "a long, b string, c string")
    got = [r.h for r in df.select(merkle.leaf_hash(F.col("a"), F.col("b"), F.col("c")).alias("h")).collect()]
    assert got == [H("1:1", "2:é", "-"), H("-", "0:", "1:x")]
    empty = merkle.merkle_manifest(spark.createDataFrame([], "source string, doc_id long, leaf string"))
    assert empty.count() == 0 and empty.columns == ["source", "doc_id", "leaf", "subroot", "root", "path"]


@pytest.fixture(scope="module")
def told(spark):
    return {r.doc_id: r for r in queries.op12_merkle(spark, "/root/testdata/sf0.01").collect()}


def test_query_op12(spark, told):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    shown = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    root, want = by_hand([(d.source, d.doc_id, H(*map(shown, (d.doc_id, d.source, d.lang, d.n_chars, d.text)))) for d in docs])
    proofs = {leaf: (sub, H(*p)) for sub, own in want.values() for leaf, p in own}
    tampered = 0
    for d in docs:
        r = told[d.doc_id]
        assert r.root == root and (r.subroot, r.proof_sha256) == proofs[r.leaf]
        changed = zlib.crc32(str(d.doc_id).encode()) % 5 == 0 and d.text is not None and any("A" <= c <= "Z" for c in d.text)
        assert r.verified == (not changed) == (r.folded_root == root)
        tampered += changed
    assert tampered > 50 and len(told) == len(docs)


def test_oracle(told):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    rel = con.sql(queries.ORACLES["op12_merkle"])
    names = rel.columns
    assert len(rows := rel.fetchall()) == len(told)
    for row in rows:
        r = dict(zip(names, row))
        assert r == told[r["doc_id"]].asDict()
