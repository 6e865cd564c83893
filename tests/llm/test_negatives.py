"""Hard negatives against brute force and SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import negatives as n
from corvane.llm import queries

NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows, anchor, positives=5, keep=5, low=80, scale=256):
    """rows: (id, label, vector); every anchor against every row."""
    rows = [(i, lab, [int(np.floor(scale * float(c))) for c in v]) for i, lab, v in rows]
    out = []
    for i, lab, q in {(i, lab, tuple(v)) for i, lab, v in rows if anchor(i)}:
        score = sorted((-sum(a * b for a, b in zip(q, v)), j, other) for j, other, v in rows if j != i)
        for s, p, _ in [x for x in score if x[2] == lab][:positives]:
            window = [x for x in score if x[2] != lab and low * -s <= 100 * -x[0] <= 100 * -s]
            out += [(i, p, k + 1, x[1], -s, -x[0]) for k, x in enumerate(window[:keep])]
    return sorted(out)


def mined(spark, rows, modulus=10, **more):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("anchor_id", F.lit("clash"))
    got = n.mine_negatives(df, F.col("vec_id") % modulus == 0, **more)
    assert tuple(got.columns) == NAMES
    return sorted(tuple(r) for r in got.collect())


def vectors(kind, count, dims, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(count, dims))
    if kind == "clustered":
        x = x * 0.2 + rng.normal(size=(7, dims))[rng.integers(0, 7, count)]
    if kind == "positive":
        x = np.abs(x)
    if kind == "coarse":
        x = np.round(x)  # many ties
    if kind == "large":
        x = x * 3000
    return (x / 4).astype(np.float32)


@pytest.mark.parametrize("kind", ["normal", "clustered", "positive", "coarse", "large"])
def test_brute_force(spark, kind):
    rng = np.random.default_rng(4)
    x = vectors(kind, 900, 12)
    rows = [(i, int(lab), v.tolist()) for i, lab, v in zip(range(900), rng.integers(0, 4, 900), x)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_small_blocks_and_chunks(spark, monkeypatch):
    """Blocks, strips and passes of a few rows each change nothing, and bounds hold in every cell."""
    monkeypatch.setattr(n, "BLOCK", 64)
    monkeypatch.setattr(n, "STRIP", 5)
    monkeypatch.setattr(n, "CHUNK", 30)
    x = vectors("clustered", 700, 9)
    rows = [(i, i * 7 % 3, v.tolist()) for i, v in enumerate(x)]
    assert mined(spark, rows, positives=3, negatives=2) == brute(rows, lambda i: i % 10 == 0, 3, 2)


def test_bounds():
    rng = np.random.default_rng(9)
    for kind in ("normal", "coarse", "large"):
        x = np.floor(256 * vectors(kind, 400, 8)).astype(np.int64)
        cells = n.Cells.of(x[:50], x.min(axis=0), x.max(axis=0))
        q = x[rng.integers(0, 400, 20)]
        lower, upper = cells.tables(q)
        codes = cells.codes(x)
        exact, low, high = x @ q.T, n._sum(lower, codes), n._sum(upper, codes)
        assert (low <= exact).all() and (exact <= high).all()
        row, anchor = np.nonzero(exact == exact)
        assert (n._sum_pairs(lower, codes, row, anchor) == low.ravel()).all()


def test_few_rows_are_scored():
    """On clustered vectors the bounds leave a small share of the rows to score."""
    x = np.floor(256 * vectors("clustered", 20_000, 32)).astype(np.int32)
    rows = n.Rows(np.arange(20_000), np.zeros(20_000, np.int64), x)
    cells = n.Cells.of(x[:2000].astype(np.int64), x.min(axis=0).astype(np.int64), x.max(axis=0).astype(np.int64))
    asked = n.Rows(np.arange(20), np.zeros(20, np.int64), x[:20])
    bound = n._sum(cells.tables(asked.x.astype(np.int64))[1], cells.codes(x))
    exact = x.astype(np.int64) @ asked.x.astype(np.int64).T
    fifth = np.sort(exact, axis=0)[-6]
    assert (bound >= fifth).mean() < 0.05


def test_rows_that_take_no_part(spark):
    base = [(i, i % 2, [1.0 + i / 50, 1.0 - i / 70]) for i in range(40)]
    odd = [(40, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]), (41, 1, None), (42, 1, [1.0, None]), (43, 1, [float("nan"), 1.0]), (44, 1, [float("inf"), 1.0]), (45, 1, []), (46, 1, [1.0]), (47, 1, [1.0, 1.0, 1.0])]
    twice = [base[0], base[10], base[10], (3, 0, base[3][2]), (20, 0, [0.0, 0.0])]
    rows = base + odd + twice
    kept = base + twice
    assert mined(spark, rows) == brute(kept, lambda i: i % 10 == 0)
    for few in ([], odd, [(1, 1, [1.0])], [(0, 1, [1.0])]):
        assert mined(spark, few) == brute([r for r in few if r not in odd], lambda i: i % 10 == 0)
    with pytest.raises(Exception, match="too large"):
        mined(spark, [(0, 1, [1e9])])


@pytest.fixture(scope="module")
def told(spark):
    return sorted(tuple(r) for r in queries.op11_negatives(spark, "/root/testdata/sf0.01").collect())


def test_query_op11(spark, told):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    assert told and told == brute(rows, lambda i: i % 100 == 0)


def test_oracle(told):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    rel = con.sql(queries.ORACLES["op11_negatives"])
    assert set(rel.columns) == set(NAMES)
    assert sorted(rel.select(", ".join(NAMES)).fetchall()) == told
