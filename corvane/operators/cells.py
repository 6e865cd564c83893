"""Exact search that reads part of the index: cells with a centre and a radius, best bounds first."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corvane.functions.vector import cosine

#: Vectors whose directions place the centres, at most cells, and rounds of placing them.
SAMPLE, MOST_CELLS, ROUNDS = 8192, 1024, 8
#: The cell of vectors without a direction (null, empty, zero, not finite, of another length): their score is 0.
NOWHERE = -1
#: Room for rounding in a bound.
SLACK = 1e-9


def centres(some: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Unit centres of unit vectors, by repeated means of the nearest ones."""
    rng = np.random.default_rng(seed)
    own = some[rng.choice(len(some), min(cells, len(some)), replace=False)]
    for _ in range(ROUNDS):
        near = (some @ own.T).argmax(axis=1)
        total = np.zeros_like(own)
        np.add.at(total, near, some)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        own = np.where(size > 0, total / np.where(size > 0, size, 1), own)
    return own


def _told(own: np.ndarray, fields: list[str]):
    """Each vector's cell and its cosine with the cell's centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = own.shape[1]
        for b in batches:
            v = b.column("embedding").cast(pa.list_(pa.float64()))
            fits = pc.fill_null(pc.equal(pc.list_value_length(v), d), False).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(fits)
            x = np.asarray(pc.list_flatten(v.take(pa.array(at))).to_numpy(zero_copy_only=False), float).reshape(-1, d)
            size = np.linalg.norm(x, axis=1)
            good = np.isfinite(size) & (size > 0)
            dots = x[good] / size[good, None] @ own.T
            cell, cos = np.full(b.num_rows, NOWHERE, np.int32), np.zeros(b.num_rows)
            cell[at[good]], cos[at[good]] = dots.argmax(axis=1), dots.max(axis=1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in fields), pa.array(cell), pa.array(cos)], names=[*fields, "cell", "cell_cos"])

    return run


def store_cells(index: DataFrame, root: str, cells: int | None = None) -> None:
    """Store an index (path, chunk_index, embedding, ...) by cells below ``root``: the chunks in a folder
    a cell, and a table of centres, least cosines and sizes. ``cells``: about the square root of the
    chunks where not given. The centres come from a bounded sample; any centres give right results."""
    fields = [c for c in index.columns if c not in ("cell", "cell_cos")]
    spark = index.sparkSession
    rows = index.select(*fields).withColumn("embedding", F.col("embedding").cast("array<double>"))
    good = F.coalesce((F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    told = rows.where(good).agg(F.count("*").alias("n"), F.mode(F.size("embedding"), True).alias("d")).first()
    d = told.d or 1
    some = rows.where(good & (F.size("embedding") == d)).orderBy(F.xxhash64("path", "chunk_index"), "path", "chunk_index").limit(SAMPLE).select("embedding").collect()
    x = np.array([r.embedding for r in some], float).reshape(-1, d)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    own = centres(x, cells or min(MOST_CELLS, max(1, math.isqrt(told.n)))) if len(x) else np.ones((1, d))
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("cell_cos", T.DoubleType())])
    rows.mapInArrow(_told(own, fields), schema).write.partitionBy("cell").parquet(f"{root}/chunks")
    sizes = spark.read.schema(schema).parquet(f"{root}/chunks").groupBy("cell").agg(F.min("cell_cos").alias("least"), F.count("*").alias("n"))
    middle = spark.createDataFrame([(k, [float(y) for y in c]) for k, c in enumerate(own)], "cell int, centre array<double>")
    sizes.join(middle, "cell", "left").coalesce(1).write.parquet(f"{root}/cells")


@dataclass
class Found:
    """A search's rows (path, score, rank), and what it has read."""

    rows: DataFrame
    chunks_read: int
    chunks: int


def bound(query: np.ndarray, centre: Sequence[float] | None, least: float) -> float:
    """No vector of the cell has a higher cosine with the query: angles add up at most."""
    if centre is None or len(centre) != len(query):
        return 0.0
    c = np.array(centre)
    angle = lambda cos: math.acos(min(1.0, max(-1.0, cos)))
    apart = angle(float(query @ c) / (np.linalg.norm(query) * np.linalg.norm(c))) - angle(least)
    return math.cos(max(0.0, apart)) + SLACK


def search_cells(spark: SparkSession, root: str, query: Sequence[float], k: int) -> Found:
    """The ``k`` best distinct paths (one at least), as ranking the whole index gives them, ties too.

    Cells are read by descending bound, twice as many chunks each round, until every unread cell's
    bound is below the score of the k-th path. The driver holds the cells' table (at most
    ``MOST_CELLS`` rows) and k rows; a query of another length, or zero, scores 0 everywhere.
    """
    k, q = max(k, 1), np.array([float(x) for x in query])
    cells = spark.read.parquet(f"{root}/cells").collect()
    total = sum(c.n for c in cells)
    shape = "path string, score double, at int"
    if not len(q) or not total:
        return Found(spark.createDataFrame([], "path string, score double, rank int"), 0, total)
    chunks = spark.read.parquet(f"{root}/chunks")
    whole = bool(np.linalg.norm(q) > 0) and bool(np.isfinite(q).all())
    due = sorted(((bound(q, c.centre, c.least) if whole else 0.0, c.cell, c.n) for c in cells), key=lambda x: (-x[0], x[1]))
    score = cosine(F.col("embedding").cast("array<double>"), F.array(*[F.lit(float(x)) for x in q]))
    best: list[tuple] = []
    read, goal = 0, 0
    while due and (len(best) < k or due[0][0] >= best[-1][1]):
        goal = max(2 * goal, 1)
        some, size = [], 0
        while due and (not some or size < goal) and (len(best) < k or due[0][0] >= best[-1][1]):
            _, cell, n = due.pop(0)
            some.append(cell)
            size += n
        read, goal = read + size, max(goal, size)
        own = chunks.where(F.col("cell").isin(some)).select("path", "chunk_index", score.alias("score"))
        own = own.groupBy("path").agg(F.max("score").alias("score"), F.min_by("chunk_index", F.struct(-F.col("score"), F.col("chunk_index"))).alias("at"))
        merged = own.unionByName(spark.createDataFrame(best, shape)).groupBy("path").agg(F.max("score").alias("score"), F.min_by("at", F.struct(-F.col("score"), F.col("at"))).alias("at"))
        best = [tuple(r) for r in merged.orderBy(F.desc("score"), "path", "at").limit(k).collect()]
    rows = spark.createDataFrame(best, shape)
    return Found(rows.select("path", "score", F.row_number().over(Window.orderBy(F.desc("score"), "path", "at")).alias("rank")), read, total)
