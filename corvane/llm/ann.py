"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import bounded, join_hot, materialize, small_batches

#: Vectors, and queries, of one group that meet in one task; larger groups are cut.
BLOCK = 20_000
#: Tables, each of two rotations.
TABLES = 20
#: Rows whose products with a query tell which scores are worth keeping.
SAMPLE = 2000
#: Neighbours kept for exact reranking, per neighbour asked for.
SPARE = 3


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


class Rotations:
    """Pseudo-random rotations H D3 H D2 H D1, two per table. A vector's bucket in a table is the pair
    of signed axes that the two send it nearest to."""

    def __init__(self, dim: int, tables: int, seed: int = 11) -> None:
        self.width = 1 << max(0, dim - 1).bit_length()
        self.tables = tables
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 2, 3, self.width))

    def signed(self, x: np.ndarray, table: int, axis: int) -> np.ndarray:
        """Affinity of each row to each signed axis: the rotated coordinates and their negatives."""
        y = np.zeros((len(x), self.width))
        y[:, : x.shape[1]] = x
        for s in self.signs[table, axis]:
            y = _hadamard(y * s)
        return np.concatenate([y, -y], axis=1)

    def own(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        return self.signed(x, table, 0).argmax(axis=1), self.signed(x, table, 1).argmax(axis=1)

    def probes(self, x: np.ndarray, table: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, count) pairs of axes in falling affinity, the sum over the two rotations."""
        first, second = self.signed(x, table, 0), self.signed(x, table, 1)
        # A pair among the best has fewer than ``count`` pairs of better axes on both sides.
        side = min(first.shape[1], count)
        a, b = (np.argsort(-y, axis=1, kind="stable")[:, :side] for y in (first, second))
        places = [(i, j) for i in range(side) for j in range(min(side, count // (i + 1)))]
        i, j = (np.array(v) for v in zip(*places))
        sums = np.take_along_axis(first, a, 1)[:, i] + np.take_along_axis(second, b, 1)[:, j]
        order = np.argsort(-sums, axis=1, kind="stable")[:, :count]
        return np.take_along_axis(a, i[order], 1), np.take_along_axis(b, j[order], 1)


def probe_plan(rot: Rotations, dim: int, recall: float = 0.9, pairs: int = 200, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(cosines, probes): buckets to probe in each table so that a vector at the cosine is met in one
    of them with probability ``recall``, from random pairs and the rotations themselves."""
    rng = np.random.default_rng(seed)
    q = rng.normal(size=(pairs, dim))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    r = rng.normal(size=q.shape)
    r -= (r * q).sum(axis=1, keepdims=True) * q
    r /= np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-300)
    grid = np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])
    place = np.full((len(grid), pairs), np.inf)
    for t in range(rot.tables):
        first, second = rot.signed(q, t, 0), rot.signed(q, t, 1)
        sums = np.sort((first[:, :, None] + second[:, None, :]).reshape(pairs, -1), axis=1)
        for k, c in enumerate(grid):
            a, b = rot.own(c * q + np.sqrt(1 - c * c) * r, t)
            value = first[np.arange(pairs), a] + second[np.arange(pairs), b]
            rank = [sums.shape[1] - np.searchsorted(x, v, side="right") + 1 for x, v in zip(sums, value - 1e-12)]
            place[k] = np.minimum(place[k], np.maximum(rank, 1))
    need = np.quantile(place, recall, axis=1)
    return grid, np.maximum.accumulate(need[::-1])[::-1]


def _matrix(column: pa.Array) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _coded(x: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Vectors in a byte a component, and the scale of each: what moves to the buckets."""
    scale = np.abs(x).max(axis=1) / 127
    code = np.round(x / scale[:, None]).astype(np.int8)
    return pa.array([r.tobytes() for r in code], pa.binary()), pa.array(scale)


#: So few vectors are read whole, and of more a share that falls with the square of their number.
FEW = 1500
#: Norms within this factor share a range, whose vectors are hashed by their direction alone.
NORMS = 1.25
#: The sample's highest scores, from which on the tail is extended.
TAIL = 40


@dataclass(frozen=True)
class Index:
    """What hashing needs: the ranges of norms, counted down from the largest, the sample's vectors,
    how many rows it stands for, and the plan of the probes; ``whole``: probe every bucket."""

    rot: Rotations
    largest: float
    ranges: tuple[int, ...]
    sample: np.ndarray
    n: int
    k: int
    plan: tuple[np.ndarray, np.ndarray]
    whole: bool = False

    def range_of(self, norm: np.ndarray) -> np.ndarray:
        return np.floor(np.log(self.largest / norm) / np.log(NORMS) + 1e-4).astype(np.int64)

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """Per query about the score of its k-th nearest of all rows: beyond the sample's highest scores
        the scores are taken to fall like a normal law. Where they fall slower the bound is low,
        which costs probes and no neighbour."""
        scores = np.sort(x @ self.sample.T, axis=1)[:, ::-1]
        share = self.k / self.n
        own = int(np.ceil(share * scores.shape[1]))
        if own >= TAIL or scores.shape[1] <= 2 * TAIL:
            return scores[:, min(own, scores.shape[1]) - 1]
        edge, middle = scores[:, TAIL - 1], np.median(scores, axis=1)
        z = NormalDist().inv_cdf
        return middle + (edge - middle) * z(1 - share) / z(1 - TAIL / scores.shape[1])

    def probes(self, x: np.ndarray) -> np.ndarray:
        """(queries, ranges) of probe counts. A neighbour in a range of norms up to M has at least the
        cosine ``bound / (|q| M)``; a range that cannot reach the bound is not probed."""
        buckets = (2 * self.rot.width) ** 2
        if self.whole:
            return np.full((len(x), len(self.ranges)), buckets)
        top = self.largest * NORMS ** -np.array(self.ranges, np.float64)
        cos = self.bounds(x)[:, None] / (np.linalg.norm(x, axis=1)[:, None] * top[None, :])
        grid, need = self.plan
        out = np.ceil(np.exp(np.interp(cos, grid, np.log(need)))).astype(np.int64)
        out[cos < grid[0]] = buckets
        out = np.maximum(out, int(np.ceil(buckets * min(1.0, (FEW / self.n) ** 2))))
        out[cos > 1.05] = 0
        return out


_ROWS = "part long, query boolean, c long, code binary, scale double, least double, second array<int>"


def _hash(index: Index, query: bool):
    """Rows (c, vec) to rows of the groups they meet in: one per table, range of norms and first axis.
    A row of the index has its second axis, a query those it probes, and the score from which it
    keeps. Where a query would probe half of the buckets, one table is read whole instead."""
    buckets = (2 * index.rot.width) ** 2

    def part(t: int, span: np.ndarray, first: np.ndarray) -> np.ndarray:
        return (np.int64(t) << 48) | (span.astype(np.int64) << 32) | first.astype(np.int64)

    def asked(x: np.ndarray) -> Iterator[tuple]:
        unit, count = x / np.linalg.norm(x, axis=1, keepdims=True), index.probes(x)
        for t in range(index.rot.tables):
            for r, span in enumerate(index.ranges):
                want = np.where(count[:, r] * 2 >= buckets, buckets if t == 0 else 0, count[:, r])
                row = np.flatnonzero(want)
                if len(row):
                    a, b = index.rot.probes(unit[row], t, int(want.max()))
                    keep = np.arange(a.shape[1])[None, :] < want[row, None]
                    yield t, span, np.repeat(row, keep.sum(axis=1)), a[keep], b[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "query", "c", "code", "scale", "least", "second"]
        for whole in batches:
            for at in range(0, whole.num_rows, 100 if query else 1000):
                b = whole.slice(at, 100 if query else 1000)
                x = _matrix(b.column("vec"))
                code, scale = _coded(x)
                if not query:
                    norm = np.linalg.norm(x, axis=1)
                    span, unit, least = index.range_of(norm), x / norm[:, None], pa.array(np.zeros(len(x)))
                    for t in range(1 if index.whole else index.rot.tables):
                        first, second = index.rot.own(unit, t)
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32)), pa.array(second.astype(np.int32)))
                        yield pa.RecordBatch.from_arrays([pa.array(part(t, span, first)), pa.array(np.zeros(len(x), bool)), b.column("c"), code, scale, least, lists], names=names)
                    continue
                bound = index.bounds(x)
                least = np.full(len(x), -np.inf) if index.whole or index.n <= len(index.sample) else bound - 0.15 * np.abs(bound)
                for t, span, row, first, second in asked(x):
                    order = np.lexsort((second, first, row))
                    row, first, second = row[order], first[order], second[order]
                    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (first[1:] != first[:-1])])
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(row)].astype(np.int32)), pa.array(second.astype(np.int32)))
                    row, first = row[new], first[new]
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(part(t, np.full(len(row), span), first)), pa.array(np.ones(len(row), bool)), b.column("c").take(take), code.take(take), scale.take(take), pa.array(least[row]), lists], names=names)

    return run


def _meet_group(rows: list[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """One group: each second axis' vectors by the queries that probe it; of what reaches a query's
    least score, its best."""
    t = pa.Table.from_batches(rows)
    is_query = t["query"].to_numpy().astype(bool)
    x = np.frombuffer(b"".join(t["code"].to_pylist()), np.int8).reshape(len(t), -1).astype(np.float32) * t["scale"].to_numpy()[:, None].astype(np.float32)
    c, least = t["c"].to_numpy(), t["least"].to_numpy()
    second = t["second"].combine_chunks()
    size, flat = pc.list_value_length(second).to_numpy(zero_copy_only=False), pc.list_flatten(second).to_numpy()
    owner = np.repeat(np.arange(len(t)), size)
    order = np.lexsort((is_query[owner], flat))
    owner, flat = owner[order], flat[order]
    new = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    q, v, s = [], [], []
    for lo, hi in zip(new, np.r_[new[1:], len(flat)]):
        own = owner[lo:hi]
        cut = np.searchsorted(is_query[own], True)
        data, asked = own[:cut], own[cut:]
        if not len(data) or not len(asked):
            continue
        strip = max(1, 2_000_000 // len(data))
        for at in range(0, len(asked), strip):
            some = asked[at : at + strip]
            score = x[some] @ x[data].T
            # A little room below the bound for what the bytes have rounded.
            i, j = np.nonzero(score >= least[some][:, None] - 0.02 * np.abs(least[some][:, None]))
            q.append(some[i])
            v.append(data[j])
            s.append(score[i, j])
    if not q:
        return
    q, v, s = np.concatenate(q), np.concatenate(v), np.concatenate(s).astype(np.float64)
    best = np.lexsort((-s, q))
    q, v, s = q[best], v[best], s[best]
    top = np.arange(len(q)) - np.searchsorted(q, q) < keep
    yield pa.RecordBatch.from_arrays([pa.array(c[q[top]]), pa.array(c[v[top]]), pa.array(s[top])], names=["q", "c", "score"])


def _meet(keep: int):
    """Over rows sorted by (part, bx, bq): each run is one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for b in batches:
            own = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("part", "bx", "bq")], axis=1)
            new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]).any(axis=1)]) if len(own) else []
            for lo, hi in zip(new, [*new[1:], len(own)]):
                if tuple(own[lo]) != key:
                    if rows:
                        yield from _meet_group(rows, keep)
                    key, rows = tuple(own[lo]), []
                rows.append(b.slice(lo, hi - lo).select(["query", "c", "code", "scale", "least", "second"]))
        if rows:
            yield from _meet_group(rows, keep)

    return run


def _ranked(index: Index, base: DataFrame, asked: DataFrame, keep: int) -> DataFrame:
    """(q, c, score): the ``keep`` best candidates of each query, by scores of rounded vectors. Groups
    with more than a block of vectors or queries are cut by hash, and the pieces meet pairwise."""
    small_batches(base.sparkSession)
    rows = base.mapInArrow(_hash(index, False), _ROWS).unionByName(asked.mapInArrow(_hash(index, True), _ROWS))
    # Stored, so that counting the groups doesn't hash twice; the repeated vectors are stored once a file.
    rows = materialize(rows)
    sizes = rows.groupBy("part").agg(F.count_if(~F.col("query")).alias("n"), F.count_if("query").alias("m"))
    pieces = lambda c: F.greatest(F.ceil(F.col(c) / BLOCK), F.lit(1)).cast("int")
    large = materialize(sizes.where((F.col("n") > BLOCK) | (F.col("m") > BLOCK)).select("part", pieces("n").alias("nx"), pieces("m").alias("nq")))
    if many := large.count():
        j = rows.join(bounded(large, many), "part", "left").fillna(1, ["nx", "nq"])
        mine = F.pmod(F.xxhash64("c"), F.when(F.col("query"), F.col("nq")).otherwise(F.col("nx"))).cast("int")
        j = j.select(*rows.columns, mine.alias("_own"), F.explode(F.sequence(F.lit(0), F.when(F.col("query"), F.col("nx")).otherwise(F.col("nq")) - 1)).alias("_other"))
        rows = j.select(*rows.columns, F.when(F.col("query"), F.col("_other")).otherwise(F.col("_own")).alias("bx"), F.when(F.col("query"), F.col("_own")).otherwise(F.col("_other")).alias("bq"))
    else:
        rows = rows.select("*", F.lit(0).alias("bx"), F.lit(0).alias("bq"))
    met = rows.repartition("part", "bx", "bq").sortWithinPartitions("part", "bx", "bq").mapInArrow(_meet(keep), "q long, c long, score double")
    one = met.groupBy("q", "c").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))
    return one.withColumn("k", place).where(F.col("k") <= keep).select("q", "c", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, tables: int = TABLES, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the ``k`` rows of ``vectors`` nearest to each row of ``queries``.

    Nearness is the inner product in double precision. A row's own id is never its neighbour.
    Equal vectors are one class: each class keeps its k + 1 least ids, which is all that any
    answer can hold, and is hashed, probed and ranked once however many rows share it. All
    classes are indexed in each of ``tables`` tables by range of norm and direction. A query
    probes the buckets nearest to it, as many as ``probe_plan`` asks for at the cosine that a
    neighbour of that range must have; a bounded sample of the rows tells that cosine, so that one
    rule serves all sizes and norms. Candidates are scored by vectors of a byte a component; the best are
    ranked again by exact products. A class with fewer than k + 1 found although more exist is ranked against all buckets.

    Vectors that are null, zero, or hold a null or non-finite component take no part, nor do
    null ids; all others must have one length. Rows that repeat id and vector count once.
    Fewer than k candidates: all. Other columns are ignored; empty tables give an empty table.
    """
    good = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    kind = vectors.schema[vec_col].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"

    def valid(df: DataFrame) -> DataFrame:
        # Adding zero makes a negative zero a plain one, so that equal vectors are one class.
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("v")).where(F.col("id").isNotNull() & good).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast(kind)))

    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    # The ids of a class: distinct ones up to k + 1, cut per task before the shuffle.
    ids = valid(vectors).distinct().withColumn("k", place).where(F.col("k") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    classes = materialize(ids.select(F.xxhash64("v", F.lit(1)).alias("c"), F.col("v").alias("vec"), "ids", size.alias("norm")))
    members = materialize(valid(queries).select("id", F.xxhash64("v", F.lit(1)).alias("c"), "v").distinct())
    asked = materialize(members.groupBy("c").agg(F.first("v").alias("vec"), F.count("*").alias("n")))
    told = classes.agg(F.count("*").alias("n"), F.max("norm").alias("high"), F.max(F.size("vec")).alias("d")).first()
    if not (n := told.n):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double").withColumnRenamed("vec_id", id_col)
    rot = Rotations(told.d, tables)
    some = np.stack(classes.orderBy(F.xxhash64("c")).limit(SAMPLE).select("vec").toPandas()["vec"].to_numpy()).astype(np.float64)
    index = Index(rot, told.high, (), some, n, k + 1, probe_plan(rot, told.d))
    spans = classes.select(F.floor(F.log(F.lit(told.high) / F.col("norm")) / float(np.log(NORMS)) + 1e-4).cast("int").alias("r")).distinct()
    index = replace(index, ranges=tuple(sorted(r.r for r in spans.collect())))
    want, keep = min(k + 1, n), SPARE * (k + 1)
    base, sought = classes.select("c", "vec"), asked.select("c", "vec")
    found = materialize(_ranked(index, base, sought, keep))
    enough = found.groupBy(F.col("q").alias("c")).agg(F.count("*").alias("got"))
    short = materialize(sought.join(enough, "c", "left").where(F.coalesce("got", F.lit(0)) < want).select("c", "vec"))
    if not short.isEmpty():
        more = _ranked(replace(index, whole=True), base, short, keep)
        found = materialize(found.join(short.select(F.col("c").alias("q")), "q", "left_anti").unionByName(more))
    near = found.join(classes.select("c", "vec", "ids"), "c").join(asked.select(F.col("c").alias("q"), F.col("vec").alias("ask")), "q")
    exact = F.aggregate(F.zip_with("vec", "ask", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)
    rows = near.select("q", exact.alias("score"), F.explode("ids").alias("id"))
    top = rows.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("k") <= k + 1)
    lists = top.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("k", "id", "score"))).alias("near"))
    lists = materialize(lists.withColumnRenamed("q", "c").join(asked.select("c", "n"), "c"))
    own = F.slice(F.filter("near", lambda x: x["id"] != F.col("me")), 1, k)
    out = join_hot(members.select(F.col("id").alias("me"), "c"), lists, ["c"], "n", members.count()).select("me", F.posexplode(own).alias("at", "x"))
    return out.select(F.col("me").alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_col), F.col("x.score").alias("score"))
