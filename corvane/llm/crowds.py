"""Exact links inside crowded buckets: blocks of sets meet in Arrow batches, links leave as a forest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import BROADCAST_IDS, bounded, join_hot, materialize, small_batches

#: Members of a bucket's part that meet another part in one task.
PART = 500
#: Distinct members of sets that are multiplied at once.
WIDTH = 4096


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two sets share, by products of their membership matrices."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    member = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]), return_inverse=True)[1]
    often = np.bincount(member) > 1 if len(member) else np.zeros(0, bool)
    place = np.cumsum(often) - 1
    hit = often[member]
    owner, member = owner[hit], place[member[hit]]
    order = np.argsort(member, kind="stable")
    owner, member = owner[order], member[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(often.sum()), WIDTH):
        a, b = np.searchsorted(member, [lo, lo + WIDTH])
        m = np.zeros((len(sets), WIDTH), np.float32)
        m[owner[a:b], member[a:b] - lo] = 1
        out += m @ m.T
    return out


def alike_matrix(sets: list[np.ndarray], jaccard: float) -> np.ndarray:
    size = np.array([len(s) for s in sets], np.float64)
    both = shared_counts(sets).astype(np.float64)
    return both >= jaccard / (1 + jaccard) * (size[:, None] + size[None, :]) - 1e-9


def forest(like: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what ``like`` joins: each one found leaves those that later ones meet."""
    left, out = np.ones(len(like), bool), []
    for x in range(len(like)):
        if left[x]:
            left[x], queue = False, [x]
            while queue:
                y = queue.pop()
                got = np.flatnonzero(like[y] & left)
                left[got] = False
                out += [(y, int(z)) for z in got]
                queue += got.tolist()
    return out


def _meet(sets_of: Callable[[list], list[np.ndarray]], jaccard: float):
    """Over rows sorted by (key, a, b): the links of each run. Members of the centre's component
    (``joined``) are compared with the others alone, and one link to it is enough."""

    def links(ids: np.ndarray, joined: np.ndarray, texts: list) -> list[tuple[int, int]]:
        like = alike_matrix(sets_of(texts), jaccard)
        apart = np.flatnonzero(~joined)
        found = [(int(ids[apart[x]]), int(ids[apart[y]])) for x, y in forest(like[np.ix_(apart, apart)])]
        near = like[np.ix_(apart, np.flatnonzero(joined))]
        first = ids[joined]
        return found + [(int(ids[apart[k]]), int(first[near[k].argmax()])) for k in np.flatnonzero(near.any(axis=1))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def told() -> pa.RecordBatch:
            got = links(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], bool), [r[2] for r in rows]) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in got], pa.int64()), pa.array([v for _, v in got], pa.int64())], names=["u", "v"])

        for b in batches:
            for *at, c, j, text in zip(*(b.column(x).to_pylist() for x in ("key", "a", "b", "c", "joined", "x"))):
                if at != key:
                    if rows:
                        yield told()
                    key, rows = at, []
                rows.append((c, j, text))
        if rows:
            yield told()

    return run


def crowd_links(members: DataFrame, content: DataFrame, sets_of: Callable[[list], list[np.ndarray]], jaccard: float) -> DataFrame:
    """Links (u, v) that join all alike ones of each bucket, beyond those to its centre.

    ``members``: (key, c, joined), stored: joined ones are linked to the bucket's centre already
    and may be the greater part. ``content``: (_c, x), what ``sets_of`` makes sets of. The others
    are cut into parts by hash that meet pairwise, and each part meets the joined ones, cut too;
    joined ones are never compared among themselves. So no task holds more than two parts of a
    bucket, rows grow with the bucket times its parts of others, and a forest leaves a task.
    """
    small_batches(members.sparkSession)
    parts = lambda c: F.greatest(F.ceil(F.col(c) / PART), F.lit(1)).cast("int")
    size = members.groupBy("key").agg(F.count("*").alias("n"), F.count_if(~F.col("joined")).alias("o"), F.count_if("joined").alias("g"))
    size = materialize(size.select("key", "n", parts("o").alias("po"), parts("g").alias("pg")))
    rows = join_hot(members, size, ["key"], "n", members.count())
    part = F.pmod(F.xxhash64("c"), F.when(F.col("joined"), F.col("pg")).otherwise(F.col("po"))).cast("int")
    rows = rows.select("key", "c", "joined", "po", "pg", part.alias("p"))
    # Pairs of parts (a, b): others i and j meet in (min, max), others j and joined s in (-1 - s, j).
    own = F.transform(F.sequence(F.lit(0), F.col("po") - 1), lambda j: F.struct(F.least("p", j).alias("a"), F.greatest("p", j).alias("b")))
    cross = F.transform(F.sequence(F.lit(0), F.col("pg") - 1), lambda s: F.struct((-1 - s).alias("a"), F.col("p").alias("b")))
    joined = F.transform(F.sequence(F.lit(0), F.col("po") - 1), lambda j: F.struct((-1 - F.col("p")).alias("a"), j.alias("b")))
    dealt = rows.select("key", "c", "joined", F.explode(F.when(F.col("joined"), joined).otherwise(F.concat(own, cross))).alias("m")).select("key", "m.a", "m.b", "c", "joined")
    ids = members.select(F.col("c").alias("_c")).distinct()
    few = materialize(content.join(bounded(ids, members.count(), BROADCAST_IDS), "_c", "left_semi"))
    both = dealt.join(few.withColumnRenamed("_c", "c"), "c").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return materialize(both.mapInArrow(_meet(sets_of, jaccard), "u long, v long").distinct())
