"""Distributed union-find: connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import discard, materialize


def _with_min(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with the least of u and u's neighbours. The minimum is pre-aggregated
    per task, and the join lets adaptive execution split a hub's rows."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(low, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (columns ``u``, ``v``, both of one type).

    ``root`` is the least node of the component. Large-star and small-star steps alternate
    until the edge set stays the same, which takes about the logarithm of the longest path in
    rounds; each round is one stored table in the place of the last, nothing is collected but a
    count and a checksum. Loops and repeated edges are allowed, nulls are not. An empty edge
    table gives an empty result.
    """
    cur = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Every large-star edge points down (u > v), so u's neighbours below it are just its v.
        small = _with_min(large)
        nxt = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        last, cur = cur, materialize(nxt.where("u <> v").distinct())
        discard(cur.sparkSession, [last._corvane_path])
        mark = cur.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").bitwiseAND(0xFFFFFFFF))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
