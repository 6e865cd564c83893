"""Lookups, merges and summaries over projects, stories and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def find_by_id(rows: DataFrame, target: str | None, active: str | None = None, id_col: str = "id", pos_col: str = "pos") -> DataFrame:
    """At most one row: the first whose id equals the target in any case; without target or
    active id, the first of all. ``limit 1`` over an order is a per-task top-1."""
    want = target or active or ""
    hit = rows.where(F.lower(id_col) == want.lower()) if want else rows
    return hit.orderBy(pos_col).limit(1)


def merge_registry(config: DataFrame, persisted: DataFrame, id_col: str = "id", pos_col: str = "pos") -> DataFrame:
    """Config rows, then persisted ones whose id is new, case-sensitively; the first of each id."""
    new = persisted.join(config.select(id_col), id_col, "left_anti")
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(pos_col))
    return config.unionByName(new.withColumn("_r", rank).where("_r = 1").drop("_r"))


def operations_summary(operation: Column) -> Column:
    """An aggregate: distinct operations in order, or ``none``."""
    return F.coalesce(F.nullif(F.array_join(F.array_sort(F.collect_set(operation)), ", "), F.lit("")), F.lit("none"))


def load_context(ranked: DataFrame, files: DataFrame) -> DataFrame:
    """Ranked paths with their content; paths without a file go, and no others take their place."""
    return ranked.join(files, "path").select("rank", "path", "content")


def context_totals(ranked: DataFrame, files: DataFrame) -> DataFrame:
    """Number and characters of the ranked files; lengths are taken before the join, so no text moves."""
    sizes = ranked.join(files.select("path", F.length("content").alias("n")), "path")
    return sizes.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_chars"))
