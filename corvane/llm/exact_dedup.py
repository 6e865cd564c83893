"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import BROADCAST_ROWS, join_hot, materialize

#: ASCII white space runs that compare equal to one space.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def normalized(text: Column) -> Column:
    """Null as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, digest: bool = False) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept`` (and ``text_sha256`` with ``digest``).

    Texts are equal when their normalised forms are identical. Of equal texts the row with
    the least id stays (nulls last). A scan counts pairs of length and prefix hash, combined
    before the shuffle; rows whose pair occurs once are done. Only the others' texts are hashed
    in full, and only their hashes are grouped. The pairs are broadcast where they are counted
    to be few; else rows meet them by a shuffle, hot pairs apart, with the same result. ``digest``
    asks for the hash of every row, which the second scan then makes at once, so that no text is
    shuffled. Rows of a text with very many copies are not shuffled.

    Null text counts as empty; all empty texts form one group. Of rows that repeat both id
    and text exactly one is kept. An empty table gives an empty table; other columns are
    ignored whatever their names.
    """
    norm = normalized(F.col(text_col))
    base = docs.select(F.col(id_col).alias("_id"), norm.alias("_t"))
    size, head = F.length("_t"), F.xxhash64(F.substring("_t", 1, prefix))
    pairs = materialize(base.select(size.alias("_n"), head.alias("_p")).groupBy("_n", "_p").agg(F.count("*").alias("_c")))
    left = pairs.where("_c > 1").select("_n", "_p", F.lit(True).alias("_hit"))
    full = F.sha2("_t", 256)
    told = F.unhex(full).alias("_f") if digest else F.col("_t")
    rows = base.select("_id", size.alias("_n"), head.alias("_p"), told, F.monotonically_increasing_id().alias("_r"))
    if left.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(left), ["_n", "_p"], "left")
    else:
        rows = join_hot(materialize(rows) if digest else rows, pairs.withColumn("_hit", F.col("_c") > 1), ["_n", "_p"], "_c", pairs.agg(F.sum("_c")).first()[0])
    hashed = F.when(F.col("_hit"), F.col("_f") if digest else F.unhex(full)).alias("_h")
    rows = rows.select("_id", hashed, "_r", *([F.lower(F.hex("_f")).alias("text_sha256")] if digest else []))
    rows = materialize(rows)
    # The hash's four words group in place of the binary so that counting stays in the hash aggregate.
    words = [F.conv(F.hex(F.substring("_h", 1 + 8 * i, 8)), 16, -10).cast("long").alias(f"_w{i}") for i in range(4)]
    key = [f"_w{i}" for i in range(4)]
    dup = rows.where("_h is not null").select("*", *words)
    # The row that stays has the least id (null last); of rows that repeat it, the first stored one.
    groups = dup.groupBy(*key).agg(F.count("*").alias("_g"), F.min(F.struct(F.col("_id").isNull().alias("z"), "_id", "_r")).alias("_win"))
    groups = materialize(groups.select(*key, "_g", F.col("_win._id").alias("_keep"), F.col("_win._r").alias("_win")))
    found = join_hot(dup, groups, key, "_g", groups.agg(F.sum("_g")).first()[0] or 0)
    more = ["text_sha256"] if digest else []
    one = rows.where("_h is null").select(F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *more)
    many = found.select(F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_g").alias("group_size"), (F.col("_r") == F.col("_win")).alias("kept"), *more)
    return many.unionByName(one)
