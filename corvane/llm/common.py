"""Helpers shared by the training-data operators: scratch tables, row keys, Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast only if its counted rows are at most this many narrow rows.
BROADCAST_ROWS = 200_000
#: The same for a set of single longs (8 bytes each).
BROADCAST_IDS = 1_000_000
#: A key is hot if it holds over one in this many of the rows, so fewer keys than this are hot.
HOT_SHARES = 10_000
#: Bytes of an Arrow batch between the JVM and Python.
BATCH_BYTES = "4m"
#: Python kernels work on slices of an Arrow batch holding about this many bytes of text.
SLICE_BYTES = 1_000_000


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to ``BATCH_BYTES``, so that long texts don't add up in the JVM and in the
    Python worker. A limit that the session has set itself stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "67108864b", "64m", "64MB"):
        spark.conf.set(key, BATCH_BYTES)


def release() -> None:
    """Give a Python worker's free memory back at the end of a task: workers are used again, and
    what one operator has left would add to the next one's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not this C library
        pass


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below the shared one named by ``spark.checkpoint.dir``.

    Where the session names none, a local one is made in local mode (tests). On a cluster that is
    an error, as executors would each write to a disk of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = getattr(spark, "_corvane_scratch", None)
        if root is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = spark._corvane_scratch = tempfile.mkdtemp(prefix="corvane-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
            spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/corvane-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage ends at a stored table,
    so losing an executor later costs a re-read and not a recomputation. See ``discard``."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    stored(spark).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corvane_path = path
    return out


def stored(spark: SparkSession) -> list[str]:
    """The scratch tables that this session has written and not yet discarded."""
    if not hasattr(spark, "_corvane_tables"):
        spark._corvane_tables = []
    return spark._corvane_tables


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that no result still reads. Operators delete what they have used up;
    the tables below a returned DataFrame go with ``discard(spark, list(stored(spark)))`` once the
    result is written."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        if path in stored(spark):
            stored(spark).remove(path)


def bounded(df: DataFrame, rows: int, most: int | None = None) -> DataFrame:
    """Mark a narrow table for broadcast when its counted ``rows`` are within the bound."""
    return F.broadcast(df) if rows <= (BROADCAST_ROWS if most is None else most) else df


def join_hot(rows: DataFrame, labels: DataFrame, keys: list[str], count: str, total: int, shares: int = HOT_SHARES) -> DataFrame:
    """Inner join on ``keys`` that sends no hot key's rows to one task. ``labels`` (stored, as it
    is read twice) has one row per key; ``count`` says how many of the ``total`` rows have it.

    Fewer than ``shares`` keys can hold over ``total / shares`` rows: they are broadcast, and
    their rows stay where they are. All others are shuffled.
    """
    hot, cold = (labels.where(c) for c in (F.col(count) > total // shares, F.col(count) <= total // shares))
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys))


def row_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Two 64-bit hashes of (id, text): a join key that holds for null and repeated ids."""
    return [F.xxhash64(F.lit(1), df[id_col], df[text_col]).alias("_k1"), F.xxhash64(F.lit(2), df[text_col], df[id_col]).alias("_k2")]


def once(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def running(values: Column, merge, block: int = 64) -> Column:
    """``merge`` over each prefix of an array of ints, the whole one last. A fold over all of it would
    copy what it has at each step, so blocks are folded by themselves, then the blocks' totals."""
    none = F.array().cast("array<int>")

    def scan(own: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct(merge(acc["at"], x).cast("int").alias("at"), F.concat(acc["out"], F.array(merge(acc["at"], x).cast("int"))).alias("out"))
        return F.aggregate(own, F.struct(start.cast("int").alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / block).cast("int")), lambda k: F.slice(v, k * block + 1, F.lit(block)))
        totals = lambda bs: F.transform(bs, lambda x: F.aggregate(x, F.lit(0), lambda a, y: merge(a, y).cast("int")))
        before = lambda bs: F.concat(F.array(F.lit(0)), scan(totals(bs), F.lit(0)))
        joined = lambda bs: once(before(bs), lambda at: F.flatten(F.transform(bs, lambda x, k: scan(x, F.get(at, k)))))
        return once(blocks, joined)

    return F.when(F.size(values) == 0, none).otherwise(once(values, whole))


def put(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns; an input column of the same name is replaced."""
    return df.withColumns(cols)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text (one row at least)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at, held = 0, 0
    for i, n in enumerate(size):
        if held and held + n > limit:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)


def map_text(df: DataFrame, text_col: str, fields: list[T.StructField], fn: Callable[[], Callable[[list], list[pa.Array]]], keep: list[str] | None = None) -> DataFrame:
    """Apply a Python kernel to a text column in Arrow batches.

    ``fn()`` is called once per task and gives a function from a list of texts (None for
    null) to one Arrow array per field. Columns of ``keep`` (default: all) pass through;
    those whose names clash with ``fields`` are replaced.
    """
    small_batches(df.sparkSession)
    names = {f.name for f in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    source = "_corvane_text"
    sent = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(source))
    schema = T.StructType([f for f in sent.schema.fields if f.name != source] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = fn()
        for whole in batches:
            for b in slices(whole, source):
                out = kernel(b.column(source).to_pylist())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *out], names=[*keep, *(f.name for f in fields)])
        del kernel
        gc.collect()
        release()

    return sent.mapInArrow(run, schema)
