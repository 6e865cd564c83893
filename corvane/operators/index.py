"""The vector index: chunk, embed, store, search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.text import chunks, embedding_text, redact
from corvane.functions.vector import cosine, norm
from corvane.sources.store import exists

INPUT_CHARS = 8000


class Embedder(Protocol):
    """Texts to vectors of one length. Runs on executors, so it must pickle."""

    def __call__(self, texts: Sequence[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """A stand-in without meaning: hashed word counts, normalised. Not a language model."""

    def __init__(self, dims: int = 1024) -> None:
        self.dims = dims

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        import zlib

        out = []
        for t in texts:
            v = [0.0] * self.dims
            for w in t.lower().split():
                h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                v[h % self.dims] += 1.0 if h >> 31 else -1.0
            size = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / size for x in v])
        return out


class LetterEmbedder:
    """A stand-in without meaning that any engine can compute: shares of the letters a to z."""

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [float(t.count(chr(97 + i))) for i in range(26)]
            size = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / size for x in v])
        return out


def chunk_files(files: DataFrame, size: int = 1800) -> DataFrame:
    """(path, chunk_index, text)"""
    return files.select("path", F.explode(chunks(F.col("content"), size)).alias("c")).select("path", "c.chunk_index", "c.text")


def embed(rows: DataFrame, text: Column, embedder: Embedder, redacted: bool = True) -> DataFrame:
    """``rows`` with ``embedding`` and ``norm``, in place: nothing is matched by position. Secrets
    are taken out before the text leaves, unless told otherwise."""
    sent = rows.withColumn("_sent", F.substring(redact(text) if redacted else text, 1, INPUT_CHARS))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.drop(columns="_sent").assign(embedding=embedder(p["_sent"].tolist()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return sent.mapInPandas(run, f"{fields}, embedding array<double>").withColumn("norm", norm(F.col("embedding")))


def patient(embedder: Embedder, texts: list[str]) -> list[list[float]]:
    """Vectors of texts; a text that the embedder fails on, alone, becomes an empty one."""
    try:
        return embedder(texts)
    except Exception:
        if len(texts) == 1:
            return [[]]
        half = len(texts) // 2
        return patient(embedder, texts[:half]) + patient(embedder, texts[half:])


def embed_new(rows: DataFrame, text: Column, embedder: Embedder, vectors: str, redacted: bool = True) -> DataFrame:
    """As ``embed``, by way of a table of vectors by content below ``vectors``: of the distinct texts
    only those without a vector there are sent, each once; then the table has them.

    A text that fails becomes an empty vector and is sent again next time. The table of each embedder
    is its own (``name``, else the class's name). Two rebuilds at once may both send a new text; its
    vectors are equal and one is used.
    """
    spark = rows.sparkSession
    table = f"{vectors.rstrip('/')}/{getattr(embedder, 'name', type(embedder).__name__)}"
    sent = F.substring(redact(text) if redacted else text, 1, INPUT_CHARS)
    keyed = rows.withColumn("_key", F.sha2(sent, 256)).withColumn("_sent", sent)
    schema = "_key string, embedding array<double>"
    known = lambda: spark.read.schema(schema).parquet(table) if exists(spark, table) else spark.createDataFrame([], schema)
    new = keyed.select("_key", "_sent").dropDuplicates(["_key"]).join(known().select("_key"), "_key", "left_anti")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                yield pd.DataFrame({"_key": p["_key"], "embedding": patient(embedder, p["_sent"].tolist())})

    new.mapInPandas(run, schema).where(F.size("embedding") > 0).write.mode("append").parquet(table)
    once = known().dropDuplicates(["_key"])
    none = F.array().cast("array<double>")
    return keyed.drop("_sent").join(once, "_key", "left").withColumn("embedding", F.coalesce("embedding", none)).drop("_key").withColumn("norm", norm(F.col("embedding")))


def build(files: DataFrame, embedder: Embedder, redacted: bool = True, vectors: str | None = None) -> DataFrame:
    """Chunks with vectors and norms; order within the index is (path, chunk_index). ``vectors``: a
    folder that keeps them by content."""
    rows = chunk_files(files)
    text = embedding_text(F.col("path"), F.col("chunk_index"), F.col("text"))
    return embed_new(rows, text, embedder, vectors, redacted) if vectors else embed(rows, text, embedder, redacted)


def store_all(index: DataFrame, root: str) -> None:
    """Replace the parts of all projects that ``index`` names in ``project_id``."""
    index.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(root)


def store(index: DataFrame, root: str, project_id: str) -> None:
    """Replace one project's part of the index; other projects' parts stay."""
    store_all(index.withColumn("project_id", F.lit(project_id)), root)


def search(index: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """(path, score, rank): the ``k`` best distinct paths, one at least; ties go to the first chunk.

    The query vector is a literal, so there is no join; a path's best chunk is a combinable
    maximum, and the top k a per-task one.
    """
    if not len(query):
        return index.select("path", F.lit(0.0).alias("score"), F.lit(1).alias("rank")).where("false")
    q = F.array(*[F.lit(float(x)) for x in query])
    size = float(sum(float(x) ** 2 for x in query) ** 0.5)
    own = F.col("norm") if "norm" in index.columns else None
    score = cosine(F.col("embedding").cast("array<double>"), q, own, F.lit(size))
    best = index.select("path", "chunk_index", score.alias("score")).groupBy("path").agg(F.max("score").alias("score"), F.min_by("chunk_index", F.struct(-F.col("score"), F.col("chunk_index"))).alias("at"))
    top = best.orderBy(F.desc("score"), "path", "at").limit(max(k, 1))
    return top.select("path", "score", F.row_number().over(Window.orderBy(F.desc("score"), "path", "at")).alias("rank"))
