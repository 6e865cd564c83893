"""Corpus cleaning in five stages over ``documents``: language, lines, near copies, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import common, langid, line_dedup, packing, pii, simhash
from corvane.llm.queries import tokenizer_files

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if no language reaches this mean probability over its positions.
LEAST_SCORE = 0.35


def _as_documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with ``n_chars`` of the text as it is now."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter (null and empty ones too) or without a likely language."""
    told = langid.identify(docs, langid.fit(docs))
    return told.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop repeated lines. A document that had text and has lost all of it goes."""
    kept = line_dedup.line_dedup(docs).where((F.col("lines_dropped") == 0) | (F.length(F.trim("text")) > 0))
    return _as_documents(kept)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group of near copies: five-word shingles, Jaccard
    similarity of 0.8 or more. Rows go by id and text, so of rows that share an id only near copies
    go; of rows that repeat both, one stays."""
    keys = ["_k1", "_k2"]
    told = common.materialize(simhash.near_copies(docs, words=5, jaccard=0.8))
    gone = told.where("NOT stays").select(*keys).distinct()
    keyed = docs.select(*COLUMNS, *common.row_key(docs))
    kept = keyed.join(common.bounded(gone, gone.count(), common.BROADCAST_IDS // 2), keys, "left_anti")
    twice = common.materialize(told.where("stays").groupBy(*keys).count().where("count > 1").select(*keys))
    if n := twice.count():
        # Only rows that repeat meet; no other text is shuffled.
        few = common.bounded(twice, n, common.BROADCAST_IDS // 2)
        kept = kept.join(few, keys, "left_anti").unionByName(kept.join(few, keys, "left_semi").dropDuplicates(keys))
    return kept.select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and the terms that disclose it; all documents stay."""
    return _as_documents(pii.sanitise(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, *tokenizer_files(), size=2048)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("personal_data", personal_data), ("pack", pack)]

#: SQL cannot run the network, MinHash or XXH64; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = set(common.stored(spark))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir))
        # What the stage stored on its way, and the input it has read, are done with.
        common.discard(spark, [p for p in common.stored(spark) if p not in before and p != docs._corvane_path])
    return STAGES[-1][1](spark, docs, sf_dir)
