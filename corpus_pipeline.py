"""Cleaning of a training corpus: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept; :func:`run` writes each result as Parquet in the shared folder and reads it
again as the next stage's docs.  All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, language_id, line_dedup, ngram_join, packing
from siltstone.llm.common import materialize

#: A text of which fewer n-grams than this share belong to its language is rejected.
LEAST_LANGUAGE_SCORE = 0.1


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter and a recognised language stay.

    Each row is judged by its own text, so ties, repeated rows and rows without a doc_id
    need nothing special; null and empty texts go.  Without labelled rows nothing is
    recognised and all documents go.
    """
    model = language_id.train(docs.where(~language_id.held_out()))
    return language_id.accepted(docs, model, LEAST_LANGUAGE_SCORE)


def line_deduped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and nearly equal lines the first by (doc_id, line number) stays.

    Documents of which no line is left go; null texts and texts of blank lines stay as they
    are.  Rows without a doc_id come first.  Rows that share a doc_id (or have none) and
    hold a line at the same place keep it all, and lose only lines of their own.
    """
    return line_dedup.dedup(docs)


def near_deduped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that with the smallest doc_id.

    Rows without a doc_id come last, and of rows that are equal in it any one stays.
    Null and empty texts are near duplicates of nothing and stay.
    """
    unique = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()
    # rows without an id that is theirs alone get numbers, which are fixed by writing them
    keyed = docs.withColumn("__key", F.col("doc_id").cast("long") if unique else F.monotonically_increasing_id())
    keyed = keyed if unique else materialize(keyed, "keyed-rows")
    found = ngram_join.join(keyed.select(F.col("__key").alias("doc_id"), "text"))
    found = materialize(found.select(F.col("doc_id").alias("__key"), F.col("component_id").alias("__first")), "near-duplicates")
    if not unique:
        rows = found.join(keyed.select("__key", "doc_id"), "__key")
        first = rows.groupBy("__first").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__key")).alias("least"))
        found = rows.join(materialize(first, "near-first"), "__first").select("__key", F.col("least.__key").alias("__first"))
    dropped = materialize(found.where("__key != __first").select("__key"), "near-dropped")
    return keyed.join(dropped, "__key", "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Each row is judged by its own text; null and empty texts stay, as do all rows where
    the benchmark is empty.
    """
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontaminate.clean(docs, benchmark)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens, with their ids.

    Null and empty texts are one end token; rows that repeat a doc_id, or have none, are
    documents of their own.
    """
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("language ID", identified),
    ("line dedup", line_deduped),
    ("n-gram Jaccard join", near_deduped),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the cleaned ``documents``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
