"""The queries of the training-data operators, and their SQL where there is any.

Every query applies its operator to its whole table with production parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, license_scan, line_dedup, ngram_join, packing, secret_scan, token_binary, vector_join, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~language_id.held_out()))
    return language_id.identify(docs, model).withColumn("held_out", language_id.held_out()).select("doc_id", "held_out", "lang_pred", "score")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.explode_outer("licenses").alias("l")).select("doc_id", "l.*")


def op4_vector_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.range_join(table(spark, sf_dir, "embeddings"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.find_lines(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_binary.read(token_binary.write(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read(warc.write(table(spark, sf_dir, "pages")))
    return found.where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    f.__name__: f
    for f in (op1_language_id, op2_packing, op3_license_scan, op4_vector_range_join, op5_decontaminate, op6_secret_scan, op7_line_dedup, op8_ngram_join, op9_token_binary, op10_warc)
}

ORACLE_SQL: dict[str, str] = {}
