"""Immutable generations on Parquet (O-S4..O-S8, O-S10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.schema import DELETE, ENTRY


def write(entries: DataFrame, path: str, files: int | None = None, codec: str = "zstd") -> None:
    """Write entries as key-sorted files of disjoint key ranges.

    Sorted files give narrow min/max statistics, so range reads skip files and row
    groups; the Parquet bloom filter on the key serves point reads.
    """
    ranged = entries.select(*ENTRY.names)
    ranged = ranged.repartitionByRange(files, "key") if files else ranged.repartitionByRange("key")
    (
        ranged.sortWithinPartitions("key")
        .write.option("compression", codec)
        .option("parquet.bloom.filter.enabled#key", "true")
        .parquet(path)
    )


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All entries of the generations, tombstones included."""
    if not paths:
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).parquet(*paths)


def summary(spark: SparkSession, path: str) -> dict:
    """rows, tombstones and key range of a written generation."""
    row = (
        read(spark, [path])
        .agg(
            F.count("*").alias("rows"),
            F.coalesce(F.sum((F.col("op") == DELETE).cast("long")), F.lit(0)).alias("tombstones"),
            F.hex(F.min("key")).alias("min_key"),
            F.hex(F.max("key")).alias("max_key"),
        )
        .first()
    )
    return row.asDict()


def scanned_rows(df: DataFrame) -> int:
    """Rows that the scans of a DataFrame without exchanges gave when it last ran: what
    key ranges, statistics and bloom filters could not rule out (O-B7)."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    found = [leaves.apply(i).metrics().get("numOutputRows") for i in range(leaves.size())]
    return sum(m.get().value() for m in found if m.isDefined())
