"""Generators of keys and values for loads and benchmarks (O-E5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: odd multiplier that scatters sequential numbers.
SCATTER = 2654435761


def sequential_key(i: Column) -> Column:
    return F.format_string("key-%010d", i)


def scattered_key(i: Column, total: int) -> Column:
    return F.format_string("key-%010d", F.pmod(i * F.lit(SCATTER), F.lit(total)))


def value_of_size(size: int) -> str:
    """a to z, repeated."""
    return "".join(chr(ord("a") + i % 26) for i in range(size))


def pairs(spark: SparkSession, n: int, size: int = 100, scattered: bool = False) -> DataFrame:
    """``n`` rows (key, value, seq)."""
    i = F.col("id")
    key = scattered_key(i, n) if scattered else sequential_key(i)
    return spark.range(n).select(key.cast("binary").alias("key"), F.lit(value_of_size(size)).cast("binary").alias("value"), i.alias("seq"))
