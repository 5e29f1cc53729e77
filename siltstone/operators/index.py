"""Sparse index of sorted units (O-R7, O-R8): the first key of every run of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.sources.workspace import materialize

#: Fixed value: entries in an indexed run.
RUN_ENTRIES = 64


def _ranged(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with the number ``part`` of their key range, which is fixed by writing it."""
    return materialize(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "key-ranges")


def build(entries: DataFrame, unit: tuple[str, ...] = ("gen",), run: int = RUN_ENTRIES) -> DataFrame:
    """unit columns, chunk, first_key and n_entries.

    A unit is what is sorted as a whole: a generation or a file.  Keys are ranked within
    ranges, and the sizes of the ranges before (a row each) are added, so no task
    ranks a whole unit.
    """
    rows = _ranged(entries.select(*unit, "key"), *unit, "key")
    before = Window.partitionBy(*unit).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*unit, "part").agg(F.count("*").alias("n"))
    sizes = sizes.select(*unit, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy(*unit, "part").orderBy("key")) - 1
    rows = rows.withColumn("place", place).join(sizes, [*unit, "part"])
    chunk = F.floor((F.col("place") + F.col("before")) / F.lit(run)).cast("int")
    return rows.withColumn("chunk", chunk).groupBy(*unit, "chunk").agg(F.min("key").alias("first_key"), F.count("*").alias("n_entries"))


def search(index: DataFrame, key, unit: tuple[str, ...] = ("gen",)) -> DataFrame:
    """For each unit the run that may hold ``key``: the last with first_key <= key."""
    return index.where(F.col("first_key") <= F.lit(key)).groupBy(*unit).agg(F.max("chunk").alias("chunk"))


def search_many(index: DataFrame, probes: DataFrame, unit: tuple[str, ...] = ("gen",)) -> DataFrame:
    """(probe key, unit columns, chunk) for a table of distinct probe keys.

    Probes are listed once for each unit, as the result is.  Probes and first keys are put
    in one order and cut into ranges; each probe takes the last chunk before it in
    its range, or else the last chunk of the ranges before (a row each).
    """
    units = index.select(F.struct(*unit).alias("u")).distinct().agg(F.collect_list("u")).scalar()  # generations or files: few
    asked = probes.select(F.col("key").alias("at")).distinct().select("at", F.explode(units).alias("u")).select("u.*", "at")
    rows = index.select(*unit, F.col("first_key").alias("at"), "chunk", F.lit(0).alias("probe"))
    rows = _ranged(rows.unionByName(asked.withColumns({"chunk": F.lit(None).cast("int"), "probe": F.lit(1)})), *unit, "at", "probe")
    earlier = Window.partitionBy(*unit).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.groupBy(*unit, "part").agg(F.max("chunk").alias("last"))
    last = last.select(*unit, "part", F.max("last").over(earlier).alias("before"))
    within = Window.partitionBy(*unit, "part").orderBy("at", "probe").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("seen", F.max("chunk").over(within)).where("probe = 1").join(last, [*unit, "part"])
    found = F.coalesce("seen", "before")
    return rows.select(F.col("at").alias("key"), *unit, found.alias("chunk")).where("chunk is not null")
