"""Lookups and range scans over generations (O-R1..O-R10), as lazy DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.merge import live, newest
from siltstone.schema import DELETE


def in_range(start=None, end=None, key: str = "key") -> Column:
    """Inclusive key range; None is unbounded, an empty bound is a bound.  One key is an
    equality, for which the reader can use its bloom filters."""
    if start is not None and start == end:
        return F.col(key) == F.lit(start)
    found = F.lit(True)
    if start is not None:
        found = found & (F.col(key) >= F.lit(start))
    if end is not None:
        found = found & (F.col(key) <= F.lit(end))
    return found


def scan(entries: DataFrame, start=None, end=None, *, ordered: bool = False, limit: int | None = None, order=("recency", "seq")) -> DataFrame:
    """Live (key, value) pairs of a range (O-R4, O-R5, O-R9, O-T1, O-T2).

    The range reaches the Parquet scan.  ``ordered`` sorts at the edge; with a
    ``limit`` that is a top-k and not a sort of everything.
    """
    out = live(newest(entries.where(in_range(start, end)), order)).select("key", "value")
    if ordered or limit is not None:
        out = out.orderBy("key")
    return out if limit is None else out.limit(limit)


def entries_in_range(entries: DataFrame, start=None, end=None) -> DataFrame:
    """Entries of single generations in a range, tombstones included (O-S6, O-R6)."""
    return entries.where(in_range(start, end))


def point_get(entries: DataFrame, key, order=("recency", "seq")) -> DataFrame:
    """The value of one key: one row, or none if it is absent or deleted (O-R1, O-R2)."""
    return scan(entries, key, key, order=order)


def tri_state(probes: DataFrame, entries: DataFrame, order=("recency", "seq")) -> DataFrame:
    """key, exists_here, is_deleted and value for each probe (O-R3).

    Entries are first reduced to those of a probe, so what is aggregated and shuffled
    grows with the probes and not with the store.  Which side is broadcast, if any, is
    left to the optimizer, which knows the sizes.
    """
    asked = probes.select("key").distinct()
    found = newest(entries.join(asked, "key", "left_semi"), order).select("key", "op", "value")
    return asked.join(found, "key", "left").select(
        "key",
        F.col("op").isNotNull().alias("exists_here"),
        F.coalesce(F.col("op") == DELETE, F.lit(False)).alias("is_deleted"),
        "value",
    )


def multi_get(probes: DataFrame, entries: DataFrame, order=("recency", "seq")) -> DataFrame:
    """(key, value) of the probes that are present."""
    return live(newest(entries.join(probes.select("key").distinct(), "key", "left_semi"), order)).select("key", "value")
