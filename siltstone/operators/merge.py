"""Newest entry per key: the one rule behind reads, scans and compaction (O-C1..O-C4).

An aggregate instead of a merge of sorted runs: ``max_by`` has a partial step before
the shuffle, so a key that holds a large share of all entries costs one row per
task.  Filters on the key pass below the aggregate; filters on op or value must
stay above it, or deleted keys would come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.schema import DELETE, PUT
from siltstone.sources.workspace import ship


def newest(entries: DataFrame, order: tuple[str, ...] = ("recency", "seq")) -> DataFrame:
    """The newest entry of each key, tombstones included; columns as they were."""
    rest = [c for c in entries.columns if c != "key"]
    winner = F.max_by(F.struct(*rest), F.struct(*order)).alias("winner")
    return entries.groupBy("key").agg(winner).select("key", *[F.col(f"winner.{c}").alias(c) for c in rest]).select(*entries.columns)


def live(merged: DataFrame) -> DataFrame:
    """Entries of a merged table that are not deleted."""
    return merged.where(F.col("op") == PUT)


def merge(entries: DataFrame, drop_tombstones: bool, order: tuple[str, ...] = ("recency", "seq")) -> DataFrame:
    """Compaction merge: one entry per key, with or without tombstones."""
    merged = newest(entries, order)
    return live(merged) if drop_tombstones else merged


def per_generation(entries: DataFrame, generation: str = "gen") -> DataFrame:
    """The last entry of each key within each generation (flush dedupe, O-M3, O-M8)."""
    rest = [c for c in entries.columns if c not in (generation, "key")]
    last = F.max_by(F.struct(*rest), "seq").alias("last")
    return entries.groupBy(generation, "key").agg(last).select(generation, "key", *[F.col(f"last.{c}").alias(c) for c in rest])


def shadowed(entries: DataFrame) -> DataFrame:
    """How many older versions of each key a full compaction removes."""
    return entries.groupBy("key").agg((F.count("*") - 1).alias("shadowed"))


def buried(entries: DataFrame, generation: str = "gen") -> DataFrame:
    """Keys whose newest entry is a tombstone above an older live entry (O-C7): those
    that would come back if the tombstone were dropped too early."""
    last = per_generation(entries, generation)
    return (
        last.groupBy("key")
        .agg(F.max_by("op", generation).alias("op"), F.max((F.col("op") == PUT).cast("int")).alias("older_put"))
        .where((F.col("op") == DELETE) & (F.col("older_put") == 1))
        .select("key")
    )


def memtable_bytes(entries: DataFrame, overhead: int = 48) -> DataFrame:
    """Approximate size of each generation's writes: every write counts (O-M6)."""
    return entries.groupBy("gen").agg(F.sum(entry_bytes(overhead)).alias("size_bytes"))


def entry_bytes(overhead: int = 48):
    return (F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + F.lit(overhead)).cast("long")


def flush_boundaries(entries: DataFrame, threshold: int, block: int = 100_000) -> DataFrame:
    """seq, running_bytes and flush_no of every write (O-M9).

    A flush takes all writes since the last one as soon as they come to ``threshold`` bytes,
    and counting starts at zero behind it.  Writes are worked on in blocks of ``block``
    sequence numbers: a table per block says, for any number of bytes that is carried
    into it, what is carried out and how many flushes there are (at most an entry for
    each write up to the threshold).  The tables are composed in order, a row a block, and
    then each block numbers its own writes.
    """
    ship(entries.sparkSession)
    sized = entries.select("seq", entry_bytes().alias("size")).withColumn("block", F.floor(F.col("seq") / F.lit(block)).cast("long"))
    tables = sized.groupBy("block").applyInPandas(_flush_table(threshold), "block long, total long, reach array<long>, left array<long>, flushes array<long>")
    starts = tables.repartition(1).sortWithinPartitions("block").mapInPandas(_composed(threshold), "block long, carried long, bytes_before long, flushes_before long")
    return sized.join(starts, "block").groupBy("block").applyInPandas(_numbered(threshold), "seq long, running_bytes long, flush_no long")


def _flush_chain(sums: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a flush behind each write: the write of the next flush, and by the end of the
    block the bytes that are left and the number of further flushes."""
    n = len(sums)
    following = np.searchsorted(sums, sums + threshold, "left")
    left, more = sums[-1] - sums, np.zeros(n, np.int64)
    for i in range(n - 1, -1, -1):
        if following[i] < n:
            left[i], more[i] = left[following[i]], more[following[i]] + 1
    return following, left, more


def _flush_table(threshold: int):
    def table(rows: pd.DataFrame) -> pd.DataFrame:
        sums = rows.sort_values("seq")["size"].to_numpy().cumsum()
        _, left, more = _flush_chain(sums, threshold)
        first = min(len(sums), int(np.searchsorted(sums, threshold, "left")) + 1)
        return pd.DataFrame({
            "block": [rows["block"].iloc[0]], "total": [sums[-1]], "reach": [sums[:first].tolist()], "left": [left[:first].tolist()], "flushes": [(more[:first] + 1).tolist()],
        })

    return table


def _composed(threshold: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried = total = flushes = 0
        for part in parts:
            out = []
            for row in part.itertuples():
                out.append((row.block, carried, total, flushes))
                at = int(np.searchsorted(row.reach, threshold - carried, "left"))
                if at < len(row.reach):
                    carried, flushes = int(row.left[at]), flushes + int(row.flushes[at])
                else:
                    carried += int(row.total)
                total += int(row.total)
            yield pd.DataFrame(out, columns=["block", "carried", "bytes_before", "flushes_before"])

    return run


def _numbered(threshold: int):
    def number(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        sums = rows["size"].to_numpy().cumsum()
        following, _, _ = _flush_chain(sums, threshold)
        ends, at = np.zeros(len(sums), np.int64), int(np.searchsorted(sums, threshold - int(rows["carried"].iloc[0]), "left"))
        while at < len(sums):
            ends[at] = 1  # the last write of a flush
            at = int(following[at])
        flush_no = ends.cumsum() - ends + int(rows["flushes_before"].iloc[0])
        return pd.DataFrame({"seq": rows["seq"], "running_bytes": sums + int(rows["bytes_before"].iloc[0]), "flush_no": flush_no})

    return number
