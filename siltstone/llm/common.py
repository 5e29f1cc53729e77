"""Shared plumbing of the training-data operators.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir`` (see ``siltstone.sources.workspace``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources import workspace
from siltstone.sources.workspace import materialize, work_path

__all__ = ["materialize", "work_path"]  # besides what is defined here


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, and bound Arrow batches where the
    session allows larger ones."""
    for name, most in BATCH_LIMITS.items():
        now = spark.conf.get(name).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))
    workspace.ship(spark)


#: Bounds of an Arrow batch, so that long texts do not add up in a Python worker.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def tidy(run: Callable, keeps: bool = False) -> Callable:
    """``run`` for mapInArrow, after which a worker gives free memory back.  Unless it
    ``keeps`` an object between tasks itself, it lets go of another operator's."""

    def tidied(batches: Iterator) -> Iterator:
        if not keeps:
            _KEPT.clear()
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def give_back() -> None:
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


_KEPT: dict = {}


def kept(key, make: Callable):
    """The worker's object for ``key``; it stays between tasks until another is asked
    for, so that operators' memories do not add up."""
    if key not in _KEPT:
        _KEPT.clear()
        give_back()
        _KEPT[key] = make()
    return _KEPT[key]


def text_bytes(column: str | Column = "text") -> Column:
    """UTF-8 bytes of a string column; null counts as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def where_text(docs: DataFrame, make: Callable[[], Callable[[list], list[bool]]], rows: int = 256, keeps: bool = False) -> DataFrame:
    """The rows whose text is good; columns as they were.  ``make`` runs in a worker and
    gives a function from UTF-8 texts (or None) to what is good.  Whole rows pass through
    Arrow, so nothing waits in the executor for an answer."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        good = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                kept_rows = part.filter(pa.array(good(part.column(at).cast(pa.binary()).to_pylist()), pa.bool_()))
                if kept_rows.num_rows:
                    yield kept_rows

    return docs.mapInArrow(tidy(run, keeps), docs.schema)


def filesystem(uri: str):
    """pyarrow file system and path of a URI (file, hdfs, s3, ...) or local path."""
    from pyarrow import fs

    if "://" not in uri:
        if uri.startswith("file:"):
            uri = "file://" + uri[len("file:") :]
        else:
            return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


#: Odd 64-bit multipliers of the shingle hash (any odd numbers do).
_MIX = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63],
    dtype=np.uint64,
)


class WordHashes(dict):
    """64-bit hash of a word, remembered for up to ``limit`` words."""

    def __init__(self, limit: int = 250_000):
        import xxhash

        super().__init__()
        self._hash = xxhash.xxh3_64_intdigest
        self._limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self._limit:
            self.clear()
        value = self[word] = self._hash(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word hashes, in order of position."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n] * _MIX[0]
    for i in range(1, k):
        out = (out ^ (out >> np.uint64(29))) * _MIX[i % 5] + words[i : i + n]
    out ^= out >> np.uint64(32)
    out *= _MIX[3]
    out ^= out >> np.uint64(29)
    return out


def shingle_set(words: list[bytes], k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; a shorter text that
    has words is one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    found = hashes.of(words)
    return np.unique(window_hashes(found, min(k, len(words))))


class LocalUnionFind:
    """Union-find over 0..n-1 within one task."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find of the edges of a task: each end with the smallest end of its component."""
    ids, place = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    parent = np.arange(len(ids))
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    child = np.flatnonzero(parent != np.arange(len(ids)))
    return ids[child], ids[parent[child]]


#: Edges (16 bytes each) that a task contracts at once.
TASK_EDGES = 1 << 18


def _contracted(edges: DataFrame) -> tuple[DataFrame, bool]:
    """Written edges (u, v) with those that meet in a task contracted to stars, and
    whether one task has had them all; what is connected stays so."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def stars(parts: list) -> pa.RecordBatch:
            u, v = (np.concatenate([p.column(i).to_numpy() for p in parts]) for i in range(2))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in contracted(u, v)], ["u", "v"])

        parts, held = [], 0
        for batch in batches:
            parts.append(batch)
            held += batch.num_rows
            if held >= 2 * TASK_EDGES:
                yield stars(parts)
                parts, held = [], 0
        if held:
            yield stars(parts)

    tasks = max(1, -(-edges.count() // TASK_EDGES))
    return materialize(edges.coalesce(tasks).mapInArrow(run, "u long, v long"), "stars"), tasks == 1


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Distributed union-find: (id, component_id) of every id with an edge.

    ``edges`` has two long columns, src and dst; loops and repeats are fine.
    Tasks contract about ``TASK_EDGES`` edges each to stars on their own.  Where that
    leaves more than stars, large-star and small-star steps alternate until every id points
    to the smallest id of its component.  Each step aggregates a minimum per id (with
    partial aggregation) and joins it back from written tables, so adaptive
    execution can split the neighbours of a hot id over many tasks.
    """
    ends = [f("src", "dst").cast("long").alias(name) for f, name in ((F.greatest, "u"), (F.least, "v"))]
    current = materialize(edges.where("src is not null and dst is not null and src != dst").select(*ends).distinct(), "edges")
    for _ in range(max_rounds):
        current, done = _contracted(current)
        if done or _are_stars(current):
            break
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "large-star")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u != v").distinct(), "large-edges")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "small-star")
        joined = large.join(least, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v")))
        current = materialize(small.distinct(), "edges")
    else:
        raise RuntimeError(f"no components after {max_rounds} rounds")
    # in stars an id with an edge has one, and no root has any
    roots = current.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component_id"))
    return materialize(current.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(roots), "components")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every id is either a root or has one edge, which leads to a root."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("end"))
    per_id = ends.groupBy("end.id").agg(F.sum("end.up").alias("up"), F.max("end.down").alias("down"))
    return per_id.where("up > 1 or (up > 0 and down > 0)").isEmpty()
