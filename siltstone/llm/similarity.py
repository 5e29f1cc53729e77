"""Joins of token sets inside cells, by signature trees.

Shared by the n-gram join and the fuzzy line dedup.  A *cell* is a set of items
that have a key in common; items of one cell are compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LocalUnionFind, components, materialize, tidy


#: Rows of cells (about 40 bytes each) up to which they are broadcast to the sets,
#: which saves a shuffle of the sets.
BROADCAST_ROWS = 500_000


def least_overlap(n: np.ndarray | int, m: np.ndarray | int, percent: int):
    """Smallest intersection of sets of n and m tokens whose Jaccard similarity
    is at least percent / 100."""
    return -((n + m) * -percent // (100 + percent))


class SignatureTree:
    """A hierarchy over the token sets of one or many cells for joins by Jaccard similarity.

    Items are ordered by cell, then by size, then by signature.  A node of level 0 is
    an item; a node above holds the OR of its children's bitmaps, the ranges of
    their sizes and cells, and the largest number of tokens that share a bit with
    another of their set.
    """

    def __init__(self, sets: list[np.ndarray], bits: int, cells: np.ndarray | None = None, fan: int = 8):
        self.fan = fan
        sizes = np.array([len(s) for s in sets], np.int64)
        cells = np.zeros(len(sets), np.int64) if cells is None else cells
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        if sizes.sum():
            bit = np.concatenate(sets) & np.uint64(bits - 1)
            at = np.repeat(np.arange(len(sets)) * (bits // 64), sizes) + (bit >> np.uint64(6)).astype(np.int64)
            np.bitwise_or.at(maps.reshape(-1), at, np.uint64(1) << (bit & np.uint64(63)))
        self.order = np.lexsort((maps[:, 0], sizes, cells)) if len(sets) else np.zeros(0, np.int64)
        sizes, maps, cells = sizes[self.order], maps[self.order], cells[self.order]
        shared = sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        #: per level: bitmaps, smallest size, largest size, most shared tokens, first cell, last cell
        self.levels = [(maps, sizes, sizes, shared, cells, cells)]
        while len(self.levels[-1][1]) > 1:
            maps, low, high, shared, first, last = self.levels[-1]
            at = np.arange(0, len(low), fan)
            self.levels.append((
                np.bitwise_or.reduceat(maps, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(shared, at),
                np.minimum.reduceat(first, at), np.maximum.reduceat(last, at),
            ))

    def candidates(self, other: "SignatureTree", percent: int, step: int = 16_384):
        """Pairs (item, other's item) that the bounds cannot rule out, in blocks.

        Both trees are descended together, level by level; a pair of nodes is
        dropped when even the largest possible overlap of members is too small, or
        when they have no cell in common.
        """
        top = max(len(self.levels), len(other.levels)) - 1
        waiting = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        same = other is self
        while waiting:
            level, a, b = waiting.pop()
            if len(a) > step:
                half = len(a) // 2
                waiting += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
                continue
            at_a, at_b = min(level, len(self.levels) - 1), min(level, len(other.levels) - 1)
            keep = self._possible(at_a, a, other, at_b, b, percent)
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if level == 0:
                yield self.order[a], other.order[b]
                continue
            a, b = self._children(at_a, level, a, b)
            b, a = other._children(at_b, level, b, a)
            if same:
                keep = (a < b) if level == 1 else (a <= b)
                a, b = a[keep], b[keep]
            waiting.append((level - 1, a, b))

    def _possible(self, at: int, a, other: "SignatureTree", at_b: int, b, percent: int) -> np.ndarray:
        maps_a, low_a, high_a, shared_a, first_a, last_a = (x[a] if x.ndim == 1 else x for x in self.levels[at])
        maps_b, low_b, high_b, shared_b, first_b, last_b = (x[b] if x.ndim == 1 else x for x in other.levels[at_b])
        fits = (100 * high_a >= percent * low_b) & (100 * high_b >= percent * low_a) & (high_a > 0) & (high_b > 0)
        fits &= (first_a <= last_b) & (first_b <= last_a)
        out = np.zeros(len(a), bool)
        for start in range(0, len(a), 4096):
            i = np.flatnonzero(fits[start : start + 4096]) + start
            common = np.bitwise_count(maps_a[a[i]] & maps_b[b[i]]).sum(axis=1, dtype=np.int64)
            most = np.minimum(common + np.minimum(shared_a[i], shared_b[i]), np.minimum(high_a[i], high_b[i]))
            out[i] = most >= least_overlap(np.maximum(low_a[i], 1), np.maximum(low_b[i], 1), percent)
        return out

    def _children(self, at: int, level: int, a, b):
        if at < level:  # this tree is lower: it waits
            return a, b
        below = len(self.levels[at - 1][1])
        child = (a[:, None] * self.fan + np.arange(self.fan)).ravel()
        b = np.repeat(b, self.fan)
        keep = child < below
        return child[keep], b[keep]


def linked_pairs(sets: list[np.ndarray], groups: list, percent: int, cells: np.ndarray | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join all items of different groups that are connected by pairs of
    one cell with similarity >= percent; ``cells``: the cell of each item, by default
    the same; ``side``: only pairs of items of both sides count.

    Pairs that are connected already are not compared.  The links of a component
    are returned as a star.
    """
    if len(sets) < 2:
        return []
    bits = 64
    longest = max(map(len, sets))
    while bits < min(4 * longest, 1 << 15):
        bits *= 2
    cells = np.zeros(len(sets), np.int64) if cells is None else cells
    label = np.unique(np.asarray(groups), return_inverse=True)[1]
    if side is None:
        tree = SignatureTree(sets, bits, cells)
        found, at = tree.candidates(tree, percent), (np.arange(len(sets)),) * 2
    else:
        at = np.flatnonzero(side), np.flatnonzero(~side)
        trees = [SignatureTree([sets[i] for i in x], bits, cells[x]) for x in at]
        found = trees[0].candidates(trees[1], percent) if all(map(len, at)) else ()
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, starts = ranks(np.concatenate(sets)), np.cumsum(sizes) - sizes
    out = []
    for a, b in found:
        a, b = at[0][a], at[1][b]
        for step in range(0, len(a), 256):
            i, j = a[step : step + 256], b[step : step + 256]
            open_ = (label[i] != label[j]) & (cells[i] == cells[j])
            i, j = i[open_], j[open_]
            good = similar_pairs(flat, starts, sizes, i, j, percent)
            for x, y in zip(i[good].tolist(), j[good].tolist(), strict=True):
                if label[x] != label[y]:
                    label[label == label[y]] = label[x]
                    out.append((x, y))
    star = LocalUnionFind(len(sets))
    for i, j in out:
        star.union(i, j)
    return [(star.find(i), i) for i in sorted({x for pair in out for x in pair}) if star.find(i) != i]


def ranks(tokens: np.ndarray) -> np.ndarray:
    """Tokens numbered by value: equal numbers for equal tokens, below 2 ** 32."""
    return np.unique(tokens, return_inverse=True)[1].astype(np.uint64)


def similar_pairs(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int, step: int = 1 << 19) -> np.ndarray:
    """For each pair of sets (runs of distinct :func:`ranks` in ``flat``) whether it has
    100 * intersection >= percent * union, exactly."""
    common = np.zeros(len(a), np.int64)
    both = sizes[a] + sizes[b]
    ends = np.cumsum(both)
    start = 0
    while start < len(a):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + step, "right")))
        which = np.concatenate((a[start:stop], b[start:stop]))
        counts = sizes[which]
        at = np.repeat(starts[which] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        pair = np.repeat(np.tile(np.arange(stop - start, dtype=np.uint64), 2), counts)
        mixed = np.sort(pair << np.uint64(32) | flat[at])
        equal = mixed[1:][mixed[1:] == mixed[:-1]] >> np.uint64(32)
        common[start:stop] = np.bincount(equal.astype(np.int64), minlength=stop - start)
        start = stop
    return (common > 0) & (100 * common >= percent * (both - common))


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets of distinct tokens have 100 * intersection >= percent * union."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(x) + len(y) - common)


def with_component(items: DataFrame, found: DataFrame, item: str = "id") -> DataFrame:
    """Add ``comp``: the component of an item, itself where it has no edge."""
    known = found.select(F.col("id").alias(item), F.col("component_id"))
    return items.join(known, item, "left").withColumn("comp", F.coalesce("component_id", item)).drop("component_id")


def read_tokens(data: list[bytes]) -> list[np.ndarray]:
    """Sets as they are stored: sorted hashes, little-endian."""
    return [np.frombuffer(t, "<u8") for t in data]


def cell_links(
    cells: DataFrame, sets: DataFrame, percent: int, *, whole: bool, block_rows: int = 512, read: Callable[[list[bytes]], list[np.ndarray]] = read_tokens
) -> DataFrame:
    """Links (src, dst) between items of different components that share a cell.

    ``cells``: key, id, comp; ``sets``: id, tokens (what ``read`` makes sorted
    sets of).  Cells whose items are all in one component are left out.  A cell is dealt by
    hash of the id into blocks of about ``block_rows``.  With ``whole`` every pair
    of blocks is a unit, so all pairs of the cell are covered; without, each block
    is joined within itself and with the cell's smallest id, which is linear in
    the cell (a first round: what it leaves apart has to be covered by another).
    A task joins the units of its partition, small ones many at a time.
    """
    dealt = (
        cells.groupBy("key")
        .agg(F.count("*").alias("m"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("id").alias("leader"))
        .where("low != high")
        .select("key", "leader", F.ceil(F.col("m") / F.lit(block_rows)).cast("int").alias("blocks"))
    )
    dealt = materialize(dealt, "cells")
    own = F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")).cast("int")
    placed = cells.join(dealt, "key").withColumn("own", own)
    if whole:
        unit = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
        every = F.sequence(F.lit(0), F.col("blocks") - 1)
        units: Column = F.transform(every, lambda k: unit(F.least(k, F.col("own")), F.greatest(k, F.col("own"))))
    else:
        units = F.transform(
            F.when(F.col("id") == F.col("leader"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own")),
            lambda k: F.struct(k.cast("int").alias("a"), k.cast("int").alias("b")),
        )
    placed = placed.select("key", "id", "comp", "own", F.explode(units).alias("unit"))
    # a unit is named by a hash; should two have the same, more pairs are compared
    name = F.xxhash64("key", "unit.a", "unit.b").alias("unit")
    side = F.when(F.col("unit.a") == F.col("unit.b"), F.lit(0)).when(F.col("own") == F.col("unit.a"), F.lit(1)).otherwise(F.lit(2)).cast("int").alias("side")
    placed = materialize(placed.select("id", "comp", name, side), "cell-blocks")
    small = placed.count() <= BROADCAST_ROWS
    work = sets.select("id", "tokens").join(F.broadcast(placed) if small else placed, "id").select("unit", "side", "id", "comp", "tokens")
    work = work.repartition("unit").sortWithinPartitions("unit")
    return materialize(work.mapInArrow(tidy(_joined(percent, block_rows, read)), "src long, dst long"), "cell-links")


def _joined(percent: int, block_rows: int, read: Callable[[list[bytes]], list[np.ndarray]]):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def links(rows: list[pa.RecordBatch]) -> Iterator:
            """Of whole units; those of one side (0) together, others each on its own."""
            table = pa.Table.from_batches(rows)
            unit, side, ids, comp = (table.column(i).to_numpy() for i in range(4))
            single = np.flatnonzero(side == 0)
            two = np.flatnonzero(side != 0)
            cuts = np.flatnonzero(unit[two][1:] != unit[two][:-1]) + 1
            for own in [x for x in (single, *np.split(two, cuts)) if len(x) > 1]:
                sets = read(table.column(4).take(pa.array(own)).to_pylist())
                apart = None if side[own[0]] == 0 else side[own] == 1
                pairs = linked_pairs(sets, comp[own], percent, unit[own], apart)
                if pairs:
                    i, j = own[np.array(pairs).T]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], ["src", "dst"])

        waiting: list[pa.RecordBatch] = []
        held = size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = batch.column(0).to_numpy()
            cut = int(np.flatnonzero(unit != unit[-1])[-1]) + 1 if unit[0] != unit[-1] else 0
            if waiting and waiting[-1].column(0)[-1].as_py() != unit[0]:  # the last unit is whole
                if held >= 2 * block_rows or size > 8 << 20:
                    yield from links(waiting)
                    waiting, held, size = [], 0, 0
            if cut and (held + cut >= 2 * block_rows or size + batch.nbytes > 8 << 20):
                yield from links([*waiting, batch.slice(0, cut)])
                waiting, held, size = [], 0, 0
                batch = batch.slice(cut)
            waiting.append(batch)
            held, size = held + batch.num_rows, size + batch.nbytes
        if waiting:
            yield from links(waiting)

    return run


def merged_cells(cells: DataFrame, most: int = 2048) -> DataFrame:
    """Cells (key, id, comp) with fewer rows that still bring together all items
    which share one.

    Cells that have items in common form a group; a group of at most ``most`` items
    becomes one cell, so an item is in one cell and not in many.  Items of a larger
    group stay in their own cells.
    """
    leaders = materialize(cells.groupBy("key").agg(F.min("id").alias("leader"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high"), "cell-leaders")
    cells = materialize(cells.join(leaders.select("key", "leader"), "key"), "open-cells")
    group = components(cells.select(F.col("id").alias("src"), F.col("leader").alias("dst")))
    group = with_component(cells.select("id").distinct(), group).withColumnRenamed("comp", "group")
    sizes = group.groupBy("group").agg(F.count("*").alias("size"))
    small = materialize(group.join(sizes.where(F.col("size") <= most), "group").select("id", "group"), "cell-groups")
    named = lambda kind, key: F.struct(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("key")).alias("key")
    merged = cells.select("id", "comp").distinct().join(small, "id").select(named(0, "group"), "id", "comp")
    own = cells.join(small.select("id"), "id", "left_anti").select(named(1, "key"), "id", "comp")
    return materialize(merged.union(own), "merged-cells")


def united(edges: list[DataFrame]) -> DataFrame:
    """Components (id, component_id) of several tables of links."""
    out = edges[0]
    for e in edges[1:]:
        out = out.union(e)
    return components(out)
