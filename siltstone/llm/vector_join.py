"""Operator 4: exact metric range join of embeddings.

Two vectors link when their labels are equal and their cosine is at least
``threshold``.  On unit vectors that is a Euclidean distance of at most
eps = sqrt(2 - 2 * threshold).  Pivots (a hash sample of the label's vectors: one for
every 64 of them up to ``least_pivots``, and one for every ``cell_rows`` beyond)
part the vectors of a label into cells by the nearest pivot.  By the triangle
inequality a vector x of cell i can only link with a vector of cell j if its
distance from the plane between the pivots, (d(x,pj)^2 - d(x,pi)^2) / (2 d(pi,pj)),
is at most eps; then x is replicated into cell j (towards the smaller cell number
only, so a pair is met once) and the cells join independently.  The pivots are
broadcast; should all labels ask for more than ``max_pivots``, each gets its share.

A cell's rows are split by hash into blocks of about ``block_rows`` and a task
compares one pair of blocks with a matrix product, so neither a hot label nor a
hot cell lands in one task.  A task returns, for each vector that has links, the
number of its links and the smallest member of its component within the task;
pairs are never emitted.  Equal vectors are collapsed before and expanded after.

In spaces of high dimension the bound prunes little (uniform vectors go to most
cells); the result stays exact, the work is then close to all blocks.
:func:`cell_report` counts what is replicated and which pairs are left out.

Null labels, null or empty vectors, zero vectors and vectors with null or
non-finite components link with nothing; vectors of different sizes do not link.
Repeated rows count as vectors of their own, also under one vec_id, which then
names each of them.  Vectors of any length are fine; other columns, also of
clashing names, are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, ship, tidy


def _unit(raw: list[bytes]) -> np.ndarray:
    rows = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    return rows / np.linalg.norm(rows / np.abs(rows).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(rows).max(axis=1, keepdims=True)


def _raw_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label and vec: little-endian doubles, null for what links with nothing."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for label, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                good = label is not None and v and None not in v
                v = np.array(v, "<f8") if good else None
                out.append(v.tobytes() if good and np.isfinite(v).all() and v.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "vec"])

    # adding 0.0 makes -0.0 and 0.0 equal
    doubles = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), doubles.alias("v"))
    return slim.mapInArrow(tidy(run), "vec_id long, label string, vec binary")


def _distinct_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows (vec_id, label, vec), and the distinct vectors of a label with a ``node`` number."""
    rows = _raw_vectors(vectors)
    reps = rows.where("vec is not null").groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    # the number is fixed by writing it
    return rows, materialize(reps.withColumn("key", F.md5("vec")).withColumn("node", F.monotonically_increasing_id()), "vectors")


def _pivots(reps: DataFrame, cell_rows: int, least_pivots: int, max_pivots: int) -> dict[tuple[str, int], np.ndarray]:
    """Pivots by label and size of vector: about ``max_pivots`` at most."""
    wanted = reps.groupBy("label", F.octet_length("vec").alias("size")).agg(F.count("*").alias("in_label"))
    number = F.greatest(F.least(F.floor(F.col("in_label") / 64), F.lit(least_pivots)), F.floor(F.col("in_label") / F.lit(cell_rows)))
    wanted = materialize(wanted.withColumn("wanted", number).where(F.col("wanted") > 1), "label-counts")
    total = wanted.agg(F.coalesce(F.sum("wanted"), F.lit(0))).first()[0]
    scale = min(1.0, max_pivots / max(1, total))
    hashed = F.pmod(F.xxhash64("key", F.lit("pivot")), F.lit(1 << 30))
    chosen = reps.withColumn("size", F.octet_length("vec")).join(wanted, ["label", "size"])
    chosen = chosen.where(hashed < F.col("wanted") / F.col("in_label") * F.lit(scale * (1 << 30))).select("label", "size", "vec")
    found: dict[tuple[str, int], list[bytes]] = {}
    for r in chosen.collect():  # about max_pivots rows at most
        found.setdefault((r["label"], r["size"]), []).append(bytes(r["vec"]))
    return {k: _unit(sorted(v)) for k, v in found.items() if len(v) > 1}


def cell_report(vectors: DataFrame, *, threshold: float = 0.98, cell_rows: int = 8192, least_pivots: int = 8, max_pivots: int = 16_384) -> DataFrame:
    """label, size, cell, homes, guests (replicated vectors) and compared (pairs of
    distinct vectors) of each cell; all other pairs of the label are pruned."""
    ship(vectors.sparkSession)
    _, reps = _distinct_vectors(vectors)
    copies = _in_cells(reps, _pivots(reps, cell_rows, least_pivots, max_pivots), _reach(threshold))
    homes, guests = F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("guests")
    return copies.groupBy("label", "size", "cell").agg(homes, guests).withColumn("compared", F.expr("homes * (homes - 1) div 2 + homes * guests"))


def _reach(threshold: float) -> float:
    return float(np.sqrt(2 - 2 * threshold)) + 1e-9


def range_join(
    vectors: DataFrame,
    *,
    threshold: float = 0.98,
    cell_rows: int = 8192,
    block_rows: int = 2048,
    least_pivots: int = 8,
    max_pivots: int = 16_384,
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding, label)."""
    ship(vectors.sparkSession)
    rows, reps = _distinct_vectors(vectors)
    copies = _in_cells(reps, _pivots(reps, cell_rows, least_pivots, max_pivots), _reach(threshold))
    cell = ["label", "size", "cell"]
    sizes = copies.groupBy(*cell).agg(F.sum(F.col("home").cast("int")).alias("homes"), F.sum((~F.col("home")).cast("int")).alias("guests"))
    blocks = lambda c: F.ceil(F.col(c) / F.lit(block_rows)).cast("int")
    sizes = materialize(sizes.select(*cell, F.greatest(blocks("homes"), F.lit(1)).alias("nh"), blocks("guests").alias("ng")), "cell-sizes")
    placed = copies.join(sizes, cell)
    own = F.pmod(F.xxhash64("key"), F.when(F.col("home"), F.col("nh")).otherwise(F.col("ng"))).cast("int")
    placed = placed.withColumn("own", own)
    unit = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    as_home = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("own")), lambda a: unit(a, F.col("own"))),
        F.filter(F.transform(F.sequence(F.col("own"), F.col("nh") + F.col("ng")), lambda b: unit(F.col("own"), b)), lambda u: (u["b"] > u["a"]) & (u["b"] < F.col("nh") + F.col("ng"))),
    )
    as_guest = F.transform(F.sequence(F.lit(0), F.col("nh") - 1), lambda a: unit(a, F.col("nh") + F.col("own")))
    placed = placed.withColumn("unit", F.explode(F.when(F.col("home"), as_home).otherwise(as_guest)))
    left = F.when(F.col("home"), F.col("own") == F.col("unit.a")).otherwise(F.lit(False))
    work = placed.select(*cell, F.col("unit.a").alias("a"), F.col("unit.b").alias("b"), left.alias("left"), "node", "n", "vec")
    found = materialize(
        work.groupBy(*cell, "a", "b").applyInPandas(_joined(threshold), "node long, links long, root long"), "vector-links"
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    known = reps.select("label", "key", "rep", "n", "node").join(links, "node", "left").join(roots.withColumnRenamed("id", "node"), "node", "left")
    known = materialize(known.select("label", "key", "rep", "n", "links", F.col("component_id").alias("root")), "linked-vectors")
    least = known.where("root is not null").groupBy("root").agg(F.min("rep").alias("component_id"))
    known = known.join(materialize(least, "vector-components"), "root", "left")
    slim = rows.select("vec_id", "label", F.md5("vec").alias("key"))
    out = slim.join(known, ["label", "key"], "left")
    return out.select(
        "vec_id",
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("n") - 1, F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("component_id", "rep", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _in_cells(reps: DataFrame, pivots: dict, eps: float) -> DataFrame:
    """Every vector in its home cell, and replicated where it can have links."""
    shared = reps.sparkSession.sparkContext.broadcast(pivots)  # bounded by max_pivots
    schema = "label string, size int, cell int, home boolean, node long, n long, key string, vec binary"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pivots = shared.value
        most = max(map(len, pivots.values()), default=1)
        step = max(1, min(512, (1 << 20) // most))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                label, vec = part.column(0).to_pylist(), part.column(3).to_pylist()
                groups: dict[tuple[str, int], list[int]] = {}
                for i, (name, v) in enumerate(zip(label, vec, strict=True)):
                    groups.setdefault((name, len(v)), []).append(i)
                take, cells, home = [], [], []
                for k, members in groups.items():
                    members = np.array(members)
                    if k not in pivots:
                        take.append(members)
                        cells.append(np.zeros(len(members), np.int32))
                        home.append(np.ones(len(members), bool))
                        continue
                    near = _unit([vec[i] for i in members]) @ pivots[k].T
                    best = near.argmax(axis=1)
                    gap = near.max(axis=1, keepdims=True) - near
                    between = np.sqrt(np.maximum(0, 2 - 2 * pivots[k][best] @ pivots[k].T))
                    reach = gap <= eps * between + 1e-9
                    reach &= np.arange(near.shape[1]) <= best[:, None]
                    row, cell = np.nonzero(reach)
                    take.append(members[row])
                    cells.append(cell.astype(np.int32))
                    home.append(cell == best[row])
                take, cells, home = np.concatenate(take), np.concatenate(cells), np.concatenate(home)
                for b in range(0, len(take), 4096):
                    some = pa.array(take[b : b + 4096])
                    picked = part.take(some)
                    yield pa.RecordBatch.from_arrays(
                        [picked.column(0), pa.array([len(vec[i]) for i in take[b : b + 4096]], pa.int32()), pa.array(cells[b : b + 4096]), pa.array(home[b : b + 4096]),
                         picked.column(1), picked.column(2), picked.column(4), picked.column(3)],
                        ["label", "size", "cell", "home", "node", "n", "key", "vec"],
                    )

    return reps.select("label", "node", "n", "vec", "key").mapInArrow(tidy(run), schema)


def _joined(threshold: float):
    def join(block):
        import pandas as pd

        left = block["left"].to_numpy()
        same = bool(left.all())  # a block against itself
        a = block[left]
        b = a if same else block[~left]
        empty = pd.DataFrame({"node": np.empty(0, np.int64), "links": np.empty(0, np.int64), "root": np.empty(0, np.int64)})
        if not len(a) or not len(b) or int(block["a"].iloc[0]) != int(block["b"].iloc[0]) and same:
            return empty
        linked = _unit(a["vec"].tolist()) @ _unit(b["vec"].tolist()).T >= threshold
        if same:
            np.fill_diagonal(linked, False)
        if not linked.any():
            return empty
        rep_a, rep_b = a["node"].to_numpy(), b["node"].to_numpy()
        root_a, root_b = _roots(linked, rep_a, rep_b, same)
        rows = [(rep_a, linked @ b["n"].to_numpy(), root_a)]
        if not same:
            rows.append((rep_b, linked.T @ a["n"].to_numpy(), root_b))
        out = pd.concat([pd.DataFrame({"node": r, "links": n, "root": t}) for r, n, t in rows])
        return out[out["links"] > 0]

    return join


def _roots(linked: np.ndarray, rep_a: np.ndarray, rep_b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Smallest node reachable within the block, by repeated minima."""
    most = np.iinfo(np.int64).max
    row, col = np.nonzero(linked)
    root_a, root_b = rep_a.copy(), rep_b.copy()
    while True:
        old = root_a.copy(), root_b.copy()
        low = np.full(len(root_a), most)
        np.minimum.at(low, row, root_b[col])
        root_a = np.minimum(root_a, low)
        if same:
            root_b = root_a
        low = np.full(len(root_b), most)
        np.minimum.at(low, col, root_a[row])
        root_b = np.minimum(root_b, low)
        if same:
            root_a = root_b
        if (root_a == old[0]).all() and (root_b == old[1]).all():
            return root_a, root_b


def brute_force(vec_ids: list[int], vectors: list, labels: list, threshold: float = 0.98) -> dict[int, tuple[int, int]]:
    """{vec_id: (n_links, component_id)} by all pairs (for tests)."""
    def usable(v, label):
        return label is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(vec_ids)
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if usable(vectors[i], labels[i]) and usable(vectors[j], labels[j]) and labels[i] == labels[j] and len(vectors[i]) == len(vectors[j]):
                x, y = np.array(vectors[i], float), np.array(vectors[j], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    a, b = find(i), find(j)
                    root[a] = b
    least: dict[int, int] = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), vec_ids[i]), vec_ids[i])
    return {vec_ids[i]: (links[i], least[find(i)]) for i in range(n)}
