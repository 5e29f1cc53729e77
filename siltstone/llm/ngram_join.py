"""Operator 8: exact n-gram Jaccard join with signature trees.

A document's set is its distinct ``k``-word shingles (64-bit hashes).  Two
documents link when their Jaccard similarity is at least ``percent`` / 100.

1. Equal sets are collapsed by a 128-bit digest; the smallest doc_id stands for them.
2. Filter, exact: in the order of hash values, two linked sets of n and m tokens
   share at least min(l(n), l(m)) tokens within their prefixes of
   n - ceil(0.8 n) + l(n) tokens, l(n) = max(1, n // 5).  Prefix tokens are dealt
   by hash into buckets, where it is counted for each set how many of its prefix
   tokens occur in another set.  A set with too few cannot have a link and leaves.
3. The remaining sets meet in cells of equal min-hash (``rounds`` rounds, linear in
   the cells) and are joined there by signature trees.
4. Completion, exact: remaining sets meet in the cells of their rarest tokens (see
   ``_completion``); cells inside one component are dropped, overlapping ones are
   merged, and all pairs are covered by signature trees, block by block.

In the trees, nodes hold OR-combined token bitmaps and size ranges, and a dual
traversal drops pairs of nodes by their largest possible overlap; what is left is
compared exactly.  No link between different components is lost by any step.

Null and empty texts have an empty set and link with nothing.  Repeated rows are
equal sets; rows that share a doc_id but not a text count as one document.  Other columns are ignored.  Documents with fewer than ``k`` words are
one shingle.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, materialize, shingle_set, ship, text_bytes, tidy
from .similarity import cell_links, merged_cells, united, with_component

#: Rows up to which the ids of remaining documents are broadcast (8 bytes each).
BROADCAST_IDS = 500_000

#: Digests (16 bytes each) that a task remembers, so that equal sets are dealt once.
SEEN_SETS = 250_000

#: Owner of a token that several sets of a batch hold; no digest starts with it.
SHARED = np.uint64(0)


def counted_prefix(n: int, percent: int) -> int:
    """Size of the prefix whose tokens are counted: n - ceil(0.8 n) + l(n)."""
    return n + (-n * percent // 100) + max(1, n // 5)


def _shingles(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n, digest and the counted prefix of every document."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, digest, prefix = [], [], []
                for text in part.column(1).to_pylist():
                    tokens = shingle_set(text.lower().split(), k, hashes)
                    n.append(len(tokens))
                    digest.append(xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None)
                    prefix.append(tokens[: counted_prefix(len(tokens), percent)].tobytes() if len(tokens) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(prefix, pa.binary())], ["doc_id", "n", "digest", "prefix"]
                )

    rows = docs.select(F.col("doc_id").cast("long"), text_bytes())
    return rows.mapInArrow(tidy(run), "doc_id long, n long, digest binary, prefix binary")


def _common_counts(sets: DataFrame, bucket_bits: int) -> DataFrame:
    """(owner, common): how many prefix tokens of a set occur in another set.

    A row of the shuffle holds the tokens of many sets for one bucket; sets are
    named by the first eight bytes of their digest.  Tokens that several sets of a
    batch hold are counted there, and of each the bucket gets one entry, owned by
    ``SHARED``, so a token of all documents costs an entry a batch.  Equal sets of
    several tasks are counted in each: ``common`` may be too large, never too small.
    """
    shift = np.uint64(64 - bucket_bits)
    kinds = {"bucket": "int32", "tokens": "binary", "owners": "binary", "counts": "binary"}

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                own = dict(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))  # equal sets once
                own = {d: p for d, p in own.items() if d not in seen}
                if len(seen) > SEEN_SETS:
                    seen.clear()
                seen.update(own)
                tokens = [np.frombuffer(p, "<u8") for p in own.values()]
                if not tokens:
                    continue
                owner = np.repeat(np.frombuffer(b"".join(d[:8] for d in own), "<u8"), [len(t) for t in tokens])
                tokens = np.concatenate(tokens)
                order = np.argsort(tokens, kind="stable")
                tokens, owner = tokens[order], owner[order]
                same = tokens[1:] == tokens[:-1]
                several = np.concatenate(([False], same)) | np.concatenate((same, [False]))
                first = np.concatenate(([True], ~same))
                found, counts = np.unique(owner[several], return_counts=True)
                tokens, owner = tokens[first], np.where(several, SHARED, owner)[first]
                bucket = tokens >> shift
                cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
                low = (tokens >> (shift - np.uint64(32))).astype("<u4")  # the 32 bits below those of the bucket
                rows = [(int(bucket[a]), low[a:b].tobytes(), owner[a:b].tobytes(), b"") for a, b in zip(cut[:-1], cut[1:], strict=True)]
                if len(found):
                    rows.append((int(found[0] >> shift), b"", found.tobytes(), counts.astype("<i8").tobytes()))
                columns = zip(zip(*rows, strict=True), kinds.values(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.type_for_alias(t)) for c, t in columns], list(kinds))

    def count(block):
        import pandas as pd

        known = block["counts"].str.len() > 0  # what batches have counted
        block, known = block[~known], block[known]
        tokens = np.frombuffer(b"".join(block["tokens"]), "<u4")
        owners = np.frombuffer(b"".join(block["owners"]), "<u8")
        order = np.lexsort((owners, tokens))
        tokens, owners = tokens[order], owners[order]
        again = (tokens[1:] == tokens[:-1]) & (owners[1:] == owners[:-1])
        first = np.concatenate((np.ones(min(1, len(tokens)), bool), ~again))
        tokens, owners = tokens[first], owners[first]  # a set that came in several rows counts once
        same = tokens[1:] == tokens[:-1]
        edge = np.zeros(min(1, len(tokens)), bool)
        shared = (np.concatenate((edge, same)) | np.concatenate((same, edge))) & (owners != SHARED)
        found, counts = np.unique(owners[shared], return_counts=True)
        found = np.concatenate((found, np.frombuffer(b"".join(known["owners"]), "<u8")))
        counts = np.concatenate((counts, np.frombuffer(b"".join(known["counts"]), "<i8")))
        return pd.DataFrame({"owner": found.astype(np.int64), "common": counts.astype(np.int64)})

    dealt = sets.select("digest", "prefix").mapInArrow(tidy(deal), "bucket int, tokens binary, owners binary, counts binary")
    counted = dealt.groupBy("bucket").applyInPandas(count, "owner long, common long")
    return counted.groupBy("owner").agg(F.sum("common").alias("common"))


def _full_sets(docs: DataFrame, ids: DataFrame, n_ids: int, k: int) -> DataFrame:
    """id, n, tokens and two min-hashes of the documents named by ``ids``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hashes = WordHashes()
        odd = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n, tokens, least = [], [], []
                for text in part.column(1).to_pylist():
                    found = shingle_set(text.lower().split(), k, hashes)
                    n.append(len(found))
                    tokens.append(found.astype("<u8").tobytes())
                    mixed = [(found ^ (found >> np.uint64(23))) * o for o in odd]
                    least.append([int(m.min().astype(np.int64)) for m in mixed])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(tokens, pa.binary()), pa.array(least, pa.list_(pa.int64()))], ["id", "n", "tokens", "least"]
                )

    ids = F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_bytes().alias("text")).join(ids, "id", "left_semi")
    return rows.mapInArrow(tidy(run), "id long, n long, tokens binary, least array<long>")


def join(docs: DataFrame, *, k: int = 5, percent: int = 80, rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    spark = docs.sparkSession
    ship(spark)
    sets = materialize(_shingles(docs, k, percent), "shingles")
    used = sets.where("n > 0")
    reps = materialize(used.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n")), "set-reps")
    total = reps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(6, int(np.ceil(np.log2(max(1, total // 2_000_000)))))
    common = _common_counts(used, bits)
    # conv() turns the first eight bytes (little-endian there) into the owner's number
    owner = F.expr("conv(substr(hex(reverse_bytes), 1, 16), 16, -10)")
    slim = reps.withColumn("reverse_bytes", F.concat(*[F.substring("digest", i, 1) for i in range(8, 0, -1)]))
    slim = slim.select("rep", "n", owner.cast("long").alias("owner"))
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) / 5))  # l(m) of the smallest set that can link
    left = materialize(slim.join(common, "owner").where(F.col("common") >= least).select(F.col("rep").alias("id")), "linkable")
    items = materialize(_full_sets(docs, left, left.count(), k), "token-sets")
    edges = []
    found = None
    for r in range(rounds):
        cells = items.select(F.col("least")[r].alias("key"), "id")
        cells = with_component(cells, found) if found is not None else cells.withColumn("comp", F.col("id"))
        edges.append(cell_links(cells, items, percent, whole=False))
        found = united(edges)
    edges.append(_completion(items, found, percent))
    found = united(edges)
    known = materialize(with_component(reps.select("digest", F.col("rep").alias("id")), found), "set-components")
    out = sets.select("doc_id", "n", "digest").join(known.select("digest", "comp"), "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"))


def _completion(items: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links between components, exactly.

    Tokens are ordered by the number of sets that hold them, those that occur in
    one component only first.  Linked sets of different components share all
    tokens of their intersection across components, so a set with fewer than
    ceil(0.8 n) such tokens has no link, and otherwise the least common token of a
    linked pair is among the first n - ceil(0.8 n) + 1 tokens of both.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                tokens = [np.frombuffer(t, "<i8") for t in part.column(2).to_pylist()]
                which = pa.array(np.repeat(np.arange(part.num_rows), [len(t) for t in tokens]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens)), *(part.column(i).take(which) for i in range(2))], ["key", "id", "comp"]
                )

    rows = with_component(items.select("id", "tokens"), found).select("id", "comp", "tokens")
    keys = materialize(rows.mapInArrow(tidy(run), "key long, id long, comp long"), "tokens")
    mixed = keys.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("df"))
    keys = materialize(keys.join(materialize(mixed.where("low != high").select("key", "df"), "mixed-tokens"), "key"), "crossing-tokens")
    least = F.ceil(F.col("n") * percent / 100)
    slots = keys.groupBy("id").agg(F.count("*").alias("common")).join(items.select("id", "n").distinct(), "id").where(F.col("common") >= least).select("id", (F.col("common") - least + 1).alias("slots"))
    keys = keys.join(materialize(slots, "crossing-sets"), "id")
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "key"))
    cells = keys.withColumn("place", place).where("place <= slots").select("key", "id", "comp")
    return cell_links(merged_cells(materialize(cells, "prefix-cells")), items, percent, whole=True)


def brute_force(texts: dict[int, str | None], k: int = 5, percent: int = 80) -> dict[int, tuple[int, int]]:
    """{doc_id: (n_shingles, component_id)} by all pairs (for tests)."""
    import re

    sets = {}
    for i, text in texts.items():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))} if words else set()
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    listed = sorted(texts)
    for a in listed:
        for b in listed:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}
