"""Operator 7: fuzzy line dedup by MinHash.

Lines are compared without case and with runs of white space as one space; the
set of a line is its runs of ``k`` characters (the whole line if it is shorter).
Lines whose sets have a Jaccard similarity of at least ``percent`` / 100 link, and
of each component of links one line stays: the first by (doc_id, line number).

1. Every distinct line of a task gets ``bands`` keys of ``band_rows`` min-hashes
   each (16 bands of 4: a pair at similarity 0.8 meets with probability 0.9998).
   The keys are dealt by hash into buckets, many to a row of the shuffle, and only
   keys that several lines share come out.
2. Lines that share a key are verified with the exact similarity: first each line
   with the smallest of its key (linear), then, where a key's lines are still in
   different components, all pairs, block by block behind signature trees.
3. Distributed union-find gives the components.

Equal lines are grouped by a 128-bit digest with partial aggregation, so a line
that is in a third of all documents costs a task no more than its own rows.

Blank lines are never duplicates.  A null text has no lines and stays null.  Rows
that repeat a doc_id count as one document (their lines have equal places), and so
do rows without one; :func:`dedup` takes a line only from rows that have it there.
Documents of which no line stays are dropped.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, ship, text_bytes, tidy
from .similarity import cell_links, merged_cells, ranks, similar_pairs, with_component

#: Wanted lines (about 40 bytes each) up to which they are broadcast.
BROADCAST_LINES = 500_000
#: Stands for a null doc_id inside the operator.
NULL_ID = -(1 << 63)
#: Lines that a task remembers in order not to hash them again.
SEEN = 200_000


def plain(line: str) -> str:
    low = line.lower()
    if low.isprintable() and "  " not in low and low[:1] != " " and low[-1:] != " ":  # no white space but single spaces inside
        return low
    return " ".join(low.split())


def line_key(line: str) -> bytes:
    """128-bit digest of a plain line."""
    import xxhash

    return xxhash.xxh3_128_digest(line.encode())


def short_key(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def run_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` code points, combined from runs of half the length."""
    if k == 1:
        out = points * np.uint64(0x9E3779B97F4A7C15)
        return out ^ (out >> np.uint64(29))
    half, n = run_hashes(points, k // 2), len(points) - k + 1
    out = half[:n] * np.uint64(0xC2B2AE3D27D4EB4F) + half[k // 2 : k // 2 + n]
    if k % 2:
        out = out * np.uint64(0x165667B19E3779F9) + points[k - 1 :]
    return out ^ (out >> np.uint64(31))


def char_tokens(lines: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character runs of all (non-empty) lines, and the line of each.

    Each line is followed by ``k`` - 1 marks; a line of fewer than ``k`` characters
    is one run with marks, any other has the runs inside it.
    """
    mark = "\U0010ffff" * (k - 1)
    points = np.frombuffer((mark.join(lines) + mark).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    lengths = np.array([len(x) for x in lines], np.int64)
    out = run_hashes(points, k) * np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xA0761D6478BD642F)
    counts = np.maximum(lengths - k + 1, 1)
    starts = np.concatenate(([0], np.cumsum(lengths + k - 1)[:-1]))
    line = np.repeat(np.arange(len(lines)), counts)
    at = np.arange(len(line)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    return out[at], line


def token_rows(lines: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens (52 bits) of all lines, by line, and the number of them for each."""
    flat, sizes, start = [], [], 0
    while start < len(lines):
        stop, size = start, 0
        while stop < len(lines) and (size == 0 or size + len(lines[stop]) <= 100_000) and stop - start < 1 << 12:
            size += len(lines[stop])
            stop += 1
        tokens, line = char_tokens(lines[start:stop], k)
        mixed = np.sort(line.astype(np.uint64) << np.uint64(52) | tokens >> np.uint64(12))
        mixed = mixed[np.concatenate(([True], mixed[1:] != mixed[:-1]))]
        flat.append(mixed & np.uint64((1 << 52) - 1))
        sizes.append(np.bincount((mixed >> np.uint64(52)).astype(np.int64), minlength=stop - start))
        start = stop
    return (np.concatenate(flat), np.concatenate(sizes)) if flat else (np.empty(0, np.uint64), np.empty(0, np.int64))


def char_sets(lines: list[str], k: int) -> list[np.ndarray]:
    """The sorted tokens of each line."""
    flat, sizes = token_rows(lines, k)
    return np.split(flat, np.cumsum(sizes)[:-1])


def char_set(line: str, k: int) -> np.ndarray:
    return char_sets([line], k)[0]


#: Sets of fewer tokens than the second number are hashed ``bands * band_rows`` times,
#: sets of at least as many as the first once, in as many bins.  The ranges overlap by
#: the largest ratio of sizes of linked sets, so linked sets always meet in one of them.
SMALL, LARGE = 100, 160


def band_keys(lines: list[str], k: int, bands: int, band_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, number of the line of each): hashes of the bands' min-hashes."""
    keys, owners, start = [], [], 0
    while start < len(lines):
        stop, size = start, 0
        while stop < len(lines) and (size == 0 or size + len(lines[stop]) <= 100_000) and stop - start < 1 << 16:
            size += len(lines[stop])
            stop += 1
        tokens, line = char_tokens(lines[start:stop], k)
        ordered = np.sort(line.astype(np.uint64) << np.uint64(47) | tokens >> np.uint64(17))
        ordered = ordered[np.concatenate(([True], ordered[1:] != ordered[:-1]))]
        line = (ordered >> np.uint64(47)).astype(np.int64)
        counts = np.bincount(line, minlength=stop - start)
        for signatures, own in ((_many_hashes, counts < LARGE), (_one_hash, counts >= SMALL)):
            which = np.flatnonzero(own)
            if len(which):
                found = signatures(ordered[own[line]], counts[which], bands * band_rows)
                keys.append(_banded(found, bands).ravel())
                owners.append(np.repeat(which + start, bands))
        start = stop
    return np.concatenate(keys), np.concatenate(owners)


def _many_hashes(ordered: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """[line, n] min-hashes by n hash functions of 32 bits."""
    starts = np.cumsum(counts) - counts
    tokens = (ordered >> np.uint64(15)).astype(np.uint32)  # the upper 32 of a token's 47 bits
    out = np.empty((n, len(counts)), np.uint32)
    mixed = np.empty_like(tokens)
    for i in range(n):
        np.bitwise_xor(tokens, np.uint32(0x9E3779B9 * (i + 1) & 0xFFFFFFFF), out=mixed)
        mixed *= np.uint32((0x85EBCA6B + 0xC2B2AE36 * i) & 0xFFFFFFFF | 1)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        np.minimum.reduceat(mixed, starts, out=out[i])
    return out.T.astype(np.uint64)


def _one_hash(ordered: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """[line, n] minima of one hash in n bins; an empty bin takes the next bin's
    minimum and its distance (densification by rotation)."""
    line = np.repeat(np.arange(len(counts)), counts)
    value = ordered & np.uint64((1 << 47) - 1)
    slot = (value * np.uint64(n)) >> np.uint64(47) if n <= 1 << 16 else value % np.uint64(n)
    place = line * n + slot.astype(np.int64)  # ascending, as the values of a line are
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    out = np.zeros(len(counts) * n, np.uint64)
    filled = np.zeros(len(counts) * n, bool)
    out[place[first]], filled[place[first]] = value[first], True
    out, filled = out.reshape(-1, n), filled.reshape(-1, n)
    at = np.where(filled, np.arange(n), 4 * n)
    ahead = np.minimum.accumulate(np.concatenate((at, at + n), axis=1)[:, ::-1], axis=1)[:, ::-1][:, :n]
    return np.take_along_axis(out, ahead % n, axis=1) + (ahead - np.arange(n)).astype(np.uint64) * np.uint64(0x165667B19E3779F9)


def _banded(signature: np.ndarray, bands: int) -> np.ndarray:
    """[line, band] keys; a band takes rows that lie far apart."""
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), bands))
    for row in range(signature.shape[1] // bands):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + signature[:, row * bands : (row + 1) * bands]
    key = key ^ (key >> np.uint64(32))
    return key * np.uint64(0xD6E8FEB86659FD93)


def _lines(docs: DataFrame, k: int, bands: int, band_rows: int, bucket_bits: int) -> DataFrame:
    """Two kinds of rows: a place (doc_id, line_no, line) for each line that is
    not blank, and for a bucket the band keys and short keys of many lines."""
    shift = np.uint64(64 - bucket_bits)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
        names = ["doc_id", "line_no", "line", "bucket", "keys", "owners"]

        def packed(columns: list) -> pa.RecordBatch:
            n = max(len(c) for c in columns if c is not None)
            return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        def dealt(fresh: dict[bytes, str]) -> pa.RecordBatch:
            keys, owner = band_keys(list(fresh.values()), k, bands, band_rows)
            owner = np.frombuffer(b"".join(x[:8] for x in fresh), "<u8")[owner]
            order = np.argsort(keys >> shift, kind="stable")
            keys, owner = keys[order], owner[order]
            bucket = keys >> shift
            cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
            low = (keys >> (shift - np.uint64(32))).astype("<u4")
            spans = list(zip(cut[:-1], cut[1:], strict=True))
            return packed([None, None, None, [int(bucket[a]) for a, _ in spans], [low[a:b].tobytes() for a, b in spans], [owner[a:b].tobytes() for a, b in spans]])

        seen: set[bytes] = set()
        fresh: dict[bytes, str] = {}
        size = 0
        for batch in batches:
            doc_ids, line_nos, lines = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for number, line in enumerate(text.decode("utf-8", "replace").split("\n")):
                    line = plain(line)
                    if line:
                        key = line_key(line)
                        doc_ids.append(doc_id)
                        line_nos.append(number)
                        lines.append(key)
                        if key not in seen:
                            seen.add(key)
                            fresh[key] = line
                            size += len(line)
                if len(lines) > 50_000:
                    yield packed([doc_ids, line_nos, lines, None, None, None])
                    doc_ids, line_nos, lines = [], [], []
                if size > 4_000_000:
                    yield dealt(fresh)
                    fresh, size = {}, 0
                    if len(seen) > SEEN:
                        seen.clear()
            if lines:
                yield packed([doc_ids, line_nos, lines, None, None, None])
        if fresh:
            yield dealt(fresh)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), text_bytes())
    return rows.mapInArrow(tidy(run), "doc_id long, line_no int, line binary, bucket int, keys binary, owners binary")


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Whether a sorted key is there more than once."""
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[1:] == keys[:-1]
    return same[1:] | same[:-1]


def _shared_keys(dealt: DataFrame) -> DataFrame:
    """(key, id) of all keys that several lines have."""

    def shared(block):
        import pandas as pd

        keys = np.frombuffer(b"".join(block["keys"]), "<u4")
        owners = np.frombuffer(b"".join(block["owners"]), "<u8")
        # key and place fit one word
        mixed = np.sort(keys.astype(np.uint64) << np.uint64(32) | np.arange(len(keys), dtype=np.uint64))
        keys, place = mixed >> np.uint64(32), (mixed & np.uint64(0xFFFFFFFF)).astype(np.int64)
        several = _repeated(keys)
        keys, owners = keys[several], owners[place[several]]
        order = np.lexsort((owners, keys))
        keys, owners = keys[order], owners[order]
        first = np.ones(len(keys), bool)
        first[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
        keys, owners = keys[first], owners[first]
        several = _repeated(keys)
        bucket = int(block["bucket"].iloc[0])
        return pd.DataFrame({"key": (bucket << 32) | keys[several].astype(np.int64), "id": owners[several].astype(np.int64)})

    return dealt.groupBy("bucket").applyInPandas(shared, "key long, id long")


def _line_texts(docs: DataFrame, places: DataFrame, n_lines: int) -> DataFrame:
    """(id, tokens) of the lines that ``places`` (doc_id, wanted: line_no and id)
    names; ``tokens`` is the plain line, of which the set is made where it is used."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, found, size = [], [], 0
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = text.decode("utf-8", "replace").split("\n")
                for x in wanted:
                    line = plain(lines[x["line_no"]]) if x["line_no"] < len(lines) else ""
                    if line and short_key(line_key(line)) == x["id"]:
                        ids.append(x["id"])
                        found.append(line.encode())
                        size += len(found[-1])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["id", "tokens"])
                    ids, found, size = [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["id", "tokens"])

    places = F.broadcast(places) if n_lines <= BROADCAST_LINES else places
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), text_bytes().alias("text"))
    return rows.join(places, "doc_id").select("text", "wanted").mapInArrow(tidy(run), "id long, tokens binary")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (src, dst) whose sets are similar."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                left, right = part.column(2).to_pylist(), part.column(3).to_pylist()
                number = {line: i for i, line in enumerate(dict.fromkeys(left + right))}
                tokens, sizes = token_rows([line.decode() for line in number], k)
                a, b = (np.array([number[x] for x in side], np.int64) for side in (left, right))
                good = similar_pairs(ranks(tokens), np.cumsum(sizes) - sizes, sizes, a, b, percent)
                keep = part.filter(pa.array(good))
                yield pa.RecordBatch.from_arrays([keep.column(0), keep.column(1)], ["src", "dst"])

    side = lambda name, tokens: texts.select(F.col("id").alias(name), F.col("tokens").alias(tokens))
    both = pairs.join(side("dst", "y"), "dst").join(side("src", "x"), "src")
    return both.select("src", "dst", "x", "y").mapInArrow(tidy(run), "src long, dst long")


def find_lines(docs: DataFrame, *, k: int = 7, percent: int = 80, bands: int = 16, band_rows: int = 4) -> DataFrame:
    """A row per line that is not blank: doc_id, line_no, kept, and the place
    (keeper_doc_id, keeper_line_no) of the line that stays for its component."""
    return _found(docs, k, percent, bands, band_rows).drop("line")


def _found(docs: DataFrame, k: int = 7, percent: int = 80, bands: int = 16, band_rows: int = 4) -> DataFrame:
    """The rows of :func:`find_lines` with the digest of each line."""
    spark = docs.sparkSession
    ship(spark)
    bits = max(6, int(np.ceil(np.log2(max(1, docs.count() * 10 * bands / 2_000_000)))))
    found = materialize(_lines(docs, k, bands, band_rows, bits), "lines")
    lines = found.where("bucket is null").select("doc_id", "line_no", "line")
    shared = materialize(_shared_keys(found.where("bucket is not null").select("bucket", "keys", "owners")), "shared-bands")
    place = F.expr("cast(cast(doc_id as decimal(20,0)) * 2147483648 + line_no as decimal(38,0))")  # in the order of (doc_id, line_no)
    line_of = lambda c: F.pmod(F.col(c), F.lit(1 << 31)).cast("int")
    doc_of = lambda c: ((F.col(c) - F.pmod(F.col(c), F.lit(1 << 31))) / F.lit(1 << 31)).cast("long")
    short = F.conv(F.hex(F.concat(*[F.substring("line", i, 1) for i in range(8, 0, -1)])), 16, -10).cast("long")
    distinct = materialize(lines.groupBy("line").agg(F.min(place).alias("first"), F.count("*").alias("n")).withColumn("id", short), "distinct-lines")
    wanted = distinct.join(shared.select("id").distinct(), "id", "left_semi").select(doc_of("first").alias("doc_id"), line_of("first").alias("line_no"), "id")
    n_wanted = F.count("*").alias("n_wanted")
    wanted = materialize(wanted.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "id")).alias("wanted"), n_wanted), "wanted-lines")
    n_wanted = wanted.agg(F.coalesce(F.sum("n_wanted"), F.lit(0))).first()[0]
    texts = materialize(_line_texts(docs, wanted.drop("n_wanted"), n_wanted), "line-texts")
    leaders = materialize(shared.groupBy("key").agg(F.min("id").alias("src"), F.count("*").alias("m")), "band-leaders")
    pairs = shared.join(leaders, "key").where("id != src").select("src", F.col("id").alias("dst")).distinct()
    links = materialize(_verified(materialize(pairs, "line-pairs"), texts, k, percent), "line-links")
    groups = components(links)
    larger = shared.join(leaders.where("m > 2").select("key"), "key", "left_semi")
    read = lambda lines: char_sets([x.decode() for x in lines], k)
    rest = cell_links(merged_cells(materialize(with_component(larger, groups), "line-cells")), texts, percent, whole=True, read=read)
    if not rest.isEmpty():
        groups = components(links.union(rest))
    repeated = with_component(distinct.select("line", "id", "first", "n"), groups)
    keeper = repeated.where("n > 1 or comp != id").select("comp").union(groups.select(F.col("component_id").alias("comp"))).distinct()
    repeated = materialize(repeated.join(keeper, "comp", "left_semi"), "repeated-lines")
    keeper = materialize(repeated.groupBy("comp").agg(F.min("first").alias("keeper")), "kept-lines")
    known = repeated.join(keeper, "comp").select("line", doc_of("keeper").alias("keeper_doc_id"), line_of("keeper").alias("keeper_line_no"))
    out = lines.join(materialize(known, "line-keepers"), "line", "left")
    out = out.withColumns({c: F.coalesce(c, c.removeprefix("keeper_")) for c in ("keeper_doc_id", "keeper_line_no")})
    shown = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    out = out.select("doc_id", "line_no", "line", "keeper_doc_id", "keeper_line_no")
    kept = (F.col("doc_id") == F.col("keeper_doc_id")) & (F.col("line_no") == F.col("keeper_line_no"))
    return out.withColumn("kept", kept).withColumn("doc_id", shown("doc_id")).withColumn("keeper_doc_id", shown("keeper_doc_id"))


def dedup(docs: DataFrame, **options) -> DataFrame:
    """The documents without the lines that others stand for; columns as they were
    (``n_chars``, where there is one, is counted anew)."""
    dropped = _found(docs, **options).where("not kept").select("doc_id", "line_no", F.substring("line", 1, 8).alias("line"))
    dropped = dropped.groupBy(F.coalesce("doc_id", F.lit(NULL_ID)).alias("__dropped_of")).agg(F.collect_set(F.struct("line_no", "line")).alias("__dropped_lines"))
    dropped = materialize(dropped, "dropped-lines")

    joined = docs.join(dropped, F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)) == dropped["__dropped_of"], "left")
    joined = joined.select(*[docs[c] for c in docs.columns], "__dropped_lines")
    return joined.mapInArrow(tidy(_without(docs.columns)), docs.schema)


def _without(columns: list[str]):
    """Rows (the last column: what is dropped) without dropped lines, or None where no line is left."""
    at, size_at = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None

    def without(text: str, dropped: list[dict]) -> str | None:
        # rows that share a doc_id (or have none) have other lines at these places
        numbers = {x["line_no"] for x in dropped}
        named = {(x["line_no"], x["line"]) for x in dropped}
        lines = text.split("\n")
        left = [x for i, x in enumerate(lines) if i not in numbers or (i, line_key(plain(x))[:8]) not in named]
        if len(left) == len(lines):
            return text
        return "\n".join(left) if any(x.strip() for x in left) else None

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            plain_rows, dropped = list(batch.columns[:-1]), batch.column(batch.num_columns - 1)
            touched = pc.and_(dropped.is_valid(), plain_rows[at].is_valid())
            where = pc.indices_nonzero(touched)
            if len(where):
                pairs = zip(plain_rows[at].take(where).to_pylist(), dropped.take(where).to_pylist(), strict=True)
                texts = [without(t, d) for t, d in pairs]
                plain_rows[at] = pc.replace_with_mask(plain_rows[at], touched, pa.array(texts, plain_rows[at].type))
                if size_at is not None:
                    sizes = pa.array([len(t or "") for t in texts], pa.int64()).cast(plain_rows[size_at].type)
                    plain_rows[size_at] = pc.replace_with_mask(plain_rows[size_at], touched, sizes)
            out = pa.RecordBatch.from_arrays(plain_rows, columns)
            if len(where):
                out = out.filter(pc.or_(pc.invert(touched), plain_rows[at].is_valid()))
            yield out

    return run


def brute_force(texts: dict[int, str | None], k: int = 7, percent: int = 80) -> dict[tuple[int, int], tuple[int, int]]:
    """{(doc_id, line number): place of the kept line} by all pairs (for tests)."""
    places = [((d, i), plain(x)) for d, t in texts.items() if t is not None for i, x in enumerate(t.split("\n")) if plain(x)]
    sets = [{x[j : j + k] for j in range(max(1, len(x) - k + 1))} for _, x in places]
    root = list(range(len(places)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(places)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                root[find(a)] = find(b)
    least: dict[int, tuple[int, int]] = {}
    for i, (place, _) in enumerate(places):
        r = find(i)
        least[r] = min(least.get(r, place), place)
    return {place: least[find(i)] for i, (place, _) in enumerate(places)}
