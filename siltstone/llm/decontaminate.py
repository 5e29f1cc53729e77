"""Operator 5: benchmark decontamination by template canonicalisation.

Texts are read as words without case and outer punctuation.  Numbers (also as words),
units and names (capitalised words, but not a function word that starts a sentence)
become typed placeholders, so that a question keeps its template when its parameters
are changed.  Windows of
``window`` template words of the benchmark items form a hash table; an item with
fewer words is one window.  The windows of all documents are looked up in it.
The table also has the windows in which names are plain words without case, as a
text in capitals, in title case or in small letters shows no names as such.

A run of names is one placeholder, and so is a number with its unit.

Hits of an item on one diagonal (place in the document minus place in the item)
or in order on neighbouring ones, as where words were put in or left out, are an
alignment.  Its slots are checked: the same value in the item must stand
for the same value in the document throughout, and the other way round; windows
with a slot that disagrees with the earlier ones do not count.  A document is
contaminated by an item if the counted windows of an alignment cover at least
``least_cover`` of the item's words and ``window`` words (or the whole item).
Windows with fewer literal words than ``least_literal`` hit only where every value
is equal, since a run of placeholders says nothing.  Items of fewer than five words
match where all their chunks, signs included, follow each other as they are (case and
outer punctuation apart); only items of one or two chunks are left out, since they
occur in texts that have nothing to do with them.

The benchmark is used in blocks of ``block_items`` items, each broadcast with a
bound of ``block_words`` words: the documents are read once for each block.
There is no shuffle of documents and no skew; memory is bounded by a block and
a batch of rows.

Null or empty documents and items never match.  Repeated documents are reported
as often as they occur, repeated items under each of their ids.  Of alignments that cover
equally many words the first counts.  Words of any length and texts of any size are fine,
other columns, also of clashing names, are ignored (and kept by :func:`clean`); an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, ship, text_bytes, tidy, where_text, window_hashes

#: Words that stand for units of measure.
UNITS = frozenset(
    "mm cm m km mg g kg t ml cl l kb mb gb tb hz khz mhz ghz w kw mwh kwh j kj cal kcal v a pa kpa bar n nm "
    "meter meters metre metres centimeter centimeters kilometer kilometers mile miles yard yards foot feet inch inches "
    "gram grams kilogram kilograms pound pounds ounce ounces ton tons liter liters litre litres gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent degree degrees °c °f % $ € £ m² m³ km² km/h mph m/s".split()
)
#: Numbers as words.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
)
#: Words that are no names at the start of a sentence.
FUNCTION_WORDS = frozenset(
    "a about after all an and any are as at be because before but by calculate can compute consider could determine did do does each every find "
    "for from given had has have he her here his how i if in is it its let many most my no not of on or our she should show so some solve suppose "
    "that the their then there these they this those to under until was we were what when where which while who whose why will with would you your".split()
)
_NUMBER = re.compile(r"[-+]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th)?%?")
_EDGE = re.compile(r"^[^\w$€£%°+-]+|[^\w%°²³]+$")

LITERAL, NUMBER, UNIT, NAME = range(4)


#: Bits beside the kind of a word: it starts with a capital, the next word starts a sentence,
#: it is no name where it starts a sentence itself.
CAPITAL, ENDS, COMMON = 4, 8, 16


def read_word(chunk: bytes, digest: Callable) -> tuple[int, int, int]:
    """(hash of the plain word, 0 for a chunk without one; kind and bits; hash of the plain
    word or of such a chunk)."""
    text = chunk.decode("utf-8", "replace")
    last = text[-1]
    body = text[:-1] if last == "." or last == "," else text
    if body.isalpha():  # by far the most
        lower = body.casefold()
        kind = UNIT if lower in UNITS else NUMBER if lower in NUMBER_WORDS else LITERAL
        flags = kind | (ENDS if last == "." else 0) | (CAPITAL if kind == LITERAL and body[0].isupper() else 0)
    else:
        flags = ENDS if text.rstrip("\"')]»”’")[-1:] in (".", "!", "?", ":", "…", ";") else 0
        plain = _EDGE.sub("", text)
        lower = plain.casefold()
        if not any(map(str.isalnum, plain)) and lower not in UNITS:
            return 0, flags, digest(text) | 1
        number = _NUMBER.fullmatch(lower) or all(x in NUMBER_WORDS for x in lower.split("-"))
        kind = NUMBER if number else UNIT if lower in UNITS else LITERAL
        flags |= kind | (CAPITAL if kind == LITERAL and plain[:1].isupper() else 0)
    value = digest(lower) | 1
    return value, flags | (COMMON if lower in FUNCTION_WORDS else 0), value


class TemplateReader:
    """Texts as (template, values, kinds, bounds, chunks).  A template slot is a literal word, a
    number with its unit, a unit, or a run of names; slot i has the words from bounds[i]
    to bounds[i + 1], of which values and kinds tell; chunks are all of them, signs too.

    Chunks are remembered, up to ``limit``, as numbers of rows in tables."""

    def __init__(self, limit: int = 200_000):
        import xxhash

        self.limit, self.digest = limit, xxhash.xxh3_64_intdigest
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.size = 0
        self.values = np.zeros(1 << 12, np.uint64)
        self.raw = np.zeros(1 << 12, np.uint64)
        self.flags = np.zeros(1 << 12, np.uint8)

    def _add(self, chunk: bytes) -> int:
        value, flags, raw = read_word(chunk, self.digest)
        if self.size == len(self.values):
            self.values, self.raw, self.flags = (np.resize(x, 2 * self.size) for x in (self.values, self.raw, self.flags))
        self.values[self.size], self.raw[self.size], self.flags[self.size] = value, raw, flags
        self.number[chunk] = self.size
        self.size += 1
        return self.size - 1

    def read(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        chunks = text.split()
        if self.size > self.limit:
            self._clear()
        rows = list(map(self.number.get, chunks))
        if None in rows:
            get, add = self.number.get, self._add
            rows = [r if r is not None else known if (known := get(c)) is not None else add(c) for r, c in zip(rows, chunks, strict=True)]
        rows = np.array(rows, np.int64)
        values, flags, raw = self.values[rows], self.flags[rows], self.raw[rows]
        starts = np.ones(len(flags), bool)
        starts[1:] = flags[:-1] & ENDS
        keep = values > 0
        # a chunk without a word passes a sentence start on
        if not keep.all():
            last = np.maximum.accumulate(np.where(keep, np.arange(len(keep)), -1))
            before = np.concatenate(([-1], last[:-1]))
            any_end = np.concatenate(([0], np.cumsum(flags & ENDS > 0)))
            starts = (before < 0) | (any_end[np.arange(len(keep))] - any_end[np.maximum(before, 0)] > 0)
        values, flags, starts = values[keep], flags[keep], starts[keep]
        kinds = flags & 3
        kinds = np.where((flags & CAPITAL > 0) & ~(starts & (flags & COMMON > 0)), NAME, kinds)
        before, after = kinds[:-1], kinds[1:]
        joined = ((before == NAME) & (after == NAME)) | ((before == NUMBER) & (after == UNIT))
        bounds = np.concatenate(([0] if len(kinds) else [], np.flatnonzero(~joined) + 1, [len(kinds)])).astype(np.int64)
        own = kinds[bounds[:-1]]
        return np.where(own == LITERAL, values[bounds[:-1]], own.astype(np.uint64)), values, kinds, bounds, raw


def folded_words(values: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Words without case of which only numbers and units are typed."""
    return np.where((kinds == NUMBER) | (kinds == UNIT), kinds.astype(np.uint64), values)


class Cover(NamedTuple):
    """Words of an item that an alignment covers, and what it ends with."""

    mask: int  # a bit for each word of the item
    there: dict
    back: dict
    first: int  # place in the document
    item_end: int
    doc_end: int


NO_COVER = Cover(0, {}, {}, -1, 0, 0)


class BenchmarkIndex:
    """The windows of a block of items."""

    def __init__(self, items: list[tuple[int, str]], window: int, least_literal: int, least_words: int = 5):
        reader = TemplateReader()
        self.window, self.least_literal = window, least_literal
        self.items = [(item_id, *reader.read((text or "").encode())) for item_id, text in items]
        #: number of chunks -> hash of all chunks -> items of few words
        self.short: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for item_id, _, values, _, _, chunks in self.items:
            if len(values) < least_words and len(chunks) >= 3:
                whole = int(window_hashes(chunks, len(chunks))[0])
                self.short.setdefault(len(chunks), {}).setdefault(whole, []).append((item_id, len(values)))
        self.items = [x for x in self.items if len(x[2]) >= least_words]
        self.tables = {}
        by_size: dict[int, set] = {}
        for at, (_, template, values, kinds, bounds, _) in enumerate(self.items):
            size, slots = min(window, len(values)), min(window, len(template))
            typed = self._count(kinds[bounds[:-1]] == LITERAL, slots) >= min(least_literal, slots)
            folded = self._count((kinds == LITERAL) | (kinds == NAME), size) >= min(least_literal, size)
            for words, own, n, by_slot in ((template, typed, slots, 1), (folded_words(values, kinds), folded, size, 0), (values, ~folded, size, 0)):
                hashes = window_hashes(words, n)
                by_size.setdefault(n, set()).update((int(hashes[place]), at, int(place), by_slot) for place in np.flatnonzero(own))
        for size, found in by_size.items():
            rows = sorted(found)
            hashes = np.array([h for h, *_ in rows], np.uint64)
            maybe = np.zeros(1 << 20, bool)
            maybe[(hashes >> np.uint64(44)).astype(np.int64)] = True
            self.tables[size] = (maybe, hashes, np.array([x[1:] for x in rows], np.int64).reshape(-1, 3))

    @staticmethod
    def _count(marked: np.ndarray, size: int) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(marked)))
        return total[size:] - total[:-size]

    def hits(self, template: np.ndarray, values: np.ndarray, kinds: np.ndarray) -> dict[int, dict[tuple, set[int]]]:
        """{item: {(by slot, diagonal, size): places in the item}} of equal windows."""
        out: dict[int, dict[tuple, set[int]]] = {}
        readings = np.concatenate((template, folded_words(values, kinds), values))
        starts = (0, len(template), len(template) + len(values), len(readings))
        for size, (maybe, hashes, rows) in self.tables.items():
            if len(values) < size or not len(hashes):
                continue
            found = window_hashes(readings, size)
            places = np.flatnonzero(maybe[(found >> np.uint64(44)).astype(np.int64)])
            first = np.searchsorted(hashes, found[places], "left")
            real = hashes[np.minimum(first, len(hashes) - 1)] == found[places]
            for at, a in zip(places[real].tolist(), first[real].tolist(), strict=True):
                reading = (at >= starts[1]) + (at >= starts[2])
                if at + size > starts[reading + 1]:
                    continue  # a window across two readings
                b = np.searchsorted(hashes, found[at], "right")
                for item, place, by_slot in rows[a:b].tolist():
                    if by_slot == (reading == 0):
                        out.setdefault(item, {}).setdefault((by_slot, at - starts[reading] - place, size), set()).add(place)
        return out

    def _short_matches(self, chunks: np.ndarray) -> Iterator[tuple]:
        for size, wanted in self.short.items():
            hashes = window_hashes(chunks, size)
            for place in np.flatnonzero(np.isin(hashes, np.fromiter(wanted, np.uint64, len(wanted)))).tolist():
                for item_id, words in wanted[int(hashes[place])]:
                    yield item_id, place, words

    def matches(self, template: np.ndarray, values: np.ndarray, kinds: np.ndarray, bounds: np.ndarray, chunks: np.ndarray, least_cover: float) -> list[tuple]:
        """(item_id, first word, words covered, words of the item, slots, changed slots)
        of the best alignment of each item that is covered enough."""
        out, seen = [], set()
        for item_id, place, words in self._short_matches(chunks):
            if item_id not in seen:
                seen.add(item_id)
                out.append((item_id, place, words, words, 0, 0))
        for at, diagonals in self.hits(template, values, kinds).items():
            n = len(self.items[at][2])
            cover = self._best(self._segments(at, diagonals, values, kinds, bounds), n)
            covered = cover.mask.bit_count()
            if covered >= min(self.window, n) and covered >= least_cover * n:
                changed = sum(x != y for (_, x), y in cover.there.items())
                out.append((self.items[at][0], cover.first, covered, n, len(cover.there), changed))
        return out

    def _segments(self, at: int, diagonals: dict, values: np.ndarray, kinds: np.ndarray, bounds: np.ndarray) -> list[tuple]:
        """(place in the document, in the item, diagonal, mask, windows) of the unbroken
        parts of diagonals; a window is a list of (item span, document span, slot pairs)."""
        _, _, item_values, item_kinds, item_bounds, _ = self.items[at]
        out = []
        for (by_slot, diagonal, size), places in diagonals.items():
            units: dict[int, tuple] = {}

            def unit(q: int) -> tuple:
                if q not in units:
                    spans = (item_bounds[q : q + 2], bounds[q + diagonal : q + diagonal + 2]) if by_slot else ((q, q + 1), (q + diagonal, q + diagonal + 1))
                    (i0, i1), (d0, d1) = ([int(x) for x in span] for span in spans)
                    kind, pairs = int(item_kinds[i0]), []
                    if kind != LITERAL and i1 - i0 == d1 - d0:
                        pairs = [(int(item_kinds[i0 + j]), int(item_values[i0 + j]), int(values[d0 + j])) for j in range(i1 - i0)]
                    elif kind == NUMBER:
                        pairs = [(kind, int(item_values[i0]), int(values[d0]))]
                    elif kind != LITERAL:
                        pairs = [(kind, tuple(item_values[i0:i1].tolist()), tuple(values[d0:d1].tolist()))]
                    units[q] = (i0, i1, d0, d1, pairs)
                return units[q]

            segment: list[list[tuple]] = []
            ordered = sorted(places)
            for place, following in zip(ordered, [*ordered[1:], None], strict=True):
                segment.append([unit(q) for q in range(place, place + size)])
                if following is None or following > place + size:
                    start, end = segment[0][0], segment[-1][-1]
                    out.append((start[2], start[0], (by_slot, diagonal), ((1 << end[1] - start[0]) - 1) << start[0], segment))
                    segment = []
        return sorted(out, key=lambda x: x[:3])

    def _best(self, segments: list[tuple], n: int) -> Cover:
        """The alignment that covers most words: segments in order in both texts, on one
        diagonal or on neighbouring ones (within two windows), with one check of all slots."""
        done: list[tuple] = []
        best = NO_COVER
        for doc_at, item_at, diagonal, mask, windows in segments:
            own = self._extended(NO_COVER, windows)
            for other_doc, other_item, other_diagonal, cover in done:
                if own.mask.bit_count() == n:
                    break
                if other_doc >= doc_at or other_item >= item_at or (cover.mask | mask).bit_count() <= own.mask.bit_count():
                    continue
                if diagonal == other_diagonal or abs(doc_at - cover.doc_end - item_at + cover.item_end) <= 2 * self.window:
                    own = max(own, self._extended(cover, windows), key=lambda x: x.mask.bit_count())
            done.append((doc_at, item_at, diagonal, own))
            best = max(best, own, key=lambda x: x.mask.bit_count())
        return best

    @staticmethod
    def _extended(cover: Cover, windows: list[list[tuple]]) -> Cover:
        mask, there, back, first, item_end, doc_end = cover
        for window in windows:
            units = [u for u in window if u[0] >= cover.item_end and u[2] >= cover.doc_end]
            if not units:
                continue
            new_there, new_back = dict(there), dict(back)
            if all(new_there.setdefault((k, x), y) == y and new_back.setdefault((k, y), x) == x for u in units for k, x, y in u[4]):
                there, back = new_there, new_back
                for i0, i1, *_ in units:
                    mask |= ((1 << i1 - i0) - 1) << i0
                first, item_end, doc_end = first if first >= 0 else units[0][2], units[-1][1], units[-1][3]
        return Cover(mask, there, back, first, item_end, doc_end)


MATCHES = "item_id long, first_word int, covered int, item_words int, slots int, changed_slots int"


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = 8,
    least_cover: float = 0.5,
    least_literal: int = 4,
    block_items: int = 20_000,
    block_words: int = 4_000_000,
) -> DataFrame:
    """doc_id and matches (see ``MATCHES``) of all contaminated documents."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    out = None
    for index in _blocks(benchmark, window, least_literal, block_items, block_words):
        part = rows.mapInArrow(tidy(_lookup(docs, index, least_cover), keeps=True), f"doc_id long, matches array<struct<{_fields()}>>")
        part = part.where(F.size("matches") > 0)
        out = part if out is None else out.union(part)
    if out is None:
        out = rows.where("false").select("doc_id", F.array().cast(f"array<struct<{_fields()}>>").alias("matches"))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that no benchmark item contaminates; columns as they were.

    The decision is made for each row from its own text, without a join."""
    options = {"window": 8, "least_cover": 0.5, "least_literal": 4, "block_items": 20_000, "block_words": 4_000_000} | options
    for index in _blocks(benchmark, options["window"], options["least_literal"], options["block_items"], options["block_words"]):
        docs = where_text(docs, _unmatched(docs, index, options["least_cover"]), keeps=True)
    return docs


def _fields() -> str:
    return ",".join(":".join(x.split()) for x in MATCHES.split(", "))


def _blocks(benchmark: DataFrame, window: int, least_literal: int, block_items: int, block_words: int) -> Iterator[BenchmarkIndex]:
    """The benchmark in blocks that fit a broadcast, of bounded items and words."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    sizes = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(-(-sizes["n"] // block_items), -(-sizes["chars"] // (2 * block_words)))
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # about block_items rows
        yield BenchmarkIndex(sorted((r["item_id"] if r["item_id"] is not None else -1, r["text"]) for r in own), window, least_literal)


def _reader() -> TemplateReader:
    return kept("templates", TemplateReader)


def _lookup(docs: DataFrame, index: BenchmarkIndex, least_cover: float):
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    names = [x.split()[0] for x in MATCHES.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([(n, pa.int64() if n == "item_id" else pa.int32()) for n in names]))
        reader, index = _reader(), shared.value
        for batch in batches:
            ids, found = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = index.matches(*reader.read(text), least_cover)
                if rows:
                    ids.append(doc_id)
                    found.append([dict(zip(names, r, strict=True)) for r in sorted(rows)])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, kind)], ["doc_id", "matches"])

    return run


def _unmatched(docs: DataFrame, index: BenchmarkIndex, least_cover: float):
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def make():
        reader, index = _reader(), shared.value
        return lambda texts: [not t or not index.matches(*reader.read(t), least_cover) for t in texts]

    return make
