"""Batch tokenisation with the tokenizers library, with a bounded memory of words.

The word-level vocabulary drops white space and never joins characters across
it, so the ids of a text are the ids of its white-space separated chunks in
order.  Texts are cut into chunks, chunks are looked up in a table of those that
were seen before, and ids are put together by array operations; the library
is asked for the chunks that the table does not hold.  Keys are the bytes of a
chunk themselves, so a lookup is never wrong.  The table holds a fixed number of
chunks, and texts are worked on in pieces of bounded size, so the memory of a
worker depends on neither the corpus nor the length of a text.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np

from .common import kept

assert array("I").itemsize == 4 and sys.byteorder == "little"

#: Characters beyond U+023F.
BEYOND = re.compile("[^\u0000-ȿ]")
#: Chunks of more bytes are not remembered.
LONGEST = 24
#: Bytes of text that are worked on at once.
PIECE = 1 << 20

_WHITE = np.zeros(256, bool)
_WHITE[list(b" \t\n\r\x0b\x0c")] = True
_GAP = re.compile(rb"[ \t\n\r\x0b\x0c]")
_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class ChunkTable:
    """Short chunks by their bytes, in arrays with open addressing.

    A chunk is the row of its 24 bytes (three words, filled with zero bytes) and its
    size; a row has a run of ids.  Rows beyond ``size`` serve one call only.
    """

    def __init__(self, limit: int):
        self.bits = max(10, (2 * limit).bit_length())
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.size = self.used = 0
        self.keys = np.zeros((1 << 10, 3), np.uint64)
        self.lengths = np.zeros(1 << 10, np.uint8)
        self.starts = np.zeros(1 << 10, np.int64)
        self.counts = np.zeros(1 << 10, np.int32)
        self.ids = np.zeros(1 << 12, np.uint32)

    def _hash(self, keys: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = lengths.astype(np.uint64)
        for i in range(3):
            out = (out ^ keys[:, i]) * _ODD[i]
            out ^= out >> np.uint64(32)
        return out * _ODD[0] >> np.uint64(64 - self.bits)

    def find(self, keys: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The row of each chunk, or -1."""
        out = np.full(len(keys), -1, np.int64)
        slot = self._hash(keys, lengths).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            row = self.slots[slot]
            there = row >= 0
            left, slot, row = left[there], slot[there], row[there]
            same = self.lengths[row] == lengths[left]
            for i in range(3):
                same &= self.keys[row, i] == keys[left, i]
            out[left[same]] = row[same]
            left, slot = left[~same], (slot[~same] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, keys: np.ndarray, lengths: np.ndarray, ids: list[bytes], keep: int) -> int:
        """Rows for distinct new chunks; the first row.  Only the first ``keep`` can be found
        again; the others are there for lookups by row until the next call."""
        first, n = self.size, len(keys)
        while first + n > len(self.lengths):
            more = len(self.lengths)
            self.keys = np.concatenate((self.keys, np.zeros((more, 3), np.uint64)))
            self.lengths, self.starts, self.counts = (np.concatenate((x, np.zeros(more, x.dtype))) for x in (self.lengths, self.starts, self.counts))
        plain = np.frombuffer(b"".join(ids), "<u4")
        while self.used + len(plain) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids), np.uint32)))
        counts = np.array([len(x) >> 2 for x in ids], np.int32)
        self.keys[first : first + n], self.lengths[first : first + n] = keys, lengths
        self.counts[first : first + n] = counts
        self.starts[first : first + n] = self.used + np.cumsum(counts) - counts
        self.ids[self.used : self.used + len(plain)] = plain
        self._place(first, keep)
        self.size += keep
        self.used += int(counts[:keep].sum())
        return first

    def _place(self, first: int, n: int) -> None:
        slot = self._hash(self.keys[first : first + n], self.lengths[first : first + n]).astype(np.int64)
        row = np.arange(first, first + n, dtype=np.int32)
        while len(row):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = row[free]  # of several rows the last one stays
            left = self.slots[slot] != row
            row, slot = row[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after another, number of ids of each)."""
        counts = self.counts[rows]
        ends = np.cumsum(counts, dtype=np.int64)
        at = np.repeat(self.starts[rows] - (ends - counts), counts)
        at += np.arange(len(at))
        return self.ids[at], counts


def chunk_keys(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, keys and sizes of the chunks of ``data``, which starts with white space
    and ends with as much of it as a key has bytes."""
    found = np.frombuffer(data, np.uint8)
    white = _WHITE[found]
    edges = np.flatnonzero(white[1:] != white[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    sizes = ends - starts
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))  # the eight bytes from each place on
    keys = np.empty((len(starts), 3), np.uint64)
    for i in range(3):
        keys[:, i] = words[starts + 8 * i] & _LOW_BYTES[np.clip(sizes - 8 * i, 0, 8)]
    return starts, ends, keys, sizes


class ChunkEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    Chunks are split at ASCII white space only; rarer white space is left to
    the library.  ``limit`` bounds the chunks that are remembered.
    """

    def __init__(self, path: str, limit: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.known = ChunkTable(limit)
        self.turned_away = 0  # chunks not remembered since the memory is full
        self.words = Tokenizer.from_str(self.tokenizer.to_str())
        self.words.normalizer = None
        self.words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        model = self.words.model
        model._resize_cache(0)  # words come here once only
        self.words.model = model
        self.tails = {t: b"".join(self._batches(self.tokenizer, [t])) for t in ("", ".", ",")}
        self.whole = not self._splits_at_white_space()

    def _splits_at_white_space(self) -> bool:
        """Whether chunk-wise encoding is right for this vocabulary: probes hold
        runs of white space, punctuation, digits, case and combining marks."""
        probes = ["a b", "  Ab,\n\tc1 2d.. e's  été x́ y", "do n't I'll\r\n(z) w"]
        encode = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        words = "déjà naïve straße łódź ñandú the of x"
        return all(encode(p) == [i for c in p.encode().split() for i in encode(c.decode())] for p in probes) and encode(words) == [
            i for w in words.split() for i in self.words.encode(w, add_special_tokens=False).ids
        ]

    @staticmethod
    def _batches(tokenizer, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 500):
            found = tokenizer.encode_batch_fast(texts[i : i + 500], add_special_tokens=False)
            out += [array("I", e.ids).tobytes() for e in found]
        return out

    def _library(self, texts: list[str]) -> dict[str, bytes]:
        """Ids of texts; words of plain lower-case letters up to U+023F are in
        normal form and one piece, so they need neither of these steps."""
        plain = [t for t in texts if t.isalpha() and not BEYOND.search(t)]
        rest = [t for t in texts if not t.isalpha() or BEYOND.search(t)]
        return dict(zip(plain + rest, self._batches(self.words, plain) + self._batches(self.tokenizer, rest), strict=True))

    def _bases(self, chunks: list[bytes]) -> list[tuple[str, str]]:
        """Chunks as (what is looked up, tail): one full stop or comma after an
        ASCII letter or digit is a token of its own, and case does not matter up
        to U+023F (where lower case needs no context)."""
        texts = b"\n".join(chunks).decode("utf-8", "replace")
        if BEYOND.search(texts) or "<|" in texts:
            texts = [t if BEYOND.search(t) or "<|" in t else t.lower() for t in texts.split("\n")]
        else:
            texts = texts.lower().split("\n")
        out = []
        for t in texts:
            if t[-1] in ".," and t[-2:-1].isalnum() and t[-2].isascii():
                out.append((t[:-1], t[-1]))
            else:
                out.append((t, ""))
        return out

    def _encoded(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of distinct chunks that the table does not hold."""
        pairs = self._bases(chunks)
        bases = list({b for b, _ in pairs} - {""})
        ids_of = {"": b""}
        if bases:
            data = b" " + " ".join(bases).encode() + b" " * LONGEST
            _, _, keys, sizes = chunk_keys(data)
            rows = np.where(sizes <= LONGEST, self.known.find(keys, np.minimum(sizes, 255).astype(np.uint8)), -1)
            if len(rows) != len(bases):  # a base with white space of its own
                rows = np.full(len(bases), -1)
            there = np.flatnonzero(rows >= 0)
            ids, counts = self.known.gather(rows[there])
            ids, ends = ids.tobytes(), 4 * np.cumsum(counts)
            ids_of |= {bases[i]: ids[e - 4 * n : e] for i, e, n in zip(there.tolist(), ends.tolist(), counts.tolist(), strict=True)}
            ids_of |= self._library([bases[i] for i in np.flatnonzero(rows < 0).tolist()])
        return [ids_of[b] + self.tails[t] for b, t in pairs]

    def _piece(self, data: bytes, marks: np.ndarray) -> list[bytes]:
        """Ids of the parts of ``data`` (see :func:`chunk_keys`) that start at ``marks``."""
        starts, ends, keys, sizes = chunk_keys(data)
        short = np.minimum(sizes, 255).astype(np.uint8)
        rows = np.where(sizes <= LONGEST, self.known.find(keys, short), -1)
        unknown = np.flatnonzero(rows < 0)
        if len(unknown):
            if self.turned_away > 8 * self.limit:  # the texts have changed
                self.known.clear()
                self.turned_away = 0
                return self._piece(data, marks)
            fits = sizes[unknown] <= LONGEST
            brief, long = unknown[fits], unknown[~fits]
            order = np.lexsort((short[brief], keys[brief, 2], keys[brief, 1], keys[brief, 0]))
            brief = brief[order]
            same = (keys[brief[1:]] == keys[brief[:-1]]).all(axis=1) & (short[brief[1:]] == short[brief[:-1]])
            new = np.concatenate(([True], ~same))[: len(brief)]
            fresh = np.concatenate((brief[new], long))
            ids = self._encoded([data[a:b] for a, b in zip(starts[fresh].tolist(), ends[fresh].tolist(), strict=True)])
            n = int(new.sum())
            keep = min(n, self.limit - self.known.size)  # long chunks come last and are not kept
            self.turned_away += n - keep
            first = self.known.add(keys[fresh], short[fresh], ids, keep)
            rows[brief] = first + np.cumsum(new) - 1
            rows[long] = first + n + np.arange(len(long))
        ids, counts = self.known.gather(rows)
        cuts = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))[np.searchsorted(starts, marks)]
        ids = ids.tobytes()
        return [ids[4 * a : 4 * b] for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ids) // 4], strict=True)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if self.whole:
            return self._batches(self.tokenizer, [t.decode("utf-8", "replace") for t in texts])
        out: list[list[bytes]] = [[] for _ in texts]
        owners: list[int] = []
        parts: list[bytes] = []
        size = 0

        def done() -> None:
            lengths = np.array([len(p) + 1 for p in parts], np.int64)
            data = b" " + b" ".join(parts) + b" " * LONGEST
            for owner, ids in zip(owners, self._piece(data, 1 + np.cumsum(lengths) - lengths), strict=True):
                out[owner].append(ids)

        for owner, part in self._parts(texts):
            if parts and size + len(part) > PIECE:
                done()
                owners, parts, size = [], [], 0
            owners.append(owner)
            parts.append(part)
            size += len(part) + 1
        if parts:
            done()
        return [p[0] if len(p) == 1 else b"".join(p) for p in out]

    @staticmethod
    def _parts(texts: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """Texts in parts of about ``PIECE`` bytes, cut at white space."""
        for i, text in enumerate(texts):
            at = 0
            while len(text) - at > PIECE:
                gap = _GAP.search(text, at + PIECE)
                if gap is None:
                    break
                yield i, text[at : gap.start()]
                at = gap.end()
            yield i, text[at:] if at else text


def encoder(path: str, limit: int = 600_000) -> ChunkEncoder:
    """The worker's encoder for a vocabulary file; kept between tasks."""
    return kept(("chunks", path, limit), lambda: ChunkEncoder(path, limit))


def slices(batch, rows: int = 2000, size: int = 2 << 20):
    """Parts of an Arrow batch (second column: texts) of bounded rows and bytes."""
    import pyarrow.compute as pc

    lengths = pc.binary_length(batch.column(1)).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and (i - start >= rows or total + n > size):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file on this machine (never copied)."""
    import public_tokenizers

    return public_tokenizers.path(name)
