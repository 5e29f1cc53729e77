"""Operator 2: packing into fixed windows by minimum bin slack.

Every document is cut into full windows and one remaining piece.  A task keeps
the remaining pieces of its rows by length and fills window after window: the
longest piece goes first, then a subset-sum dynamic program over bitsets (one
big integer whose bit s says "length s can be reached") picks the multiset of
lengths that comes closest to what is left, and the counts are found by walking
back through the saved bitsets.  A multiset is used as often as the counts
allow.  Where even the closest multiset leaves room, one more piece is cut at the
window's end; the very last tokens of a task become sequences of power-of-two
sizes, which need no padding.

The operator is one narrow pass: no shuffle, no state across tasks, and memory
bounded by ``buffer_tokens`` plus one batch of rows.  Only the tail of a task can be
short, so padding does not grow with the input.  Which row lands in which task
does not matter for correctness, so skewed keys, copies and lost executors have
no effect beyond a retry of the task.

Nulls and empty texts are one end-of-document token.  Repeated doc_ids are
packed as separate documents.  Other columns are ignored.  An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_bytes, tidy
from .tokens import encoder, slices, vocabulary

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def closest_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Multiset of lengths with the largest sum <= ``room``, as {length: count}.

    ``counts`` bounds how often a length may be used.  Longer lengths are
    offered first, so that of equal sums the one with fewer pieces is found.
    """
    reach, full, layers = 1, (1 << (room + 1)) - 1, []
    for length in sorted((k for k, c in counts.items() if c and k <= room), reverse=True):
        left, step = min(counts[length], room // length), 1
        while left > 0:
            use = min(step, left)
            layers.append((reach, length, use))
            reach |= (reach << (length * use)) & full
            left -= use
            step *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for before, length, use in reversed(layers):
        if not before >> total & 1:
            total -= length * use
            chosen[length] = chosen.get(length, 0) + use
    return chosen


class Packer:
    """Packs pieces (doc_id, start, ids, doc_tokens) of one task."""

    def __init__(self, capacity: int, first_sequence: int, buffer_tokens: int):
        self.capacity, self.sequence, self.buffer_tokens = capacity, first_sequence, buffer_tokens
        self.pieces: dict[int, list[tuple]] = {}
        self.tokens = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int, ids: bytes) -> None:
        """``ids``: all ids of a document, four bytes each."""
        total, size = len(ids) // 4, self.capacity
        start = 0
        while total - start >= size:
            self._emit([(doc_id, start, ids[4 * start : 4 * (start + size)], total)])
            start += size
        if start < total:
            self.pieces.setdefault(total - start, []).append((doc_id, start, ids[4 * start :], total))
            self.tokens += total - start
            if self.tokens >= self.buffer_tokens:
                self._fill(final=False)

    def finish(self) -> None:
        self._fill(final=True)

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, total, self.sequence, offset, ids))
            offset += n
        self.sequence += 1

    def _take(self, length: int) -> tuple:
        own = self.pieces[length]
        piece = own.pop()
        if not own:
            del self.pieces[length]
        self.tokens -= length
        return piece

    def _fill(self, final: bool) -> None:
        """Fill windows; before the end half of the buffer stays, for choice."""
        while self.tokens >= (self.capacity if final else max(self.capacity, self.buffer_tokens // 2)):
            longest = max(self.pieces)
            counts = {k: len(v) for k, v in self.pieces.items()}
            counts[longest] -= 1
            chosen = closest_fill(counts, self.capacity - longest)
            slack = self.capacity - longest - sum(k * c for k, c in chosen.items())
            chosen[longest] = chosen.get(longest, 0) + 1
            for _ in range(1 if slack else min(len(self.pieces[k]) // c for k, c in chosen.items())):
                window = [self._take(k) for k in sorted(chosen, reverse=True) for _ in range(chosen[k])]
                if slack:
                    window.append(self._cut(slack))
                self._emit(window)
        if final:
            while self.tokens:
                size, window = 1 << (self.tokens.bit_length() - 1), []
                while size:
                    length = max((k for k in self.pieces if k <= size), default=0)
                    window.append(self._take(length) if length else self._cut(size))
                    size -= len(window[-1][2]) // 4
                self._emit(window)

    def _cut(self, size: int) -> tuple:
        """The first ``size`` tokens of the shortest longer piece; its rest stays."""
        doc_id, start, ids, total = self._take(min(k for k in self.pieces if k > size))
        rest = len(ids) // 4 - size
        self.pieces.setdefault(rest, []).append((doc_id, start + size, ids[4 * size :], total))
        self.tokens += rest
        return doc_id, start, ids[: 4 * size], total


def pack(
    docs: DataFrame,
    *,
    vocabulary_path: str | None = None,
    capacity: int = 2048,
    end_id: int = 1,
    buffer_tokens: int = 1_000_000,
) -> DataFrame:
    """Pieces of all documents with their place in a sequence.

    Columns: doc_id, start (ids of the document before the piece), length,
    doc_tokens (all ids of the document, with the end id), sequence_id (unique;
    task number and number within the task), offset (place in the sequence) and
    ids (little-endian unsigned 32-bit).
    """
    ship(docs.sparkSession)
    path = vocabulary_path or vocabulary()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in (x.split()[0] for x in SCHEMA.split(", "))])
        codec, end = encoder(path), np.array([end_id], "<u4").tobytes()
        packer = Packer(capacity, TaskContext.get().partitionId() << 40, buffer_tokens)

        def rows(least: int) -> Iterator:
            while len(packer.rows) > least:
                part, packer.rows = packer.rows[:2000], packer.rows[2000:]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for part in slices(batch):
                for doc_id, ids in zip(part.column(0).to_pylist(), codec.encode(part.column(1).to_pylist()), strict=True):
                    packer.add(doc_id, ids + end)
                yield from rows(2000)
        packer.finish()
        yield from rows(0)

    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(tidy(run, keeps=True), SCHEMA)
