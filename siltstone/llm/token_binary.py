"""Operator 9: token ids in a seekable binary format.

A shard is a run of independent zstandard frames, followed by two skippable
frames: the document index (ids, token counts, frame and place of each document)
and, at the very end, the seek table of the public "zstd seekable format": the
compressed size, plain size and checksum (low 32 bits of XXH64 of the plain
bytes) of each frame.  Any zstandard reader can decompress a shard; a reader that
wants some documents reads the trailer and then only their frames.  A frame holds
the ids (little-endian unsigned 32-bit) of whole documents.

Writing range-partitions the texts by doc_id, so shards are in ascending order
and a task streams its sorted rows into one file of its own name; the manifest
row that the successful attempt returns names the file, so files of lost or
repeated attempts are never read.  The manifest (a row per shard) is written as a
table, and the ids before each shard are a running sum over it.

Null texts count as empty: the document is its end id alone.  Rows that repeat a
doc_id are separate documents, in order of a hash of their text, by which they are also
dealt to shards, so no doc_id (nor the lack of one) has to fit a task.  A null doc_id sorts first
and is kept as ``NULL_ID`` in a shard.  An empty table has no shards.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, materialize, ship, text_bytes, tidy, work_path
from .tokens import encoder, slices, vocabulary

#: Fixed values of the zstandard (seekable) format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

NULL_ID = -(1 << 63)


def _checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class ShardWriter:
    """Writes documents one after another to a binary file object."""

    def __init__(self, out, frame_bytes: int = 1 << 20, level: int = 1):
        import zstandard

        self.out, self.frame_bytes = out, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int]] = []  # doc_id, tokens, frame, ids before it in the frame
        self.waiting: list[bytes] = []
        self.waiting_bytes = self.size = self.tokens = 0

    def add(self, doc_id: int, ids: bytes) -> None:
        if self.waiting and self.waiting_bytes + len(ids) > self.frame_bytes:
            self._frame()
        self.index.append((doc_id, len(ids) // 4, len(self.frames), self.waiting_bytes // 4))
        self.waiting.append(ids)
        self.waiting_bytes += len(ids)
        self.tokens += len(ids) // 4

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def _frame(self) -> None:
        plain = b"".join(self.waiting)
        packed = self.compressor.compress(plain)
        self.frames.append((len(packed), len(plain), _checksum(plain)))
        self._write(packed)
        self.waiting, self.waiting_bytes = [], 0

    def close(self) -> None:
        if self.waiting:
            self._frame()
        columns = np.array(self.index, "<i8").reshape(-1, 4).T
        listed = self.compressor.compress(np.ascontiguousarray(columns).tobytes())
        self._write(struct.pack("<II", SKIPPABLE_INDEX, len(listed) + 4) + struct.pack("<I", _checksum(listed)) + listed)
        table = np.array(self.frames, "<u4").tobytes() + struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self._write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(table)) + table)


class ShardReader:
    """Reads a shard from a seekable binary file object; ``frames_read`` counts
    the frames that were decompressed."""

    def __init__(self, file, size: int):
        self.file, self.frames_read = file, 0
        number, flag, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flag & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end of the shard")
        table = self._at(size - 9 - 12 * number - 8, 12 * number + 8)
        if struct.unpack("<II", table[:8]) != (SKIPPABLE_SEEK_TABLE, 12 * number + 9):
            raise ValueError("damaged seek table")
        self.frames = np.frombuffer(table, "<u4", offset=8).reshape(-1, 3).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.frames[:, 0])))
        at = int(self.starts[-1])
        listed = self._at(at, size - 17 - 12 * number - at)
        magic, length, check = struct.unpack("<III", listed[:12])
        if magic != SKIPPABLE_INDEX or length != len(listed) - 8 or _checksum(listed[12:]) != check:
            raise ValueError("damaged document index")
        self.doc_ids, self.tokens, self.frame_of, self.place = np.frombuffer(self._plain(listed[12:]), "<i8").reshape(4, -1)

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        data = self.file.read(size)
        if len(data) != size:
            raise ValueError("short read")
        return data

    @staticmethod
    def _plain(data: bytes) -> bytes:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data)

    def frame(self, k: int) -> bytes:
        packed, plain_size, check = (int(x) for x in self.frames[k])
        plain = self._plain(self._at(int(self.starts[k]), packed))
        self.frames_read += 1
        if len(plain) != plain_size or _checksum(plain) != check:
            raise ValueError(f"checksum of frame {k} does not match")
        return plain

    def documents(self, numbers=None) -> Iterator[tuple[int, int, bytes]]:
        """(number in the shard, doc_id, ids) of the given documents, or of all."""
        last, plain = -1, b""
        for i in range(len(self.doc_ids)) if numbers is None else sorted(numbers):
            if self.frame_of[i] != last:
                last = int(self.frame_of[i])
                plain = self.frame(last)
            at = 4 * int(self.place[i])
            yield i, int(self.doc_ids[i]), plain[at : at + 4 * int(self.tokens[i])]


MANIFEST = "shard int, path string, docs long, tokens long, first_id long, last_id long, bytes long"


def write(
    docs: DataFrame,
    *,
    path: str | None = None,
    vocabulary_path: str | None = None,
    end_id: int = 1,
    frame_bytes: int = 1 << 20,
    level: int = 1,
) -> DataFrame:
    """Encode and write all documents; the manifest with ``first_token``."""
    spark = docs.sparkSession
    ship(spark)
    folder = path or work_path(spark, "tokens")
    words = vocabulary_path or vocabulary()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        codec, end, writer, stream = encoder(words), np.array([end_id], "<u4").tobytes(), None, None
        for batch in batches:
            for part in slices(batch):
                if writer is None and part.num_rows:
                    number = TaskContext.get().partitionId()
                    fs, local = filesystem(folder)
                    fs.create_dir(local, recursive=True)
                    name = f"shard-{number:06d}-{uuid.uuid4().hex}.zst"
                    stream = fs.open_output_stream(f"{local}/{name}", compression=None)
                    writer = ShardWriter(stream, frame_bytes, level)
                for doc_id, ids in zip(part.column(0).to_pylist(), codec.encode(part.column(1).to_pylist()), strict=True):
                    writer.add(NULL_ID if doc_id is None else doc_id, ids + end)
        if writer is not None:
            writer.close()
            stream.close()
            row = [number, f"{folder}/{name}", len(writer.index), writer.tokens, writer.index[0][0], writer.index[-1][0], writer.size]
            kinds = [pa.int32(), pa.string()] + [pa.int64()] * 5
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [x.split()[0] for x in MANIFEST.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    # rows of one doc_id, or of none, are dealt by their texts
    order = ["doc_id", F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    manifest = materialize(rows.mapInArrow(tidy(run, keeps=True), MANIFEST), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    return manifest.withColumn("first_token", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read(manifest: DataFrame, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of all
    documents, or of ``doc_ids`` (a short list of a caller), of which only the
    shards and frames that hold them are read."""
    spark = manifest.sparkSession
    wanted = None if doc_ids is None else sorted(set(doc_ids))
    if wanted is not None:
        manifest = manifest.where(
            " or ".join(f"{int(x)} between first_id and last_id" for x in wanted) or "false"
        )

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for shard in batch.to_pylist():
                fs, local = filesystem(shard["path"])
                with fs.open_input_file(local) as file:
                    reader = ShardReader(file, file.size())
                    starts = shard["first_token"] + np.concatenate(([0], np.cumsum(reader.tokens)))
                    numbers = None if wanted is None else np.flatnonzero(np.isin(reader.doc_ids, wanted)).tolist()
                    rows, size = [], 0
                    for i, doc_id, ids in reader.documents(numbers):
                        rows.append((None if doc_id == NULL_ID else doc_id, int(starts[i]), len(ids) // 4, ids))
                        size += len(ids)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    shards = max(1, manifest.select("shard").count())
    spread = materialize(manifest.select("shard", "path", "first_token"), "token-starts").repartitionByRange(shards, "shard")
    ship(spark)
    return spread.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids binary")
