"""Operator 10: WARC archives with revisit records, and a salvage reader.

Writing: payload digests are grouped (with partial aggregation) to find equal
payloads; the largest page_id of a group becomes the response and the others
revisit it.  The pages are then written by tasks, one gzip member per record,
into archives of about ``archive_bytes``.  Files carry a name of their own for
each attempt and only those that the manifest names are read.

Reading: every record is checked (gzip checksum, version line, block length,
block digest and, where the payload is there, payload digest).  After a failed
check the reader searches for the next gzip member or version line that starts a
valid record, goes on from there, and reports the bytes between as a gap.  The same
holds inside a gzip member of many records, whose plain bytes are read as they come
and searched for the next version line, also if the member is damaged or cut short:
records with a good block digest before and after the damage are kept, others of such
a member are quarantined.  An archive is read in steps, so its size does not matter; a
block has to fit in memory, and one of more than ``MOST_BLOCK`` bytes is reported as a gap.

A null html is an empty payload.  Repeated rows are written as often as they
occur; repeats of the response's own page_id are responses too.  A null page_id
never makes a revisit.  Other columns, also of clashing names, are ignored; an empty
table has no archives.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, materialize, ship, text_bytes, tidy, work_path

#: Bytes of a block, and of a header, that are held in memory at most.
MOST_BLOCK, MOST_HEADER = 1 << 30, 1 << 20
GZIP_START = b"\x1f\x8b\x08"
VERSION_START = b"WARC/1."
#: Fixed value of the WARC 1.1 standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn)
    return int(found[1]) if found else None


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit has the HTTP header of the full payload only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {page_urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {page_urn(refers_to)}"]
    lines += [
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class Record:
    """``offset``: of the record or its gzip member, ``length``: bytes of it that were read
    by the end of the record."""

    offset: int
    length: int
    headers: dict[str, str] = field(repr=False)
    block: bytes = field(repr=False)

    def http(self) -> tuple[int | None, bytes]:
        """(content length that the HTTP header names, bytes after that header)."""
        head, _, body = self.block.partition(b"\r\n\r\n")
        found = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
        return int(found[1]) if found else None, body


@dataclass
class Gap:
    """Quarantined bytes; inside a gzip member also their place in its plain bytes."""

    offset: int
    length: int
    reason: str
    plain_offset: int | None = None
    plain_length: int | None = None


class _Damaged(Exception):
    pass


class _Source:
    """A seekable file, read in steps."""

    def __init__(self, file, size: int, step: int = 1 << 20):
        self.file, self.size, self.step = file, size, step
        self.start, self.held = 0, b""

    def get(self, at: int, n: int) -> bytes:
        if not self.start <= at <= at + n <= self.start + len(self.held):
            self.file.seek(at)
            self.start, self.held = at, self.file.read(max(n, self.step))
        return self.held[at - self.start : at - self.start + n]

    def find(self, what: bytes, at: int, stop: int | None = None) -> int:
        """The first place of ``what`` from ``at`` on (before ``stop``), or -1."""
        stop = self.size if stop is None else min(stop, self.size)
        while at < stop:
            part = self.get(at, min(self.step, stop - at + len(what) - 1))
            found = part.find(what)
            if 0 <= found < stop - at:
                return at + found
            at += max(1, len(part) - len(what) + 1)
        return -1

    def free(self, at: int) -> None:
        """What lies before ``at`` is not needed again."""


class _Member:
    """The plain bytes of the gzip member at ``at``, inflated as far as they are asked for."""

    def __init__(self, source: _Source, at: int, step: int = 1 << 16):
        self.source, self.at, self.step = source, at, step
        self.unpacker = zlib.decompressobj(31)
        self.start, self.held, self.done, self.error = 0, bytearray(), False, ""

    def _pull(self) -> None:
        chunk = self.source.get(self.at, min(self.step, self.source.size - self.at))
        if not chunk:
            self.done, self.error = True, "the gzip member is cut short"
            return
        while True:  # up to the very byte that is damaged
            before = self.unpacker.copy()
            try:
                self.held += self.unpacker.decompress(chunk)
                break
            except zlib.error as e:
                if len(chunk) == 1:
                    self.done, self.error = True, f"gzip: {e}"
                    return
                self.unpacker, self.step = before, max(1, len(chunk) // 2)
                chunk = chunk[: self.step]
        self.at += len(chunk)
        if self.unpacker.eof:
            self.at -= len(self.unpacker.unused_data)
            self.done = True

    def get(self, at: int, n: int) -> bytes:
        while not self.done and self.start + len(self.held) < at + n:
            self._pull()
        return bytes(self.held[at - self.start : at - self.start + n])

    def find(self, what: bytes, at: int, stop: int | None = None) -> int:
        while True:
            found = self.held.find(what, at - self.start)
            end = self.start + len(self.held)
            if found >= 0:
                return found + self.start if stop is None or found + self.start < stop else -1
            if self.done or (stop is not None and end >= stop):
                return -1
            at = max(at, end - len(what) + 1)
            self._pull()

    def free(self, at: int) -> None:
        if at - self.start > 1 << 16:
            del self.held[: at - self.start]
            self.start = at


def _parse(view: _Source | _Member, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the plain record at ``at``, and where it ends."""
    if view.get(at, 7) != VERSION_START:
        raise _Damaged("no version line")
    end = view.find(b"\r\n\r\n", at, at + MOST_HEADER)
    if end < 0:
        raise _Damaged("the header does not end")
    headers = {}
    for line in view.get(at, end - at).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise _Damaged("malformed header line")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", size):
        raise _Damaged("no block length")
    if int(size) > MOST_BLOCK:
        raise _Damaged(f"the block has more than {MOST_BLOCK} bytes")
    start, stop = end + 4, end + 4 + int(size)
    if view.get(stop, 4) != b"\r\n\r\n":
        raise _Damaged("the block is cut short or its length is wrong")
    block = view.get(start, stop - start)
    if headers.get("warc-block-digest", "").startswith("sha1:") and base32_sha1(block) != headers["warc-block-digest"][5:]:
        raise _Damaged("block digest")
    if headers.get("warc-type") == "response" and headers.get("warc-payload-digest", "").startswith("sha1:"):
        if base32_sha1(block.partition(b"\r\n\r\n")[2]) != headers["warc-payload-digest"][5:]:
            raise _Damaged("payload digest")
    return headers, block, stop + 4


def _in_member(member: _Member, offset: int) -> Iterator[Record | Gap]:
    """Records and inner gaps of a gzip member.  From the first record without a block
    digest on, they wait for the checksum of the whole."""
    at, bad, reason = 0, -1, ""
    waiting: list[Record | Gap] | None = None

    def inner(stop: int) -> Gap:
        return Gap(offset, member.at - offset, f"in the gzip member: {reason}", bad, stop - bad)

    while member.get(at, 1):
        found: list[Record | Gap] = []
        try:
            headers, block, end = _parse(member, at)
        except _Damaged as e:
            if bad < 0:
                bad, reason = at, str(e)
            at = member.find(VERSION_START, at + 1)
            if at < 0:
                break
            continue
        member.get(end, 1)  # so that the end of the member is seen
        if bad >= 0:
            found.append(inner(at))
        found.append(Record(offset, member.at - offset, headers, block))
        if waiting is None and not headers.get("warc-block-digest", "").startswith("sha1:"):
            waiting = []
        if waiting is None:
            yield from found
        else:
            waiting += found
        at, bad = end, -1
        member.free(at)
    if bad >= 0 or member.error:
        reason = reason if bad >= 0 else member.error
        bad = bad if bad >= 0 else at
        (waiting if waiting is not None else (last := [])).append(inner(member.start + len(member.held)))
        if waiting is None:
            yield from last
    for x in waiting or ():
        if member.error and isinstance(x, Record) and not x.headers.get("warc-block-digest", "").startswith("sha1:"):
            x = Gap(offset, x.length, f"no block digest, and {member.error}")
        yield x


def _next_start(source: _Source, at: int, member_end: int = 0) -> int:
    """The next gzip member, or version line outside of the member that ends at ``member_end``."""
    found = [p for p in (source.find(GZIP_START, at), source.find(VERSION_START, max(at, member_end))) if p >= 0]
    return min(found, default=source.size)


def salvage(archive) -> Iterator[Record | Gap]:
    """All valid records of an archive (bytes or a seekable file), and the gaps between
    them, in order."""
    file = io.BytesIO(archive) if isinstance(archive, bytes) else archive
    source = _Source(file, file.seek(0, io.SEEK_END))
    at, bad, reason = 0, -1, ""
    while at < source.size:
        if bad < 0 and source.get(at, 2) == b"\r\n":
            at += 2
            continue
        if source.get(at, 3) == GZIP_START:
            member, found = _Member(source, at), False
            last: Gap | None = None
            for x in _in_member(member, at):
                if not found and isinstance(x, Gap):
                    last = x  # counts only if a record follows
                    continue
                if not found and bad >= 0:
                    yield Gap(bad, at - bad, reason)
                    bad = -1
                if not found and last is not None:
                    yield last
                found = True
                yield x
            if not found:
                if bad < 0:
                    bad, reason = at, member.error or (last.reason if last else "empty gzip member")
                at = _next_start(source, at + 1)
            elif member.error:
                at = _after_member(source, at, member.at)
            else:
                at = member.at
            continue
        try:
            headers, block, end = _parse(source, at)
        except _Damaged as e:
            if bad < 0:
                bad, reason = at, str(e)
            at = _next_start(source, at + 1)
            continue
        if bad >= 0:
            yield Gap(bad, at - bad, reason)
            bad = -1
        yield Record(at, end - at, headers, block)
        at = end
    if bad >= 0:
        yield Gap(bad, source.size - bad, reason)


def _after_member(source: _Source, at: int, failed: int) -> int:
    """Where reading goes on after a member that failed at ``failed``: at a member inside
    it that starts with a valid record (it was cut short there), else behind the failure."""
    start = _next_start(source, at + 1, failed)
    while start < failed:
        try:
            _parse(_Member(source, start), 0)
            break
        except _Damaged:
            start = _next_start(source, start + 1, failed)
    return start


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that repeat an equal payload."""
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(text_bytes("html")).alias("digest"), F.octet_length(text_bytes("html")).alias("size"))
    groups = slim.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    groups = materialize(groups.where("n > 1 and refers_to is not null").select("digest", "refers_to"), "payloads")
    # both sides are plain scans, so adaptive execution can split a digest that many pages share
    return slim.join(groups, "digest").where("page_id != refers_to").select("page_id", "digest", "refers_to").distinct()


def write(
    pages: DataFrame,
    *,
    path: str | None = None,
    least_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
    archive_bytes: int = 32 << 20,
    level: int = 1,
) -> DataFrame:
    """Write a record for every page; the manifest: path, records, bytes."""
    spark = pages.sparkSession
    ship(spark)
    folder = path or work_path(spark, "warc")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        stream, done = None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for page_id, url, payload, refers_to in zip(*columns, strict=True):
                if stream is None:
                    fs, local = filesystem(folder)
                    fs.create_dir(local, recursive=True)
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    stream, records, size = fs.open_output_stream(f"{local}/{name}", compression=None), 0, 0
                member = gzip_member(record_bytes(page_id, url, payload, refers_to, date), level)
                stream.write(member)
                records, size = records + 1, size + len(member)
                if size >= archive_bytes:
                    stream.close()
                    stream = done.append((f"{folder}/{name}", records, size))
        if stream is not None:
            stream.close()
            done.append((f"{folder}/{name}", records, size))
        if done:
            kinds = [pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], ["path", "records", "bytes"])

    repeated = materialize(revisits(pages, least_bytes), "revisits")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", text_bytes("html").alias("payload")).withColumn("digest", F.sha1("payload"))
    rows = rows.join(repeated, ["page_id", "digest"], "left").select("page_id", "url", "payload", "refers_to")
    return materialize(rows.mapInArrow(tidy(run), "path string, records long, bytes long"), "warc-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Records and gaps of all archives.

    kind ("record" or "gap"), path, offset, length, reason (of a gap), page_id,
    url, record_type, refers_to, payload_digest, payload_bytes, payload (null for
    revisits).
    """
    spark = manifest.sparkSession
    ship(spark)
    schema = (
        "kind string, path string, offset long, length long, reason string, page_id long, url string, record_type string, "
        "refers_to long, payload_digest string, payload_bytes long, payload binary"
    )
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]

        def packed(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, local = filesystem(path)
                rows, held, file = [], 0, fs.open_input_file(local)
                for x in salvage(file):
                    if isinstance(x, Gap):
                        rows.append(("gap", path, x.offset, x.length, x.reason) + (None,) * 7)
                    else:
                        held += len(x.block)
                        named, body = x.http()
                        h, full = x.headers, x.headers.get("warc-type") != "revisit"
                        rows.append((
                            "record", path, x.offset, x.length, None, _page_of(h.get("warc-record-id", "")), h.get("warc-target-uri"), h.get("warc-type"),
                            _page_of(h.get("warc-refers-to", "")), h.get("warc-payload-digest", "").removeprefix("sha1:"), len(body) if full else named, body if full else None,
                        ))
                    if len(rows) == 500 or held > 16 << 20:
                        yield packed(rows)
                        rows, held = [], 0
                file.close()
                if rows:
                    yield packed(rows)

    archives = max(1, manifest.count())
    return manifest.select("path").repartitionByRange(archives, "path").mapInArrow(tidy(run), schema)
