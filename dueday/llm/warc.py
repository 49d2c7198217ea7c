"""WARC archives: a writer, and a reader that salvages what damaged files still hold."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .textblocks import small_batches, tidy

MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
REQUIRED = {"warc-type", "warc-record-id", "warc-date", "content-length"}
FILE_RECORDS, FILE_BYTES = 4_000, 256 << 20  # of a written file: at most, and payload on average
SLICE = 1 << 14  # bytes unpacked at once: what a member leaves over is copied
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "<urn:page:%s>"


def gzip_member(data: bytes, level: int = 3) -> bytes:
    """One gzip member without a time stamp, so equal input gives equal bytes."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


#: The text sink writes a separator after every record; an empty member is one that gzip readers pass over.
EMPTY_MEMBER = gzip_member(b"")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """A response record, or a revisit record of the payload that another page holds."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {ID % ('none' if page_id is None else page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {ID % refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    size: int  # bytes of the record in what it was read from


@dataclass
class Salvage:
    """Records as (offset, length, inner, record), and gaps as (offset, length, inner).

    ``inner`` is the place inside the unpacked bytes of the member at ``offset``, None for what is not
    packed. A record's length is that of its member; a gap with an ``inner`` counts unpacked bytes.
    """

    records: list[tuple[int, int, int | None, Record]] = field(default_factory=list)
    gaps: list[tuple[int, int, int | None]] = field(default_factory=list)


class Finder:
    """The next place of a pattern, looked for only once the last one is passed: one walk over the data."""

    def __init__(self, data: bytes, pattern: bytes):
        self.data, self.pattern, self.found = data, pattern, -1

    def next(self, at: int) -> int:
        if self.found < at:
            found = self.data.find(self.pattern, at)
            self.found = found if found >= 0 else len(self.data)
        return self.found


def parse_record(data: bytes, at: int = 0, blank: Finder | None = None) -> Record | None:
    """The record that starts at ``at``, if its headers, length, digest and end are all right."""
    if not data.startswith(VERSION, at):
        return None
    stop = (blank or Finder(data, b"\r\n\r\n")).next(at)
    if stop >= len(data):
        return None
    first, *lines = data[at:stop].split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.\d+", first):
        return None
    headers = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not REQUIRED <= headers.keys():
        return None
    length = headers["content-length"]
    if not re.fullmatch(r"[0-9]{1,15}", length):
        return None
    begin, end = stop + 4, stop + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return None
    block = data[begin:end]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != base32_sha1(block):
        return None
    return Record(headers, block, end + 4 - at)


def _unpacked(data: bytes, at: int) -> tuple[bytes, int | None]:
    """What the gzip member at ``at`` holds, as far as it can be unpacked, and its length; None if it is damaged or cut off."""
    unpacker, plain, to, view = zlib.decompressobj(31), [], at, memoryview(data)
    while not unpacker.eof:
        piece = view[to : to + SLICE]
        if not piece:
            return b"".join(plain), None
        try:
            plain.append(unpacker.decompress(piece))
        except zlib.error:
            # once more byte by byte, up to the damage
            return b"".join(plain) + _up_to_damage(data, at, to), None
        to += len(piece)
    return b"".join(plain), to - len(unpacker.unused_data) - at


def _up_to_damage(data: bytes, at: int, sure: int) -> bytes:
    """What the slice that begins at ``sure`` still gives before the damage."""
    unpacker, view, out = zlib.decompressobj(31), memoryview(data), []
    for to in range(at, sure, SLICE):
        unpacker.decompress(view[to : min(to + SLICE, sure)])
    for to in range(sure, min(sure + SLICE, len(data)), 64):
        try:
            out.append(unpacker.decompress(view[to : to + 64]))
        except zlib.error:
            break
    return b"".join(out)


def _records_in(plain: bytes) -> tuple[list[tuple[int, Record]], list[tuple[int, int]]]:
    """Records of unpacked bytes with their places, and (place, length) of what is none."""
    version, blank = Finder(plain, VERSION), Finder(plain, b"\r\n\r\n")
    records, gaps, at, good = [], [], 0, 0
    while at < len(plain):
        found = parse_record(plain, at, blank)
        if found is None:
            at = version.next(at + 1)
            continue
        if at > good:
            gaps.append((good, at - good))
        records.append((at, found))
        at = good = at + found.size
    if good < len(plain):
        gaps.append((good, len(plain) - good))
    return records, gaps


def salvage(data: bytes) -> Salvage:
    """Read records and gzip members one after another. Where a check fails, go on at
    the next member or version line that passes, and note the bytes between as a gap.

    A member may hold any number of records, and what can be unpacked of a damaged one is searched like a
    plain file: its whole records are kept, its own bytes are a gap in the file. Bytes of a whole member that are
    no record are a gap inside it. Work grows with the bytes read, not with their square.
    """
    out, at, gap = Salvage(), 0, None
    magic, version, blank = Finder(data, MAGIC), Finder(data, VERSION), Finder(data, b"\r\n\r\n")

    saved: set[tuple[str, bytes]] = set()  # from damaged members of the open gap; stored bytes may show them again

    def close(to: int) -> None:
        nonlocal gap
        if gap is not None:
            out.gaps.append((gap, to - gap, None))
            gap = None
            saved.clear()

    while at < len(data):
        size = None
        if data.startswith(MAGIC, at):
            plain, size = _unpacked(data, at)
            records, gaps = _records_in(plain)
            if size is not None and (records or not plain):
                close(at)
                out.records += [(at, size, inner, r) for inner, r in records]
                out.gaps += [(at, length, inner) for inner, length in gaps]
            elif size is not None:
                size = None  # a member without any record
            else:
                out.records += [(at, 0, inner, r) for inner, r in records]
                saved |= {(r.headers["warc-record-id"], r.block) for _, r in records}
        else:
            found = parse_record(data, at, blank)
            if found and (found.headers["warc-record-id"], found.block) not in saved:
                size = found.size
                close(at)
                out.records.append((at, size, None, found))
        if size is not None:
            at += size
            continue
        gap = at if gap is None else gap
        at = min(magic.next(at + 1), version.next(at + 1))
    close(len(data))
    return out


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0
) -> None:
    """A gzip member a row, in files of bounded size under ``path``.

    Of rows with equal payloads of at least ``least`` bytes the one with the largest
    id is a response and the others revisit it. Null html is an empty payload, a
    null url no address. Rows that repeat the largest id are responses too; rows
    without an id are revisits if another page holds the payload.

    Payloads are told apart by SHA-1 and length; only digests are grouped. Keepers of
    payloads that occur more than once are written, so Spark broadcasts them if they
    are small by its own measure, and else splits the join.
    """
    small_batches(pages.sparkSession)
    payload = F.encode(F.coalesce(html_col, F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"),
        F.concat_ws(":", F.sha1(payload), F.octet_length(payload)).alias("digest"),
    )
    several = (
        rows.where(F.octet_length("payload") >= least).groupBy("digest")
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1 and keeper is not null")
        .select("digest", "keeper")
    )
    kept = rows.join(materialize(several, "payloads"), "digest", "left").select("page_id", "url", "payload", "keeper")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 512):
                members = []
                for row in batch.slice(k, 512).to_pylist():
                    keeper = None if row["keeper"] == row["page_id"] else row["keeper"]
                    members.append(gzip_member(record(row["page_id"], row["url"], row["payload"], keeper)))
                yield pa.record_batch([pa.array(members, pa.binary())], ["member"])

    members = kept.mapInArrow(tidy(write), "member binary").select(F.col("member").cast("string").alias("value"))
    size = rows.agg(F.avg(F.octet_length("payload"))).first()[0] or 0
    records = max(1, min(FILE_RECORDS, int(FILE_BYTES // max(size, 1))))
    writer = members.write.option("maxRecordsPerFile", records).option("encoding", "ISO-8859-1")
    writer.option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


def read_archives(spark: SparkSession, path: str, with_block: bool = True) -> DataFrame:
    """Records and gaps of all files under ``path``: (file, offset, length, inner, kind, page_id,
    record_type, refers_to, url, payload_bytes, payload_digest, block); kind is record or gap. ``inner``
    is the place inside the member at ``offset``; records saved from a damaged member have length 0.

    Files may be compressed member by member or plain, cut off or damaged. An
    empty folder or empty files give no rows. Records without a page id have a null one.
    """

    def number(text: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
        return int(found[1]) if found else None

    names = {
        "file": pa.string(), "offset": pa.int64(), "length": pa.int64(), "inner": pa.int64(), "kind": pa.string(), "page_id": pa.int64(),
        "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(),
        "payload_digest": pa.string(), "block": pa.binary(),
    }

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = salvage(content.as_buffer().to_pybytes())
                rows = [(file, at, size, inner, "gap", *[None] * 7) for at, size, inner in found.gaps]
                for at, size, inner, r in found.records:
                    head, _, body = r.block.partition(b"\r\n\r\n")
                    length = re.search(rb"(?im)^content-length:\s*(\d+)", head)
                    digest = r.headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    kind = r.headers.get("warc-type")
                    if kind == "response" and digest and digest != base32_sha1(body):
                        rows.append((file, at, size, inner, "gap", *[None] * 7))
                        continue
                    rows.append(
                        (file, at, size, inner, "record", number(r.headers.get("warc-record-id")), kind,
                         number(r.headers.get("warc-refers-to")), r.headers.get("warc-target-uri"),
                         int(length[1]) if length else len(body), digest, r.block if with_block else None)
                    )
                columns = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, names.values())], names=list(names))

    schema = (
        "file string, offset long, length long, inner long, kind string, page_id long, record_type string, refers_to long, "
        "url string, payload_bytes long, payload_digest string, block binary"
    )
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).select("path", "content")
    return files.mapInArrow(tidy(read), schema)
