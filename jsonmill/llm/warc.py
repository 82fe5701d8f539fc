"""WARC archives: a writer with revisit records and a reader that salvages what damage has left.

Files are written and read by Spark itself, so they may be in any store that
Spark knows.  The reader takes plain records and gzip members.  When a record
fails a check it looks for the next version line or gzip member that holds a
whole valid record, goes on from there, and reports the bytes between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialize

#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TYPES = {"warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation"}
DATE = "2024-01-01T00:00:00Z"
ID_PREFIX = "urn:jsonmill:page:"

#: Records of a file, and bytes of their payloads, at most: a file is read back whole.
RECORDS_PER_FILE, BYTES_PER_FILE = 2000, 1 << 28
#: The table of payloads that occur more than once is sent to all executors only up to so many rows.
BROADCAST_ROWS = 500_000


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One record with its closing two line ends.  A revisit keeps the HTTP head, and so the payload's length, without the payload."""
    digest = sha1_base32(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{ID_PREFIX}{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", _clean(url))] if url is not None else []),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{ID_PREFIX}{refers_to}>")] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(record: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


# --- reading ----------------------------------------------------------------------------------


class Damaged(ValueError):
    pass


@dataclass
class Record:
    offset: int
    size: int
    fields: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]

    @property
    def payload_bytes(self) -> int:
        found = re.search(rb"(?i)\r\ncontent-length: *(\d+)", self.block.partition(b"\r\n\r\n")[0])
        return int(found[1]) if found else len(self.payload)


_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_NEXT = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")


def _parse(data: bytes, at: int) -> tuple[Record, int]:
    """The plain record at `at` and where it ends; Damaged if a check fails."""
    line = _VERSION_LINE.match(data, at)
    if not line:
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", line.end() - 2)
    if end < 0:
        raise Damaged("head without end")
    fields: dict[str, str] = {}
    for row in data[line.end() : end].split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if not colon or not re.fullmatch(rb"[A-Za-z0-9-]+", name) or re.search(rb"[\x00-\x08\x0a-\x1f\x7f]", value):
            raise Damaged("head line without name or with controls")
        try:
            fields[name.decode().lower()] = value.strip().decode()
        except UnicodeDecodeError:
            raise Damaged("head line is not UTF-8") from None
    if not fields.get("content-length", "").isdigit() or not {"warc-type", "warc-record-id"} <= fields.keys():
        raise Damaged("head without length, type or id")
    if fields["warc-type"] not in TYPES:
        raise Damaged("unknown type")
    start, size = end + 4, int(fields["content-length"])
    block = data[start : start + size]
    if len(block) < size or data[start + size : start + size + 4] != b"\r\n\r\n":
        raise Damaged("block does not end where its length says")
    record = Record(at, start + size + 4 - at, fields, block)
    for name, part in (("warc-block-digest", block), ("warc-payload-digest", record.payload if fields["warc-type"] == "response" else None)):
        if part is not None and fields.get(name, "").startswith("sha1:") and fields[name][5:] != sha1_base32(part):
            raise Damaged(f"{name} differs")
    return record, start + size + 4


#: Bytes of a gzip member that are decompressed at once.
FIRST_PIECE, PIECE = 1 << 10, 1 << 16


def _inflate(data: bytes, at: int, want: int | None = None) -> tuple[bytes, int, str | None]:
    """What the gzip member at `at` decompresses to as far as it is whole, where the reading ended, and what is wrong.

    With `want` it ends at the first byte that brings so much content.
    """
    d, out, size, view, step = zlib.decompressobj(31), [], 0, memoryview(data), FIRST_PIECE
    while at < len(data) and not d.eof:
        # pieces grow, so that a small member does not drag what follows along as unused data
        before, piece = d.copy(), view[at : at + step]
        step = min(4 * step, PIECE)
        try:
            got = d.decompress(piece)
            if want is None or size + len(got) < want:
                out.append(got)
                size += len(got)
                at += len(piece) - len(d.unused_data)
                continue
        except zlib.error:
            pass
        d = before  # byte by byte up to the place
        for k in range(len(piece)):
            try:
                got = d.decompress(piece[k : k + 1])
            except zlib.error as e:
                return b"".join(out), at + k, f"gzip: {e}"
            out.append(got)
            size += len(got)
            if want is not None and size >= want:
                return b"".join(out), at + k + 1, None
        at += len(piece)
    return b"".join(out), at, None if d.eof else "gzip: member cut off"


def _checked(r: Record) -> bool:
    """Whether the block has a digest, which _parse() has compared."""
    return r.fields.get("warc-block-digest", "").startswith("sha1:")


def _member(data: bytes, at: int) -> tuple[list[Record | tuple[int, int, str]], int, str | None]:
    """The records of the gzip member at `at` and the gaps between them, where they end, and why the rest of it is no good.

    Content before damage to the compressed bytes may be wrong as well: of it
    only records with a block digest are taken.
    """
    inner, end, wrong = _inflate(data, at)
    found = list(read_records(inner, inside=True))
    if wrong and wrong != "gzip: member cut off":
        found = [r for r in found if isinstance(r, tuple) or _checked(r)]
    records = [r for r in found if not isinstance(r, tuple)]
    if not records:
        raise Damaged(wrong or next((f"gzip: {r[2]}" for r in found), "gzip: member without record"))
    if wrong:
        last = records[-1].offset + records[-1].size
        found = [r for r in found if not isinstance(r, tuple) or r[0] < last]
        end = _inflate(data, at, last)[1]
        # the last bits of a member that was cut off can come from the first bytes of what follows
        further = _NEXT.search(data, max(at + 1, end - 8), end + 10)
        end = min(end, further.start()) if further else end
    out: list[Record | tuple[int, int, str]] = []
    for r in found:
        if isinstance(r, tuple):
            out.append((at, end - at, f"gzip: bytes {r[0]} to {r[0] + r[1]} of the member: {r[2]}"))
        else:
            out.append(Record(at, end - at, r.fields, r.block))
    return out, end, wrong


def read_records(data: bytes, inside: bool = False) -> Iterator[Record | tuple[int, int, str]]:
    """The records of an archive in order, and (offset, length, reason) of each gap that had to be left out.

    A gap inside a gzip member has the member's offset and length.  inside: data
    is the content of a member, which has plain records only.
    """
    at, marks = 0, _VERSION_LINE if inside else _NEXT
    gap: tuple[int, str] | None = None
    while at < len(data):
        wrong = None
        try:
            if not inside and data.startswith(b"\x1f\x8b\x08", at):
                found, end, wrong = _member(data, at)
            else:
                one, end = _parse(data, at)
                found = [one]
        except Damaged as e:
            gap = gap or (at, str(e))
            further = marks.search(data, at + 1)
            at = further.start() if further else len(data)
            continue
        if gap:
            yield gap[0], at - gap[0], gap[1]
            gap = None
        yield from found
        at = end
        if wrong:
            gap = (end, wrong)
            further = marks.search(data, end)
            at = further.start() if further else len(data)
    if gap:
        yield gap[0], len(data) - gap[0], gap[1]


# --- on Spark ---------------------------------------------------------------------------------


def _record_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            rows = zip(*(part.column(k).to_pylist() for k in range(5)), strict=True)
            out = [encode_record(i, u, p or b"", r, v)[:-1] for i, u, p, r, v in rows]  # the sink adds the last line end
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0
) -> None:
    """Writes a record per row as files of plain WARC under path.

    Of rows with equal payloads of min_revisit_bytes at least, those with the
    largest id are responses and the others revisit it.  A null payload is
    empty, a null url leaves its field out, a null id is the smallest of all
    (and a response only if no row with that payload has an id); repeated rows
    are records of their own; an empty table gives a folder without records.
    Only digests are shuffled, never payloads, as long as the repeated digests
    are few.  A file has as many records as BYTES_PER_FILE holds of the longest.
    """
    p = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload")
    )
    keyed = p.withColumn("digest", F.unhex(F.sha1("payload")))
    again = materialize(
        keyed.filter(F.octet_length("payload") >= min_revisit_bytes)
        .groupBy("digest")
        .agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 AND top IS NOT NULL")
        .select(F.col("digest").alias("known"), "top"),
        "warc-again",
    )
    if again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    rows = keyed.join(again, F.col("digest") == F.col("known"), "left").select(
        "id", "url", "payload", "top", (F.col("top").isNotNull() & ~F.col("id").eqNullSafe(F.col("top"))).alias("revisit")
    )
    text = rows.mapInArrow(_record_batches, "value binary").select(F.col("value").cast("string"))
    longest = p.agg(F.max(F.octet_length("payload"))).first()[0] or 1
    text.write.option("lineSep", "\n").option("maxRecordsPerFile", max(1, min(RECORDS_PER_FILE, BYTES_PER_FILE // longest))).text(path)


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def page(value: str | None) -> int | None:
        digits = (value or "").strip("<>").removeprefix(ID_PREFIX)
        return int(digits) if re.fullmatch(r"-?\d+", digits) else None

    for b in batches:
        for k in range(b.num_rows):
            name, rows = b.column(0)[k].as_py(), []
            for r in read_records(b.column(1)[k].as_py()):
                if isinstance(r, tuple):
                    rows.append((name, *r[:2], r[2], None, None, None, None, None, None))
                    continue
                kind = r.fields["warc-type"]
                digest = sha1_base32(r.payload) if kind == "response" else r.fields.get("warc-payload-digest", "").removeprefix("sha1:")
                size = len(r.payload) if kind == "response" else r.payload_bytes
                rows.append((name, r.offset, r.size, None, page(r.fields["warc-record-id"]), kind, r.fields.get("warc-target-uri"), digest, size, page(r.fields.get("warc-refers-to"))))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 10
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=NAMES)


NAMES = ["file", "offset", "size", "gap_reason", "page_id", "record_type", "url", "payload_digest", "payload_bytes", "refers_to"]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record, and per quarantined gap one with gap_reason and the bytes' offset and size.

    An empty folder gives none; records() and gaps() tell the two apart.  Files
    may be plain or gzip, of one record a member or many.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(
        _read_batches,
        "file string, offset long, size long, gap_reason string, page_id long, record_type string, url string, payload_digest string, payload_bytes long, refers_to long",
    )


def records(read: DataFrame) -> DataFrame:
    """The records of read_archives()."""
    return read.filter("gap_reason IS NULL")


def gaps(read: DataFrame) -> DataFrame:
    """The quarantine log: file, offset, size and gap_reason of the bytes that were left out."""
    return read.filter("gap_reason IS NOT NULL").select("file", "offset", "size", "gap_reason")


def archive_path(spark: SparkSession) -> str:
    return fresh_path(spark, "warc")
