"""WARC records in ZIP-packaged archives: a writer, and a reader that never extracts.

An archive is a ZIP file with two stored members: ``archive/data.warc.gz``,
one gzip member per record, and ``indexes/index.cdx``, one line per record
with its place in the first.  The reader parses the end record, the ZIP64
locator and directory where there is one, and the central directory; finds the
place of stored members; reads the index by range; and then reads records by
range, in tasks of bounded bytes.  Members that are compressed are refused.

Files are opened through pyarrow's file systems, by URI, in a folder that
driver and executors share.  A task that is run again writes files under new
names, and only the files that successful tasks report are read.

Of records with equal payloads of at least ``least`` bytes the one with the
smallest page id is a response, the others revisit it; smaller ones are all
responses.  Defined results: a null html is an empty payload; a null url has
no header; a null page id is written without one, read back as null, and
revisits where it can; rows that repeat the smallest page id with the same
payload are all responses; extra columns are ignored; no rows, no archives.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint, small

WARC_MEMBER = "archive/data.warc.gz"
INDEX_MEMBER = "indexes/index.cdx"
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 4 << 20
TASK_RANGES = 2
SALTS = 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# ZIP signatures and sentinels (fixed values of the format)
END, END_64, LOCATOR_64, CENTRAL, LOCAL = 0x06054B50, 0x06064B50, 0x07064B50, 0x02014B50, 0x04034B50
FULL_16, FULL_32 = 0xFFFF, 0xFFFFFFFF


class ZipDirectory:
    """Members of a ZIP file, from its directories alone: name -> (method, size, local header's place)."""

    def __init__(self, file, size: int):
        self.file = file
        tail_at = max(0, size - (22 + FULL_16 + 20))
        tail = self._read(tail_at, size - tail_at)
        # a comment may hold the signature: the end record is the one whose comment ends the file
        mark = struct.pack("<I", END)
        at = tail.rfind(mark)
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(mark, 0, at)
        if at < 0:
            raise ValueError("no end record: not a ZIP file")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        place = tail_at + at
        if (count == FULL_16 or FULL_32 in (length, start)) and place >= 20:
            locator = self._read(place - 20, 20)
            if struct.unpack_from("<I", locator)[0] == LOCATOR_64:
                record = self._read(struct.unpack_from("<Q", locator, 8)[0], 56)
                if struct.unpack_from("<I", record)[0] != END_64:
                    raise ValueError("broken ZIP64 end record")
                count, length, start = struct.unpack_from("<QQQ", record, 32)
        self.members: dict[str, tuple[int, int, int]] = {}
        data, at = self._read(start, length), 0
        for _ in range(count):
            if struct.unpack_from("<I", data, at)[0] != CENTRAL:
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            packed, full = struct.unpack_from("<II", data, at + 20)
            n_name, n_extra, n_comment = struct.unpack_from("<HHH", data, at + 28)
            header = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46:at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = data[at + 46 + n_name:at + 46 + n_name + n_extra]
            packed, header = self._wide(extra, full, packed, header)
            self.members[name] = (method, packed, header)
            at += 46 + n_name + n_extra + n_comment

    def _read(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        return self.file.read(length)

    @staticmethod
    def _wide(extra: bytes, full: int, packed: int, header: int) -> tuple[int, int]:
        """64-bit values stand in the ZIP64 field for those that are all ones, in this order."""
        at = 0
        while at + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                inside = at + 4
                for which, value in enumerate((full, packed, header)):
                    if value == FULL_32:
                        wide = struct.unpack_from("<Q", extra, inside)[0]
                        inside += 8
                        packed, header = (wide if which == 1 else packed), (wide if which == 2 else header)
            at += 4 + length
        return packed, header

    def stored(self, name: str) -> tuple[int, int]:
        """(place, size) of a stored member's bytes."""
        method, size, header = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed: it can't be read by range")
        local = self._read(header, 30)
        if struct.unpack_from("<I", local)[0] != LOCAL:
            raise ValueError(f"{name} has no local header")
        return header + 30 + sum(struct.unpack_from("<HH", local, 26)), size


class _Sink(io.RawIOBase):
    """A write-only stream for the ZIP writer, counting bytes."""

    def __init__(self, out):
        self.out, self.count = out, 0

    def write(self, data) -> int:
        self.out.write(bytes(data))
        self.count += len(data)
        return len(data)

    def writable(self) -> bool:
        return True


def record_bytes(page: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, revisit: bool) -> bytes:
    """One WARC record, gzipped on its own.  A revisit keeps the HTTP header, so the payload's length, and no payload."""
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {digest}')}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    if page is not None:
        head.append(("X-Page-ID", quote(page, safe=" /:=&?~#+!$,;'@()*[]")))
    head.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-ID", quote(refers_to or "", safe=" /:=&?~#+!$,;'@()*[]"))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(text.encode()) + packer.compress(body) + packer.compress(b"\r\n\r\n") + packer.flush()


def parse_record(data: bytes) -> dict[str, object]:
    """Headers, payload (None for a revisit), its length and digest of one gzipped record."""
    raw = zlib.decompress(data, 31)
    cut = raw.index(b"\r\n\r\n")
    lines = raw[:cut].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    block = raw[cut + 4:cut + 4 + int(head["Content-Length"])]
    inner = block.index(b"\r\n\r\n")
    http = dict(x.split(": ", 1) for x in block[:inner].decode().split("\r\n")[1:])
    revisit = head["WARC-Type"] == "revisit"
    payload = None if revisit else block[inner + 4:]
    stated = head["WARC-Payload-Digest"].removeprefix("sha256:")
    if payload is not None and hashlib.sha256(payload).hexdigest() != stated:
        raise ValueError("payload and digest differ")
    page = unquote(head["X-Page-ID"]) if "X-Page-ID" in head else None
    return {"page": page, "record_type": head["WARC-Type"], "url": head.get("WARC-Target-URI"), "refers_to": unquote(head.get("X-Refers-To-Page-ID", "")) or None, "payload": payload, "payload_bytes": int(http["Content-Length"]), "payload_digest": stated}


class ArchiveWriter:
    """One archive; add records, then close."""

    def __init__(self, folder: str, name: str):
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        self.path = f"{folder.rstrip('/')}/{name}"
        self.out = system.open_output_stream(f"{root.rstrip('/')}/{name}")
        self.zip = zipfile.ZipFile(_Sink(self.out), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(WARC_MEMBER), "w", force_zip64=True)
        self.size, self.index = 0, []

    def add(self, record: bytes, kind: str) -> None:
        self.member.write(record)
        self.index.append(f"{self.size} {len(record)} {kind}\n")
        self.size += len(record)

    def close(self) -> None:
        self.member.close()
        with self.zip.open(zipfile.ZipInfo(INDEX_MEMBER), "w", force_zip64=True) as member:
            member.write("".join(self.index).encode())
        self.zip.close()
        self.out.close()


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100) -> DataFrame:
    """(page, url, html, digest, refers_to, revisit): equal payloads meet by digest, without their texts."""
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    same = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    same = checkpoint(same)
    bounded = small(same, 200_000)
    if bounded is not same:
        joined = rows.join(bounded, "digest", "left")
    else:  # a digest may have a large part of the rows: spread each over salts
        salted = same.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    return joined.select("page", "url", "html", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the rows of with_revisits() into archives under the URI ``folder``; (path, n_records, n_bytes), already run."""
    rows = records.select(F.col("page").cast("string").alias("page"), "url", "html", "digest", F.col("refers_to").cast("string").alias("refers_to"), "revisit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in batches:
            for page, url, html, digest, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    writer = ArchiveWriter(folder, f"{uuid.uuid4().hex}.wacz")
                writer.add(record_bytes(page, url, html.encode(), digest, refers_to, revisit), "revisit" if revisit else "response")
                if writer.size >= archive_bytes:
                    writer.close()
                    done.append(writer)
                    writer = None
        if writer is not None:
            writer.close()
            done.append(writer)
        yield pa.RecordBatch.from_arrays([pa.array([w.path for w in done], pa.string()), pa.array([len(w.index) for w in done], pa.int64()), pa.array([w.size for w in done], pa.int64())], names=["path", "n_records", "n_bytes"])

    return checkpoint(rows.mapInArrow(run, "path string, n_records bigint, n_bytes bigint"))


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def read_archives(archives: DataFrame, read_bytes: int = READ_BYTES) -> DataFrame:
    """(page string, record_type, url, refers_to string, payload binary, payload_bytes, payload_digest) of every record.

    ``archives`` has the files' URIs in ``path`` and their sizes in ``n_bytes``.  Directories and indexes are read
    first; records then come in ranges of about ``read_bytes``.
    """

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with _open(path) as file:
                    zipped = ZipDirectory(file, file.size())
                    base, _ = zipped.stored(WARC_MEMBER)
                    at, size = zipped.stored(INDEX_MEMBER)
                    index = [tuple(map(int, x.split()[:2])) for x in zipped._read(at, size).splitlines()]
                places, lengths, total = [], [], 0
                for place, length in [*index, (0, read_bytes)]:  # the last only ends the last range
                    if places and total + length > read_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([base + places[0]], pa.int64()), pa.array([lengths], pa.list_(pa.int64()))], names=["path", "start", "lengths"])
                        places, lengths, total = [], [], 0
                    places.append(place)
                    lengths.append(length)
                    total += length

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page", "record_type", "url", "refers_to", "payload", "payload_bytes", "payload_digest"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string()]
        for batch in batches:
            for path, start, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _open(path) as file:
                    file.seek(start)
                    data, at, found = file.read(sum(lengths)), 0, []
                    for length in lengths:
                        found.append(parse_record(data[at:at + length]))
                        at += length
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], k) for n, k in zip(names, kinds, strict=True)], names=names)

    ranges = archives.select("path").mapInArrow(plan, "path string, start bigint, lengths array<bigint>")
    # ranges are small rows that stand for much reading: a count of tasks by bytes, which is not coalesced
    n_bytes = archives.agg(F.sum("n_bytes")).first()[0] or 0
    spread = ranges.repartition(max(1, -(-n_bytes // (TASK_RANGES * read_bytes))), "path", "start")
    return spread.mapInArrow(read, "page string, record_type string, url string, refers_to string, payload binary, payload_bytes bigint, payload_digest string")
