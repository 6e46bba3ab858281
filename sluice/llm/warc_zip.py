"""WARC records in ZIP archives: written by tasks, read back by range without extraction.

An archive is a ZIP file with two *stored* members: ``archive/data.warc.gz``,
one gzip member per WARC record, and ``indexes/index.cdx``, a JSON line per
record with its offset and length inside the data member. The reader parses the
end record, the ZIP64 locator and record where sizes or offsets need them, and
the central directory; finds a member's data behind its local header; and reads
single records, neighbours together, as byte ranges of the archive.

Archives lie in the shared folder (see ``_common.scratch_dir``) or in a folder
given by the caller, reached through Arrow's file systems (file, hdfs, s3 ...).
A task names its files itself, by a fresh random name, and returns the names;
only names in the written manifest count, so a repeated task does no harm.

Defined results: null payload is empty; null urls are written as empty; rows
that repeat id and payload are alike; with null ids only, a group's rows are
all responses; an empty table writes no archive and gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, scratch_dir, small_batches, table

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
MIN_REVISIT = 100
#: Duplicate groups are broadcast up to this many rows (48 bytes each); beyond, they are joined by a shuffle.
BROADCAST_GROUPS = 100_000
_LIMIT32 = 0xFFFFFFFF


def open_fs(uri: str):
    """(file system, path) of a URI or a local path."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


class ZipWriter:
    """Stored members only. ZIP64 fields appear where a number needs them, or everywhere with ``zip64=True``."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.entries, self.zip64 = out, 0, [], zip64

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, parts: list[bytes]) -> None:
        crc, size = 0, 0
        for p in parts:
            crc, size = zlib.crc32(p, crc), size + len(p)
        raw, offset = name.encode(), self.at
        wide = self.zip64 or size >= _LIMIT32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        small = _LIMIT32 if wide else size
        self._write(struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45 if wide else 20, 0x800, 0, 0, 0x21, crc, small, small, len(raw), len(extra)) + raw + extra)
        for p in parts:
            self._write(p)
        self.entries.append((raw, crc, size, offset))

    def close(self) -> None:
        start = self.at
        for raw, crc, size, offset in self.entries:
            wide = self.zip64 or max(size, offset) >= _LIMIT32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset) if wide else b""
            small, where = (_LIMIT32, _LIMIT32) if wide else (size, offset)
            head = struct.pack(
                "<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, small, small, len(raw), len(extra), 0, 0, 0, 0, where
            )
            self._write(head + raw + extra)
        length, n = self.at - start, len(self.entries)
        if self.zip64 or max(start, length) >= _LIMIT32 or n >= 0xFFFF:
            record = self.at
            self._write(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, length, start))
            self._write(struct.pack("<4sIQI", b"PK\6\7", 0, record, 1))
            n, length, start = 0xFFFF, _LIMIT32, _LIMIT32
        self._write(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, n, n, length, start, 0))


class ZipReader:
    """Members of a ZIP archive by byte range. ``source`` needs ``size()``, ``seek`` and ``read``."""

    def __init__(self, source):
        self.source, self.length = source, source.size()
        self.members = {e[0]: e[1:] for e in self._directory()}

    def range(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        data = self.source.read(n)
        if len(data) != n:
            raise ValueError(f"archive ends at {at + len(data)}, wanted {at + n}")
        return bytes(data)

    def _directory(self):
        span = min(self.length, 22 + 0xFFFF)
        tail = self.range(self.length - span, span)
        k = tail.rfind(b"PK\5\6")
        while k >= 0 and k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != len(tail):
            k = tail.rfind(b"PK\5\6", 0, k)
        if k < 0:
            raise ValueError("no end of central directory")
        n, length, start = struct.unpack_from("<HII", tail, k + 10)
        end = self.length - span + k
        if end >= 20 and self.range(end - 20, 4) == b"PK\6\7":
            (record,) = struct.unpack("<Q", self.range(end - 12, 8))
            body = self.range(record, 56)
            if body[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 end record where its locator points")
            n, length, start = struct.unpack_from("<QQQ", body, 32)
        data, at = self.range(start, length), 0
        for _ in range(n):
            if data[at : at + 4] != b"PK\1\2":
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            crc, packed, size, name_n, extra_n, note_n = struct.unpack_from("<IIIHHH", data, at + 16)
            (offset,) = struct.unpack_from("<I", data, at + 42)
            name = data[at + 46 : at + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
            extra = data[at + 46 + name_n : at + 46 + name_n + extra_n]
            while len(extra) >= 4:
                kind, k = struct.unpack_from("<HH", extra)
                if kind == 1:
                    wide = list(struct.unpack_from(f"<{k // 8}Q", extra, 4))
                    size = wide.pop(0) if size == _LIMIT32 else size
                    packed = wide.pop(0) if packed == _LIMIT32 else packed
                    offset = wide.pop(0) if offset == _LIMIT32 else offset
                extra = extra[4 + k :]
            yield name, method, crc, packed, size, offset
            at += 46 + name_n + extra_n + note_n

    def locate(self, name: str) -> tuple[int, int]:
        """(offset, length) of a stored member's data in the archive."""
        method, _, packed, size, offset = self.members[name]
        if method != 0 or packed != size:
            raise ValueError(f"{name} is not stored: records in it have no byte ranges of their own")
        head = self.range(offset, 30)
        if head[:4] != b"PK\3\4":
            raise ValueError(f"no local header for {name}")
        name_n, extra_n = struct.unpack_from("<HH", head, 26)
        return offset + 30 + name_n + extra_n, size

    def read(self, name: str) -> bytes:
        data = self.range(*self.locate(name))
        if zlib.crc32(data) != self.members[name][1]:
            raise ValueError(f"checksum of {name}")
        return data


def warc_record(kind: str, page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}:{url}')}>",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers and payload of one WARC record; the payload is None for a revisit."""
    at = data.index(b"\r\n\r\n")
    lines = data[:at].decode().split("\r\n")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = data[at + 4 : at + 4 + int(head["Content-Length"])]
    payload = block[block.index(b"\r\n\r\n") + 4 :] if head["WARC-Type"] == "response" else None
    return {"head": head, "payload": payload}


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _write_batches(folder: str, archive_bytes: int):
    """(page_id, url, payload, digest, record_type, refers_to) in; a manifest row per archive out."""

    def close(parts, index):
        fs, base = open_fs(folder)
        path = f"{base}/{uuid.uuid4().hex}.wacz"
        with fs.open_output_stream(path) as out:
            z = ZipWriter(out)
            z.add(DATA, parts)
            z.add(INDEX, ["\n".join(index).encode()])
            z.close()
        return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path.rpartition('/')[2]}"]), pa.array([len(index)])], names=["archive", "records"])

    def run(batches):
        parts, index, size = [], [], 0
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(6)), strict=True):
                page_id, url, payload, digest, kind, refers = (x.as_py() for x in row)
                record = _gzip(warc_record(kind, page_id, (url or "").replace("\r", "%0D").replace("\n", "%0A"), payload, digest, refers))
                index.append(json.dumps({"id": page_id, "url": url, "type": kind, "digest": digest, "offset": size, "length": len(record)}))
                parts.append(record)
                size += len(record)
                if size >= archive_bytes:
                    yield close(parts, index)
                    parts, index, size = [], [], 0
        if parts:
            yield close(parts, index)

    return run


def _runs(entries: list[dict], most: int = 8 << 20):
    """Index entries that stand side by side, up to ``most`` bytes, to be read as one range."""
    run: list[dict] = []
    for e in sorted(entries, key=lambda e: e["offset"]):
        if run and (run[-1]["offset"] + run[-1]["length"] != e["offset"] or e["offset"] + e["length"] - run[0]["offset"] > most):
            yield run
            run = []
        run.append(e)
    if run:
        yield run


def read_archive(uri: str, wanted=None):
    """(index entry, parsed record) of each record of an archive, or of those for which ``wanted(entry)`` holds."""
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as source:
        z = ZipReader(source)
        start, _ = z.locate(DATA)
        entries = [json.loads(x) for x in io.BytesIO(z.read(INDEX))]
        for run in _runs([e for e in entries if wanted is None or wanted(e)]):
            first = run[0]["offset"]
            data = z.range(start + first, run[-1]["offset"] + run[-1]["length"] - first)
            for e in run:
                at = e["offset"] - first
                yield e, parse_record(zlib.decompress(data[at : at + e["length"]], 31))


def _read_batches(batches):
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            rows = []
            for entry, record in read_archive(uri):
                head, payload = record["head"], record["payload"]
                digest, size = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                if payload is not None and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"record at {entry['offset']} of {uri} is damaged")
                page, refers = head["X-Page-Id"], head.get("X-Refers-To-Page")
                rows.append((int(page) if page else None, head["WARC-Target-URI"], payload, size, digest, head["WARC-Type"], int(refers) if refers else None))
                if len(rows) >= 256:
                    yield _records(rows)
                    rows = []
            if rows:
                yield _records(rows)


def _records(rows):
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


def write_archives(
    df: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = 32 << 20
) -> DataFrame:
    """Write a record per row; returns the manifest (archive, records), itself written so that archives are made once.

    Rows with equal payloads of at least 100 bytes become one response, that of the least id, and revisits of it.
    """
    spark = df.sparkSession
    small_batches(spark)
    if folder is None:
        folder = f"{scratch_dir(spark)}/wacz-{uuid.uuid4().hex}"
    fs, base = open_fs(folder)
    fs.create_dir(base, recursive=True)
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    big = F.octet_length("payload") >= MIN_REVISIT
    groups = rows.where(big).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = materialize(groups.select("digest", "first"), "warc-groups")
    few = groups.count() <= BROADCAST_GROUPS
    joined = rows.join(F.broadcast(groups) if few else groups, (rows.digest == groups.digest) & big, "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    ready = joined.select(
        "page_id", "url", "payload", rows.digest, F.when(again, "revisit").otherwise("response"), F.when(again, F.col("first"))
    )
    return materialize(ready.mapInArrow(_write_batches(folder, archive_bytes), "archive string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """All records of the archives named in column ``archive``: page_id, url, payload (null for revisits), payload_bytes,
    payload_digest, record_type, refers_to. An archive is the unit of work."""
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    spark = manifest.sparkSession
    width = max(1, min(manifest.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return manifest.select("archive").repartition(width).mapInArrow(_read_batches, schema)


def op5_warc_zip(spark, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(table(spark, sf_dir, "pages"))).drop("url", "payload")


QUERIES = {"op5_warc_zip": op5_warc_zip}

ORACLE_SQL = {
    "op5_warc_zip": """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest HAVING count(*) > 1
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN g.first IS NOT NULL AND p.page_id IS DISTINCT FROM g.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id IS DISTINCT FROM g.first THEN g.first END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes >= 100
"""
}
