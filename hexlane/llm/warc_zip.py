"""WARC records in ZIP packages: written by Spark tasks into the shared folder, read back by byte ranges.

A package holds stored (uncompressed) members: archive/data.warc and indexes/index.cdxj. The reader parses the end record
and the central directory, with their ZIP64 forms, finds the members and range-reads records; nothing is extracted.
Files are opened through pyarrow's file systems by URI, so the shared folder may be any store it knows.

Nulls and edges: a null html is an empty payload, a null url an empty URI, a null page_id stays null and never is what a
revisit refers to; rows that share the largest page_id of equal payloads are all responses; an empty table gives an empty
result. Only page_id, url and html are read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, small_batches, table, written

LEAST_REVISIT_BYTES = 1000
PACKAGE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
BROADCAST_ROWS = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def marked(pages: DataFrame) -> DataFrame:
    """Pages with payload digest, length, and refers_to (null for responses)."""
    body = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select("page_id", "url", body.alias("html"), F.sha1(F.encode(body, "UTF-8")).alias("digest"), F.octet_length(body).alias("n_bytes"))
    groups = pages.where(F.col("n_bytes") >= LEAST_REVISIT_BYTES).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("first"))
    groups = written(groups.where("n > 1").select("digest", "first"), "warc-groups")
    if groups.count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    refers = F.when(F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull()), F.col("first"))
    return pages.join(groups, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def record(page_id: int | None, url: str | None, body: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http + (body if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Package:
    """One ZIP package being written under a name of its own; it appears under its final name when complete."""

    def __init__(self, folder: str):
        self.store, path = fs.FileSystem.from_uri(folder)
        self.store.create_dir(path, recursive=True)
        self.uri = f"{folder}/{uuid.uuid4().hex}.wacz"
        self.path = f"{path}/{self.uri.rsplit('/', 1)[1]}"
        self.raw = self.store.open_output_stream(self.path + ".part")
        self.zip = zipfile.ZipFile(self.raw, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open("archive/data.warc", "w", force_zip64=True)
        self.lines: list[str] = []
        self.at = 0

    def add(self, content: bytes) -> None:
        self.data.write(content)
        self.lines.append(json.dumps({"offset": self.at, "length": len(content)}))
        self.at += len(content)

    def close(self) -> tuple[str, int]:
        self.data.close()
        self.zip.writestr("indexes/index.cdxj", "\n".join(self.lines))
        self.zip.close()
        self.raw.close()
        self.store.move(self.path + ".part", self.path)
        return self.uri, len(self.lines)


def write_packages(pages: DataFrame, folder: str) -> DataFrame:
    """Write marked pages; one row (uri, records) for each complete package. Rows of lost tasks name no package."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, package = [], None
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                package = package or Package(folder)
                package.add(record(page_id, url, html.encode(), digest, refers_to))
                if package.at >= PACKAGE_BYTES:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["uri", "records"])

    return pages.mapInArrow(task, "uri string, records long")


def read_at(file: pa.NativeFile, at: int, n: int) -> bytes:
    file.seek(at)
    return file.read(n)


def members(file: pa.NativeFile) -> dict[str, tuple[int, int]]:
    """(data offset, size) of each stored member, from the central directory alone."""
    size = file.size()
    tail_at = max(0, size - 65557)
    tail = read_at(file, tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6")
    if end < 0:
        raise ValueError("no end of central directory")
    entries, length, start = struct.unpack_from("<HII", tail, end + 10)
    if entries == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        if tail[end - 20 : end - 16] != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        (where,) = struct.unpack_from("<Q", tail, end - 12)
        record64 = read_at(file, where, 56)
        if record64[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end of central directory")
        entries, length, start = struct.unpack_from("<QQQ", record64, 32)
    directory, at, out = read_at(file, start, length), 0, {}
    for _ in range(entries):
        if directory[at : at + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        method, packed, full, n_name, n_extra, n_comment, local = struct.unpack_from("<10xH8xIIHHH8xI", directory, at)
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra, wide = directory[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while wide + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, wide)
            if tag == 1:
                field = wide + 4
                if full == 0xFFFFFFFF:
                    (full,) = struct.unpack_from("<Q", extra, field)
                    field += 8
                if packed == 0xFFFFFFFF:
                    (packed,) = struct.unpack_from("<Q", extra, field)
                    field += 8
                if local == 0xFFFFFFFF:
                    (local,) = struct.unpack_from("<Q", extra, field)
            wide += 4 + n
        if method == 0:
            n_name_here, n_extra_here = struct.unpack("<HH", read_at(file, local + 26, 4))
            out[name] = (local + 30 + n_name_here + n_extra_here, full)
        at += 46 + n_name + n_extra + n_comment
    return out


def open_uri(uri: str) -> pa.NativeFile:
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte ranges of whole records, of RANGE_BYTES or one record each, from the packages' indexes."""
    for batch in batches:
        rows: list[tuple[str, int, list[int]]] = []
        for uri in batch.column(0).to_pylist():
            with open_uri(uri) as file:
                inside = members(file)
                for name in (n for n in inside if n.startswith("archive/")):
                    base = inside[name][0]
                    index = read_at(file, *inside["indexes/index.cdxj"]).decode()
                    run: list[int] = []
                    start = 0
                    for line in filter(None, index.split("\n")):
                        entry = json.loads(line)
                        if run and sum(run) + entry["length"] > RANGE_BYTES:
                            rows.append((uri, base + start, run))
                            run = []
                        if not run:
                            start = entry["offset"]
                        run.append(entry["length"])
                    if run:
                        rows.append((uri, base + start, run))
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.list_(pa.int64())))]
        yield pa.RecordBatch.from_arrays(columns, ["uri", "at", "lengths"])


def parse(content: bytes) -> tuple:
    """page_id, url, record type, payload or None, its length, digest, refers_to of one record."""
    head, _, block = content.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    length = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(body) != length or hashlib.sha1(body).hexdigest() != digest):
        raise ValueError("payload differs from its digest")
    number = lambda x: None if x is None or x == "<urn:page:none>" else int(x[10:-1])
    return number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, body if kind == "response" else None, length, digest, number(fields.get("WARC-Refers-To"))


RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])


def read_packages(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """All records of the packages in a manifest; without payload, that column is null (it is checked all the same)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, at, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open_uri(uri) as file:
                    content = read_at(file, at, sum(lengths))
                rows, here = [], 0
                for n in lengths:
                    row = parse(content[here : here + n])
                    rows.append(row if payload else (*row[:3], None, *row[4:]))
                    here += n
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(RECORDS)], schema=RECORDS)

    ranges = manifest.select("uri").repartition(2 * manifest.sparkSession.sparkContext.defaultParallelism).mapInArrow(locate, "uri string, at long, lengths array<long>")
    ranges = ranges.repartition(4 * manifest.sparkSession.sparkContext.defaultParallelism)
    return ranges.mapInArrow(task, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back."""
    small_batches(spark)
    manifest = written(write_packages(marked(table(spark, sf_dir, "pages")), fresh_path(spark, "packages")), "manifest")
    return read_packages(manifest, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS n, sha1(h) AS d FROM p),
     g AS (SELECT d, max(page_id) AS m FROM q WHERE n >= 1000 GROUP BY d HAVING count(*) > 1)
SELECT page_id, n AS payload_bytes, q.d AS payload_digest,
       CASE WHEN m IS NULL OR page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN m IS NULL OR page_id = m THEN NULL ELSE m END AS refers_to
FROM q LEFT JOIN g ON q.d = g.d AND n >= 1000
"""
