"""WARC records in ZIP-packaged archives, written and read back by byte ranges.

An archive is a ZIP file with two stored members: ``archive/data.warc.gz``, all records, each a gzip
member of its own, and ``indexes/index.cdxj``, a line per record with its offset and length in the first. A reader needs
no extraction: it reads the end of the file, the central directory (in its 64-bit form where a
size or offset asks for that), the index member, and then only the record ranges.

``write_archives`` and ``read_records`` are Spark jobs: every partition writes archives of
``ARCHIVE_BYTES`` to the shared folder and reports them; only reported archives are read, so a task
that ran twice leaves no record twice. Reading deals index ranges of ``RANGE_BYTES`` to tasks.

Defined cases: a null or empty payload is a record without payload. A null url is written as an
empty target. A null page_id is kept; such a page is always a response and nothing refers to it.
Rows that repeat a page_id are written each; those that share the first one's payload are responses. An empty table
gives no archive and no rows. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewtide.session import scratch_path, stage_table

ARCHIVE_BYTES = 16 << 20
RANGE_BYTES = 4 << 20
LEAST_SHARED = 100
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the ZIP format.
_END, _END64, _LOCATOR64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a uri; a path without scheme is local."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


@dataclass
class Member:
    """A stored member: its name, where its local header is, and its size."""

    name: str
    header: int
    size: int
    method: int


def _at(file, offset: int, size: int) -> bytes:
    return file.read_at(size, offset)


def members(file) -> list[Member]:
    """The central directory's entries, in 64-bit form where needed."""
    total = file.size()
    tail_at = max(0, total - 65_557)
    tail = _at(file, tail_at, total - tail_at)
    end = tail.rfind(_END)
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
        end = tail.rfind(_END, 0, end)
    if end < 0:
        raise ValueError("not a ZIP archive: no end of central directory")
    count, size, start = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (size, start):
        locator = _at(file, tail_at + end - 20, 20)
        if locator[:4] != _LOCATOR64:
            raise ValueError("no ZIP64 locator")
        record = _at(file, struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != _END64:
            raise ValueError("no ZIP64 end of central directory")
        count, size, start = struct.unpack_from("<QQQ", record, 32)
    directory = _at(file, start, size)
    out, p = [], 0
    for _ in range(count):
        if directory[p : p + 4] != _ENTRY:
            raise ValueError("damaged central directory")
        method = struct.unpack_from("<H", directory, p + 10)[0]
        packed, whole, n, extra, comment = struct.unpack_from("<IIHHH", directory, p + 20)
        header = struct.unpack_from("<I", directory, p + 42)[0]
        name = directory[p + 46 : p + 46 + n].decode()
        q, stop = p + 46 + n, p + 46 + n + extra
        while q + 4 <= stop:
            kind, length = struct.unpack_from("<HH", directory, q)
            if kind == 1:  # 64-bit values of those fields that are full, in this order
                wide = iter(struct.unpack_from(f"<{length // 8}Q", directory, q + 4))
                whole = next(wide) if whole == 0xFFFFFFFF else whole
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            q += 4 + length
        out.append(Member(name, header, packed, method))
        p = stop + comment
    return out


def data_start(file, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by range")
    local = _at(file, member.header, 30)
    if local[:4] != _LOCAL:
        raise ValueError("damaged local header")
    return member.header + 30 + sum(struct.unpack_from("<HH", local, 26))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record without payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + quote(url or "", safe="".join(map(chr, range(33, 127)))),
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}


def parse_record(record: bytes) -> dict:
    """Type, ids, payload and its digest of one record; a response's digest is verified."""
    head, _, rest = record.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    warc = _fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = warc["warc-payload-digest"].removeprefix("sha256:")
    kind = warc["warc-type"]
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {warc['warc-record-id']} is damaged")
    number = lambda x: int(x) if (x := x.strip("<>").removeprefix("urn:page:")) else None
    return {
        "page_id": number(warc["warc-record-id"]),
        "payload_bytes": len(payload) if kind == "response" else int(_fields(http)["content-length"]),
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number(warc.get("warc-refers-to", "")),
        "url": warc["warc-target-uri"],
        "payload": payload if kind == "response" else None,
    }


def pack(records: list[bytes], keys: list[dict], wide: bool = False) -> bytes:
    """A ZIP archive of records and their index, members stored; ``wide`` writes 64-bit sizes."""
    lines, offset = [], 0
    for record, key in zip(records, keys, strict=True):
        lines.append(json.dumps(key | {"offset": offset, "length": len(record)}))
        offset += len(record)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, parts in ((DATA, records), (INDEX, ["\n".join(lines).encode()])):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=wide) as member:
                for part in parts:
                    member.write(part)
    return out.getvalue()


def _write(folder: str, limit: int):
    def task(batches):
        system, path = open_folder(folder)
        system.create_dir(path, recursive=True)
        records: list[bytes] = []
        keys: list[dict] = []
        held = 0

        def flush():
            nonlocal records, keys, held
            name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.wacz"
            with system.open_output_stream(f"{path}/{name}") as file:
                file.write(pack(records, keys))
            row = pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([len(records)], pa.int64())})
            records, keys, held = [], [], 0
            return row

        for b in batches:
            for i in range(b.num_rows):
                page, url, payload, digest, refers = (b.column(c)[i].as_py() for c in ("page_id", "url", "payload", "digest", "refers_to"))
                records.append(gzip.compress(record_bytes(page, url, payload or b"", digest, refers), 1, mtime=0))
                keys.append({"url": url, "digest": digest})
                held += len(records[-1])
                if held >= limit:
                    yield flush()
        if records:
            yield flush()

    return task


def plan_records(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """page_id, url, payload, digest, refers_to: the smallest page_id among equal payloads of ``least`` bytes is the response."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    digests = rows.select("page_id", "digest", F.octet_length("payload").alias("size")).where(F.col("page_id").isNotNull() & (F.col("size") >= least))
    first = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # decided on narrow rows, so that payloads move by page, never by a common digest
    again = digests.join(first, "digest").where("page_id <> first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    return rows.join(again, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")


def write_archives(records: DataFrame, folder: str, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of ``records`` below ``folder``: archive and number of records, once all are written."""
    return stage_table(records.mapInArrow(_write(folder, limit), "archive string, records long"), "archives")


def _index(folder: str, limit: int):
    def task(batches):
        system, path = open_folder(folder)
        for b in batches:
            for name in b.column("archive").to_pylist():
                with system.open_input_file(f"{path}/{name}") as file:
                    found = {m.name: m for m in members(file)}
                    base = data_start(file, found[DATA])
                    index = _at(file, data_start(file, found[INDEX]), found[INDEX].size)
                ranges = [(x["offset"], x["length"]) for x in map(json.loads, index.splitlines())]
                first = 0
                while first < len(ranges):
                    last, held = first, 0
                    while last < len(ranges) and (last == first or held + ranges[last][1] <= limit):
                        held += ranges[last][1]
                        last += 1
                    part = ranges[first:last]
                    yield pa.RecordBatch.from_pydict({"archive": [name], "start": pa.array([base + part[0][0]], pa.int64()), "lengths": pa.array([[n for _, n in part]], pa.list_(pa.int64()))})
                    first = last

    return task


FIELDS = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(), "payload": pa.binary()}


def _read(folder: str, names: list[str]):
    def task(batches):
        system, path = open_folder(folder)
        for b in batches:
            for name, start, lengths in zip(*(b.column(c).to_pylist() for c in ("archive", "start", "lengths")), strict=True):
                with system.open_input_file(f"{path}/{name}") as file:
                    data = _at(file, start, sum(lengths))
                rows, at = [], 0
                for n in lengths:
                    rows.append(parse_record(gzip.decompress(data[at : at + n])))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], FIELDS[f]) for f in names], names=names)

    return task


def read_records(archives: DataFrame, folder: str, with_payload: bool = True, limit: int = RANGE_BYTES) -> DataFrame:
    """The records of ``archives`` (archive, records): page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload."""
    names = list(FIELDS)[: None if with_payload else -2]
    shape = {"int64": "long", "string": "string", "binary": "binary"}
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = archives.repartition(n, "archive").mapInArrow(_index(folder, limit), "archive string, start long, lengths array<long>")
    return ranges.repartition(n, "archive", "start").mapInArrow(_read(folder, names), ", ".join(f"{f} {shape[str(FIELDS[f])]}" for f in names))


def round_trip(spark: SparkSession, pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Pages written to archives in the shared folder and read back."""
    folder = scratch_path(spark, "warc")
    return read_records(write_archives(plan_records(pages), folder), folder, with_payload)
