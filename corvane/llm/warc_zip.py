"""WARC archives inside ZIP packages: written by tasks, read back by range without extraction.

A package is a ZIP file of stored (uncompressed) members: ``archive/NNNNN.warc.gz``, one gzip member a record,
and ``indexes/NNNNN.cdxj``, a line a record with its offset and length. The reader finds the end record, follows
the ZIP64 locator if there is one, parses the central directory, checks each local header, and then
reads single records by their byte range in the package.

Tasks write packages to the shared folder through pyarrow's filesystems (file, s3, gs, hdfs, ...), each under a name of its
own attempt; the rows they return name the packages, so what a lost task left behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialised, require, scratch, small_batches

#: Payloads of fewer bytes are never revisits; a member is closed once it holds so many bytes.
LEAST_REVISIT, MEMBER_BYTES = 1000, 16_000_000
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
BIG = 0xFFFFFFFF


# --- ZIP -----------------------------------------------------------------------------------------------------------


class ZipWriter:
    """Writes stored members to a stream that need not be seekable. ``always64`` writes ZIP64 records even where they aren't needed."""

    def __init__(self, out: BinaryIO, always64: bool = False):
        self.out, self.always64, self.at, self.entries = out, always64, 0, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> int:
        """Adds a member; returns where its data begin."""
        crc, size, at, raw = zlib.crc32(data), len(data), self.at, name.encode()
        big = self.always64 or size >= BIG
        extra = struct.pack("<HHQQ", 1, 16, size, size) if big else b""
        self._write(LOCAL + struct.pack("<HHHHHIIIHH", 45 if big else 20, 0x800, 0, 0, 33, crc, BIG if big else size, BIG if big else size, len(raw), len(extra)) + raw + extra)
        begin = self.at
        self._write(data)
        self.entries.append((raw, crc, size, at))
        return begin

    def close(self) -> None:
        begin = self.at
        for raw, crc, size, at in self.entries:
            big_size, big_at = self.always64 or size >= BIG, self.always64 or at >= BIG
            fields = ([size, size] if big_size else []) + ([at] if big_at else [])
            extra = struct.pack(f"<HH{len(fields)}Q", 1, 8 * len(fields), *fields) if fields else b""
            self._write(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if fields else 20, 0x800, 0, 0, 33, crc, BIG if big_size else size, BIG if big_size else size, len(raw), len(extra), 0, 0, 0, 0, BIG if big_at else at) + raw + extra)
        end, n = self.at, len(self.entries)
        big = self.always64 or n >= 0xFFFF or end >= BIG
        if big:
            self._write(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, end - begin, begin))
            self._write(LOCATOR64 + struct.pack("<IQI", 0, end, 1))
        self._write(END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF if big else n, 0xFFFF if big else n, BIG if big else end - begin, BIG if big else begin, 0))


def read_directory(file, size: int) -> list[tuple[str, int, int, int, int]]:
    """(name, method, crc, size, header offset) of each member of the package in a seekable file, from its central directory."""

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        data = file.read(n)
        if len(data) != n:
            raise ValueError("package is cut short")
        return data

    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    found = tail.rfind(END)
    while found >= 0 and (len(tail) - found < 22 or struct.unpack_from("<H", tail, found + 20)[0] != len(tail) - found - 22):
        found = tail.rfind(END, 0, found)
    if found < 0:
        raise ValueError("no end of central directory")
    _, _, _, n, length, begin, _ = struct.unpack_from("<HHHHIIH", tail, found + 4)
    end_at = tail_at + found
    if n == 0xFFFF or length == BIG or begin == BIG:
        where = read(end_at - 20, 20) if end_at >= 20 else b""
        if where[:4] == LOCATOR64:
            at64 = struct.unpack_from("<Q", where, 8)[0]
            head = read(at64, 56)
            if head[:4] != END64:
                raise ValueError("no ZIP64 end record where the locator points")
            n, length, begin = struct.unpack_from("<QQQ", head, 32)
    directory, at, out = read(begin, length), 0, []
    for _ in range(n):
        if directory[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method, _, _, crc, packed, full, names, extras, notes = struct.unpack_from("<HHHIIIHHH", directory, at + 10)
        offset = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + names].decode("utf-8")
        extra = directory[at + 46 + names : at + 46 + names + extras]
        while len(extra) >= 4:
            kind, m = struct.unpack_from("<HH", extra)
            if kind == 1:
                body = extra[4 : 4 + m]
                for field in ("full", "packed", "offset"):
                    if {"full": full, "packed": packed, "offset": offset}[field] == BIG:
                        value, body = struct.unpack_from("<Q", body)[0], body[8:]
                        full, packed, offset = (value if field == k else v for k, v in (("full", full), ("packed", packed), ("offset", offset)))
            extra = extra[4 + m :]
        out.append((name, method, crc, packed, offset))
        at += 46 + names + extras + notes
    return out


def data_offset(file, header_at: int) -> int:
    """Where a member's data begin: behind its local header, whose name and extra field have lengths of their own."""
    file.seek(header_at)
    head = file.read(30)
    if head[:4] != LOCAL:
        raise ValueError("no local header where the directory points")
    names, extras = struct.unpack_from("<HH", head, 26)
    return header_at + 30 + names + extras


# --- WARC ----------------------------------------------------------------------------------------------------------


def record_id(page_id) -> str:
    return f"<urn:corvane:page:{'none' if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:corvane:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def warc_record(page_id, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or with ``refers_to`` a revisit: HTTP headers without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    target = quote(url or "about:blank", safe="%/:?#[]@!$&'()*+,;=~")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data.decode("utf-8").split("\r\n")[1:])}


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    warc = _headers(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, _headers(http), payload


# --- Spark ---------------------------------------------------------------------------------------------------------


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, payload, refers_to): of equal payloads of ``least`` bytes or more all but the largest page_id refer to that one."""
    require(pages, ("page_id", "url", "html"))
    sized = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    known = sized.filter(F.length("payload") >= least).select("page_id", F.unhex(F.sha2("payload", 256)).alias("sha"))
    own = materialised(known, "payload-digests")
    groups = own.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = own.join(groups, "sha").filter("page_id <> refers_to").select("page_id", "sha", "refers_to").distinct()
    with_sha = sized.withColumn("sha", F.when(F.length("payload") >= least, F.unhex(F.sha2("payload", 256))))
    return with_sha.join(later, ["page_id", "sha"], "left").select("page_id", "url", "payload", "refers_to")


def write_packages(records: DataFrame, folder: str, member_bytes: int = MEMBER_BYTES, always64: bool = False) -> DataFrame:
    """Writes a package a task that has rows; returns their (path, size, records), materialised, so that it runs once."""
    small_batches(records.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        path, zipped, out, n, members = f"{base}/{uuid.uuid4().hex}.zip", None, None, 0, 0
        body, lines = bytearray(), []

        def flush() -> None:
            nonlocal members
            zipped.add(f"archive/{members:05d}.warc.gz", bytes(body))
            zipped.add(f"indexes/{members:05d}.cdxj", "".join(lines).encode())
            body.clear()
            lines.clear()
            members += 1

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to"))):
                if zipped is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(path)
                    zipped = ZipWriter(out, always64)
                squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = squeeze.compress(warc_record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py())) + squeeze.flush()
                lines.append(json.dumps({"id": record_id(page_id.as_py()), "offset": len(body), "length": len(data)}) + "\n")
                body += data
                n += 1
                if len(body) >= member_bytes:
                    flush()
        if zipped is not None:
            if lines:
                flush()
            zipped.close()
            out.close()
            yield pa.record_batch([pa.array([path]), pa.array([zipped.at], pa.int64()), pa.array([n], pa.int64())], names=["path", "size", "records"])

    return materialised(records.select("page_id", "url", "payload", "refers_to").mapInArrow(write, "path string, size long, records long"), "packages")


def list_members(packages: DataFrame, folder: str) -> DataFrame:
    """(path, archive, archive_at, archive_size, index_at, index_size): stored WARC members with their indexes, from the packages' directories."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = filesystem(folder)
        for part in batches:
            for path, size in zip(part["path"], part["size"]):
                with store.open_input_file(path) as f:
                    members = {}
                    for name, method, _, length, header in read_directory(f, int(size)):
                        if method:
                            raise ValueError(f"{name} isn't stored")
                        members[name] = (data_offset(f, header), length)
                    rows = [(path, name, at, length, *members[f"indexes/{name[8:-8]}.cdxj"]) for name, (at, length) in members.items() if name.startswith("archive/") and name.endswith(".warc.gz")]
                yield pd.DataFrame(rows, columns=["path", "archive", "archive_at", "archive_size", "index_at", "index_size"])

    return packages.mapInPandas(walk, "path string, archive string, archive_at long, archive_size long, index_at long, index_size long")


def read_records(members: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """A row a record, read by its range: page_id, payload_bytes, payload_digest (hex), record_type, refers_to, and on request payload.

    A response's digest and length are computed from its payload and checked against its headers; a revisit's are those
    its headers state for the payload it refers to.
    """
    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), *[("payload", pa.binary())] * with_payload]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(folder)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), fields)], names=[n for n, _ in fields])

        for batch in batches:
            for m in batch.to_pylist():
                rows, held = [], 0
                with store.open_input_file(m["path"]) as f:
                    f.seek(m["index_at"])
                    for line in f.read(m["index_size"]).decode().splitlines():
                        entry = json.loads(line)
                        if entry["offset"] + entry["length"] > m["archive_size"]:
                            raise ValueError("index points beyond its member")
                        f.seek(m["archive_at"] + entry["offset"])
                        warc, http, payload = parse_record(zlib.decompress(f.read(entry["length"]), 31))
                        stated = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
                        if warc["warc-type"] == "response" and (hashlib.sha1(payload).hexdigest() != stated or len(payload) != int(http["content-length"])):
                            raise ValueError(f"payload of {warc['warc-record-id']} doesn't match its headers")
                        rows.append((page_of(warc["warc-record-id"]), int(http["content-length"]), stated, warc["warc-type"], page_of(warc.get("warc-refers-to")), *[payload] * with_payload))
                        held += len(payload) * with_payload
                        if len(rows) >= 5000 or held > 16_000_000:
                            yield out(rows)
                            rows, held = [], 0
                if rows:
                    yield out(rows)

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.repartition(n, "path", "archive").mapInArrow(read, schema)


def archive_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes every page to packages and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload, a null url about:blank, a null page_id reads back as null and is never referred to
    by itself alone; repeated rows give repeated records; an empty table gives no packages and no rows;
    other columns are ignored.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    packages = write_packages(with_revisits(pages), folder)
    return read_records(list_members(packages, folder), folder)
