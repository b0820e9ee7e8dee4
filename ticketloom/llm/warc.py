"""WARC records in ZIP packages, read by ranges through the package's own directories.

Writing: every Spark task writes packages into the shared folder.  A package is a
ZIP file with two stored members, ``archive/data.warc.gz`` (one gzip member for
each record) and ``indexes/index.cdxj`` (place and length of each record).

Reading: the end record, the ZIP64 end record and the central directory give the
place of the members; the index gives the ranges of the records; each record is
read by its range.  Nothing is extracted or unpacked beside the record in hand.

Equal payloads of at least ``min_bytes`` bytes: the records with the smallest
page_id are responses, all others revisits that name it.  Null html is an empty
payload.  A null page_id ranks after every other.  Repeated rows are written as
often as they come (two rows with the smallest id are two responses).  A null url
is written as ``urn:unknown``; control characters in urls are percent-encoded.
An empty table gives no packages and no rows; columns other than page_id, url and html are not looked at.
A payload whose digest, computed anew on reading, differs from its header is an error.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import urllib.parse
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ticketloom.llm.common import by_bytes, file_system, materialize, replaced_file, scratch_path

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
RECORD = "urn:page:"
SCHEMA = (
    "page_id {id}, payload_bytes long, payload_digest string, record_type string, refers_to {id}, url string"
)


def marked(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, sha1, n, refers_to``; refers_to is null for responses.

    Only digests that occur more than once come back into the join, and the
    join is left outer from the pages, so adaptive execution can split a digest
    that a third of them share.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    own = pages.select("page_id", "url", html.alias("html")).withColumn("sha1", F.sha1("html")).withColumn(
        "n", F.octet_length("html").cast("long")
    )
    first = (
        own.filter(F.col("n") >= min_bytes)
        .groupBy("sha1")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .drop("copies")
    )
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return own.join(first, "sha1", "left").select(
        "page_id", "url", "html", "sha1", "n", F.when(again, F.col("first")).alias("refers_to")
    )


def _name(page_id) -> str:
    return f"{RECORD}{'null' if page_id is None else page_id}"


def _page_id(name: str) -> str | None:
    found = name.strip("<>").removeprefix(RECORD)
    return None if found == "null" else found


def record(page_id, url: str | None, html: bytes, sha1: str, refers_to) -> bytes:
    """One WARC record; a revisit keeps the HTTP head with the full payload's length, but no payload."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + html
    uri = urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else "urn:unknown"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head += [f"WARC-Record-ID: <{_name(page_id)}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_name(refers_to)}>"]
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    head += [f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers of a record, its HTTP head and its payload; checks the lengths that it states."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError(f"no WARC record: {version[:40]!r}")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("the record's length differs from its header")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    stated = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    return {"fields": fields, "payload": payload, "payload_bytes": int(stated[1]) if stated else len(payload)}


def write_packages(pages: DataFrame, folder: str, min_bytes: int = 0, package_bytes: int = 256 << 20) -> DataFrame:
    """Write ``page_id, url, html`` as packages below ``folder``; returns ``path, n_records`` (written)."""
    by_bytes(pages.sparkSession)

    def run(batches):
        task, number, done = TaskContext.get().partitionId(), 0, []
        package = None
        for b in batches:
            for row in b.to_pylist():
                if package is None:
                    package = _Package(f"{folder}/part-{task:05d}-{number:03d}.wacz")
                    number += 1
                package.add(**row)
                if package.size >= package_bytes:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield pa.RecordBatch.from_pylist(
            done, pa.schema([("path", pa.string()), ("n_records", pa.int64())])
        )

    rows = marked(pages, min_bytes).select("page_id", "url", "html", "sha1", "refers_to")
    return materialize(rows.mapInArrow(run, "path string, n_records long"), "warc-manifest")


class _Package:
    """A package in the making: records stream into the archive member, index lines are kept for the end."""

    def __init__(self, path: str):
        self.path, self.size, self.lines = path, 0, []
        self.file = replaced_file(path)
        self.zip = zipfile.ZipFile(_Counted(self.file.__enter__()), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)

    def add(self, page_id, url, html, sha1, refers_to) -> None:
        data = gzip.compress(record(page_id, url, html, sha1, refers_to), 6, mtime=0)
        self.member.write(data)
        self.lines.append(json.dumps({"id": _name(page_id), "offset": self.size, "length": len(data)}))
        self.size += len(data)

    def close(self) -> dict:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.lines) + "\n")
        self.zip.close()
        self.file.__exit__(None)
        return {"path": self.path, "n_records": len(self.lines)}


class _Counted(io.RawIOBase):
    """A write-only stream for zipfile over a file system's output."""

    def __init__(self, out):
        self.out = out

    def writable(self):
        return True

    def write(self, data):
        self.out.write(bytes(data))
        return len(data)


def _at(file, offset: int, n: int) -> bytes:
    file.seek(offset)
    data = file.read(n)
    if len(data) != n:
        raise ValueError("the package ends too early")
    return data


def directory(file, size: int) -> dict[str, tuple[int, int, int]]:
    """Members of a ZIP package from its central directory: name -> (local header's place, stored size, method)."""
    tail_at = max(0, size - 65_557)
    tail = _at(file, tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6")
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
        end = tail.rfind(b"PK\5\6", 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    entries, length, start = struct.unpack_from("<HII", tail, end + 10)
    locator = tail_at + end - 20
    if locator >= 0 and (found := _at(file, locator, 20)).startswith(b"PK\6\7"):
        end64 = _at(file, struct.unpack_from("<Q", found, 8)[0], 56)
        if not end64.startswith(b"PK\6\6"):
            raise ValueError("no ZIP64 end of central directory")
        entries, length, start = struct.unpack_from("<QQQ", end64, 32)
    central, at, members = _at(file, start, length), 0, {}
    for _ in range(entries):
        if central[at : at + 4] != b"PK\1\2":
            raise ValueError("bad central directory")
        method, packed, full = struct.unpack_from("<H8xII", central, at + 10)
        n_name, n_extra, n_comment = struct.unpack_from("<HHH", central, at + 28)
        place = struct.unpack_from("<I", central, at + 42)[0]
        name = central[at + 46 : at + 46 + n_name].decode()
        extra = central[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n = struct.unpack_from("<HH", extra)
            if tag == 1:  # 64-bit values stand only for the fields that are all ones, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                place = next(wide) if place == 0xFFFFFFFF else place
            extra = extra[4 + n :]
        members[name] = (place, packed, method)
        at += 46 + n_name + n_extra + n_comment
    return members


def stored_range(file, members: dict, name: str) -> tuple[int, int]:
    """First byte and length of a stored member's data."""
    place, packed, method = members[name]
    if method:
        raise ValueError(f"{name} is compressed; its parts can't be read by range")
    head = _at(file, place, 30)
    if not head.startswith(b"PK\3\4"):
        raise ValueError(f"no local header of {name}")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return place + 30 + n_name + n_extra, packed


def records(path: str) -> Iterator[dict]:
    """All records of a package, each read by its range."""
    store, where = file_system(path)
    size = store.get_file_info(where).size
    with store.open_input_file(where) as file:
        members = directory(file, size)
        data, length = stored_range(file, members, ARCHIVE)
        for line in _at(file, *stored_range(file, members, INDEX)).decode().splitlines():
            entry = json.loads(line)
            if entry["offset"] + entry["length"] > length:
                raise ValueError("the index points past its archive")
            yield parse_record(gzip.decompress(_at(file, data + entry["offset"], entry["length"])))


def read_packages(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """One row per record of the packages that ``manifest`` lists in ``path``."""

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                held = []
                for r in records(path):
                    f = r["fields"]
                    digest = f["warc-payload-digest"].removeprefix("sha1:")
                    if f["warc-type"] == "response":
                        if len(r["payload"]) != r["payload_bytes"]:
                            raise ValueError("the payload's length differs from its header")
                        if base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() != digest:
                            raise ValueError("the payload's digest differs from its header")
                    held.append((
                        _page_id(f["warc-record-id"]), r["payload_bytes"], digest, f["warc-type"],
                        _page_id(f["warc-refers-to"]) if "warc-refers-to" in f else None, f["warc-target-uri"],
                    ))
                    if len(held) >= 5000:
                        yield _rows(held)
                        held = []
                yield _rows(held)

    rows = manifest.select("path").repartition(max(1, manifest.count()), "path")
    read = rows.mapInArrow(run, SCHEMA.format(id="string"))
    return read.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def _rows(held: list[tuple]) -> pa.RecordBatch:
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
    kinds = (pa.string(), pa.int64(), *[pa.string()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held) if held else [()] * 6, kinds)], list(names))


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages into packages of the shared folder and read them back."""
    manifest = write_packages(pages, scratch_path(pages.sparkSession, "warc"), min_bytes)
    return read_packages(manifest, pages.schema["page_id"].dataType.simpleString())
