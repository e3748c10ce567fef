"""WARC records in ZIP packages: writing a table of pages, and reading by directory, index and byte range.

A package is a ZIP file with stored members: ``archive/data.warc.gz``, one gzip member per record, and
``indexes/index.cdx``, one line per record with its place. The reader parses the end record, the ZIP64 locator and
record and the central directory itself, finds where the stored members lie, reads the index and then only the byte
ranges of the records, spread over tasks; nothing is unpacked. Written packages count only through the rows that their
tasks return, so a repeated task does no harm.

Of records with equal payloads that with the largest page id is the response and the others are revisits of it. Equal
payloads are counted before rows move (digest and largest id only), and the join that brings the id back can be split.

Defined cases: null html is an empty payload, null url an empty target; a null page id counts as the smallest; rows that
repeat the response's page id and payload are responses too; an empty table gives no packages and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import filesystem, new_folder, partitions, saved

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Fixed values of the formats.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END, END64_AT, END64, ENTRY, LOCAL = (
    struct.Struct("<4s4H2LH"), struct.Struct("<4sLQL"), struct.Struct("<4sQ2H2L4Q"), struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s5H3L2H"),
)


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One gzip member with a WARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = "null" if page_id is None else page_id
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{name}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    block = http + payload
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
        block = http
    head.append(f"Content-Length: {len(block)}")
    squeeze = zlib.compressobj(3, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def fields(data: bytes) -> tuple[str, dict[str, str], int]:
    """First line, fields in lower case and the place after the empty line."""
    end = data.index(b"\r\n\r\n")
    first, *lines = data[:end].decode("utf-8").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, end + 4


def page_of(uri: str) -> int | None:
    name = uri.strip("<>").rpartition(":")[2]
    return None if name == "null" else int(name)


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """Page id, payload bytes, digest, type and response of a record; a response's payload is held against its digest."""
    plain = zlib.decompress(data, 31)
    first, head, at = fields(plain)
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    block = plain[at : at + int(head["content-length"])]
    _, http, body = fields(block)
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    n = int(http["content-length"])
    if head["warc-type"] == "response" and (len(block) - body != n or base32(hashlib.sha1(block[body:]).digest()) != digest):
        raise ValueError(f"damaged payload of {head['warc-record-id']}")
    refers = page_of(head["warc-refers-to"]) if "warc-refers-to" in head else None
    return page_of(head["warc-record-id"]), n, digest, head["warc-type"], refers


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int

    def place(self, source) -> int:
        """Where the member's bytes start: behind its own header, whose lengths may differ from the directory's."""
        parts = LOCAL.unpack(source.read_at(LOCAL.size, self.header))
        if parts[0] != b"PK\x03\x04" or self.method:
            raise ValueError(f"{self.name} is not a stored member")
        return self.header + LOCAL.size + parts[9] + parts[10]


def directory(source, size: int) -> dict[str, Member]:
    """The members by the central directory; ZIP64 values stand in where the short fields are full."""
    tail_at = max(0, size - END.size - 65_535)
    tail = source.read_at(size - tail_at, tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of a ZIP directory")
    *_, entries, length, start, _ = END.unpack_from(tail, at)
    end_at = tail_at + at
    if end_at >= END64_AT.size:
        mark, _, place, _ = END64_AT.unpack(source.read_at(END64_AT.size, end_at - END64_AT.size))
        if mark == b"PK\x06\x07":
            *_, entries, length, start = END64.unpack(source.read_at(END64.size, place))
    data, out, at = source.read_at(length, start), {}, 0
    for _ in range(entries):
        e = ENTRY.unpack_from(data, at)
        method, packed, plain, n, extra, comment, header = e[4], e[8], e[9], e[10], e[11], e[12], e[16]
        name = data[at + ENTRY.size : at + ENTRY.size + n].decode("utf-8")
        more, to = at + ENTRY.size + n, at + ENTRY.size + n + extra
        while more + 4 <= to:
            kind, k = struct.unpack_from("<2H", data, more)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{k // 8}Q", data, more + 4))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            more += 4 + k
        out[name] = Member(name, method, packed, header)
        at = to + comment
    return out


def with_response(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id``, ``url``, ``payload``, its SHA-1 in hex and ``refers_to``, null for responses."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    firsts = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    rows = rows.join(firsts, "sha1", "left")
    other = F.col("__first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__first"))
    return rows.select("page_id", "url", "payload", "sha1", F.when(other, F.col("__first")).alias("refers_to"))


def write_packages(pages: DataFrame, date: str = "2000-01-01T00:00:00Z", min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes every page as a record, one package per task; returns the stored list ``path``, ``size``, ``records``."""
    folder = folder or new_folder(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.wacz"
        fs, inside = filesystem(path)
        lines, at = [], 0
        with fs.open_output_stream(inside) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
            with package.open(zipfile.ZipInfo(RECORDS), "w", force_zip64=True) as member:
                for b in batches:
                    for lo in range(0, b.num_rows, 256):
                        for r in b.slice(lo, 256).to_pylist():
                            data = record(r["page_id"], r["url"], r["payload"], base32(bytes.fromhex(r["sha1"])), r["refers_to"], date)
                            member.write(data)
                            lines.append(f"{'null' if r['page_id'] is None else r['page_id']} {at} {len(data)}\n")
                            at += len(data)
            with package.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as member:
                member.write("".join(lines).encode())
        if lines:
            yield pa.RecordBatch.from_pydict({"path": [path], "size": [fs.get_file_info(inside).size], "records": [len(lines)]})

    return saved(with_response(pages, min_bytes).mapInArrow(write, "path string, size bigint, records bigint"))


def read_packages(packages: DataFrame) -> DataFrame:
    """The records of the listed packages: their indexes give byte ranges, which tasks then read by place."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fs, inside = filesystem(r["path"])
                with fs.open_input_file(inside) as source:
                    members = directory(source, r["size"])
                    base, index = members[RECORDS].place(source), members[INDEX]
                    lines = source.read_at(index.size, index.place(source)).decode().splitlines()
                places = [tuple(map(int, x.split(" ")[1:])) for x in lines]
                for lo in range(0, len(places), 10_000):
                    part = places[lo : lo + 10_000]
                    yield pa.RecordBatch.from_pydict({"path": [r["path"]] * len(part), "at": [base + at for at, _ in part], "length": [n for _, n in part], "part": [(lo + i) // 500 for i in range(len(part))]})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        path, source = None, None
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["path"] != path:
                    if source is not None:
                        source.close()
                    path = r["path"]
                    fs, inside = filesystem(path)
                    source = fs.open_input_file(inside)
                rows.append(parse(source.read_at(r["length"], r["at"])))
            yield pa.RecordBatch.from_pydict(dict(zip(kind.names, map(list, zip(*rows)))), schema=kind) if rows else pa.RecordBatch.from_pylist([], schema=kind)
        if source is not None:
            source.close()

    n = partitions(packages.sparkSession)
    listed = packages.select("path", "size").repartition(n, "path").mapInArrow(ranges, "path string, at bigint, length bigint, part bigint")
    dealt = listed.repartition(n, "path", "part").sortWithinPartitions("path", "at")
    return dealt.mapInArrow(read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
