"""Deterministic sharded WARC writer and its reader.

Records are range-sorted by page id, written as gzip members of their own, and
files are rolled at a bound of compressed bytes. Headers and digests are made
anew, dates are a parameter, and gzip members carry no time, so that a repeated
run or task gives the same bytes. Files get their names when whole; a manifest
commits the set.

Of records with equal payloads of at least ``min_bytes`` bytes, that with the
largest page id is a response and the others are revisits of it.

Defined results: a null page counts as empty; an empty table gives an empty
manifest and no rows; of repeated rows with the largest id of equal payloads
each is a response; null ids sort first and revisit like any other (a null is
below every id); a null URL is written as an empty one; further columns are
neither read nor returned.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attempt_id, read_file, scratch, write_file

#: Compressed bytes at which a file is rolled: what a task holds.
FILE_BYTES = 16 << 20
DATE = "2020-01-01T00:00:00Z"
LEVEL = 4
#: Rows of an Arrow batch read back, and bytes handed to the decompressor at a time.
READ_ROWS, SLICE = 1000, 1 << 14


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def gzip_member(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def name_of(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def id_of(name: str) -> int | None:
    return None if (x := name[len("<urn:page:") : -1]) == "null" else int(x)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple | None) -> bytes:
    """A record as bytes; refers_to: (page id,) makes it a revisit, whose block leaves the payload out."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not refers_to:
        block += payload
    uri = "".join(f"%{b:02X}" if b < 33 else chr(b) if b < 127 else f"%{b:02X}" for b in (url or "").encode())
    headers = [
        ("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", name_of(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", "sha1:" + digest(payload)), ("WARC-Block-Digest", "sha1:" + digest(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if refers_to:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name_of(refers_to[0]))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a record; its digests are proved."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    h = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(h["Content-Length"])]
    if not version.startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n" or h["WARC-Block-Digest"] != "sha1:" + digest(block):
        raise ValueError("a record is damaged")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    if h["WARC-Type"] == "response" and (len(payload) != size or h["WARC-Payload-Digest"] != "sha1:" + digest(payload)):
        raise ValueError("a payload is damaged")
    return {"page_id": id_of(h["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": h["WARC-Payload-Digest"][5:], "record_type": h["WARC-Type"], "refers_to": id_of(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None}


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file, one by one."""
    at = 0
    while at < len(data):
        d, parts = zlib.decompressobj(31), []
        while not d.eof:
            piece = data[at : at + SLICE]
            if not piece:
                raise ValueError("a file is cut short")
            parts.append(d.decompress(piece))
            at += len(piece) - len(d.unused_data)
        yield b"".join(parts)


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, digest (hexadecimal), owner of each page that revisits another. Digests alone are grouped and joined, with partial maxima, so that a hot payload is no hot task."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    p = p.where(F.octet_length("html") >= min_bytes).select("page_id", F.sha1("html").alias("digest"))
    owners = p.groupBy("digest").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return p.join(owners, "digest").where(~F.col("owner").eqNullSafe(F.col("page_id"))).select("page_id", "digest", "owner").distinct()


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> list[dict]:
    """Write pages(page_id, url, html) to folder; returns the manifest's entries in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = attempt_id()
        held: list[bytes] = []
        size = seq = n = 0
        last, owners = (), {}

        def roll() -> pa.RecordBatch:
            name, data = f"pages-{part:06d}-{seq:05d}.warc.gz", b"".join(held)
            write_file(folder, name, data, attempt)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": [name], "records": pa.array([n], pa.int64()), "bytes": pa.array([len(data)], pa.int64()), "sha1": [digest(data)]})

        for b in batches:
            for x in b.to_pylist():
                if last != (x["page_id"],):
                    last, owners = (x["page_id"],), {}
                if x["digest"]:
                    owners[x["digest"]] = (x["owner"],)
                    continue
                payload = (x["html"] or "").encode()
                held.append(gzip_member(record(x["page_id"], x["url"], payload, owners and owners.get(hashlib.sha1(payload).hexdigest()))))
                size, n = size + len(held[-1]), n + 1
                if size >= file_bytes:
                    yield roll()
                    held, size, n, seq = [], 0, 0, seq + 1
        if held:
            yield roll()

    # Pages are shuffled once: what a page refers to travels as a row of its own, which sorts before the page.
    none = F.lit(None)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), none.cast("string").alias("digest"), none.cast("long").alias("owner"), "url", "html")
    rows = own.unionByName(revisits(pages, min_bytes).select("page_id", "digest", "owner", none.cast("string").alias("url"), none.cast("string").alias("html")))
    rows = rows.repartitionByRange(F.col("page_id").asc_nulls_first()).sortWithinPartitions(F.col("page_id").asc_nulls_first(), F.col("digest").asc_nulls_last(), F.col("url").asc_nulls_first(), F.col("html").asc_nulls_first())
    # One row a file of some 16 MB: the manifest, not the pages.
    files = sorted((r.asDict() for r in rows.mapInArrow(run, "part int, seq int, file string, records long, bytes long, sha1 string").collect()), key=lambda r: (r["part"], r["seq"]))
    write_file(folder, "manifest.json", json.dumps({"files": files}).encode(), "commit")
    return files


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """A row a record of the committed files; files are proved by the manifest's digest."""
    files = json.loads(read_file(folder, "manifest.json"))["files"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, sha1 in zip(b.column("file").to_pylist(), b.column("sha1").to_pylist(), strict=True):
                data, rows = read_file(folder, name), []
                if digest(data) != sha1:
                    raise ValueError(f"{name} is damaged")
                for x in members(data):
                    rows.append(parse(x))
                    if len(rows) == READ_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    listed = spark.createDataFrame([(r["file"], r["sha1"]) for r in files], "file string, sha1 string").repartition(max(1, len(files)))
    return listed.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def warc_files(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages to new files in the shared folder, and read them back."""
    folder = scratch(pages.sparkSession, "warc")
    write_warc(pages, folder, min_bytes)
    return read_warc(pages.sparkSession, folder)
