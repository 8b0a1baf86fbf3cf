"""WARC archives with a two-level capture index: sorted compressed blocks, a sparse directory, range reads."""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import materialize, need, new_folder, small

#: Lines of a block of the index, and bytes after which a task starts a new archive file.
BLOCK_LINES = 3_000
ROLL = 256 << 20
#: Bytes that a reading task is given, about, and adjacent bytes of an archive that stay together.
READ, STRETCH = 4 << 20, 1 << 20
#: Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NO_ID = -(1 << 63)


def url_key(url: str | None) -> str:
    """Sort key with the host's labels reversed: ``com,example)/path?query``; without scheme, port 80/443, user, fragment; null gives an empty key."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url.strip()
    if not host:
        return url.strip()
    shown = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    return f"{shown}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def _header(pairs: list[tuple[str, object]]) -> bytes:
    clean = lambda v: re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(v))
    return "".join(f"{k}: {clean(v)}\r\n" for k, v in pairs).encode()


def _gzip(raw: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> bytes:
    """One record: a response with its payload, or, if ``first`` is another page, a revisit of it without one."""
    http = b"HTTP/1.1 200 OK\r\n" + _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))]) + b"\r\n"
    revisit = first is not None
    body = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date), ("WARC-Target-URI", url or ""), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first)), ("X-Refers-To-Page", first)]
    if page_id is not None:
        head.append(("X-Page", page_id))
    head += [("X-Payload-Length", len(payload)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(body))]
    return f"{VERSION}\r\n".encode() + _header(head) + b"\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, with lower-case names, and payload of one uncompressed record."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if len(block) != int(headers["content-length"]):
        raise ValueError("a truncated WARC record")
    return headers, block.partition(b"\r\n\r\n")[2]


# --- writing -------------------------------------------------------------------------------------------------------


@dataclass
class Archive:
    """A folder of archives and their index. ``shards`` has (first key, first id, name) of each index file, sorted."""

    folder: str
    captures: DataFrame
    shards: list[tuple[str, int, str]] = field(default_factory=list)


CAPTURE = "key string, page_id long, file string, offset long, length long"


def write(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_revisit: int = 0, date: str = "2000-01-01T00:00:00Z", level: int = 4) -> Archive:
    """Write a record per row, and the index. Null bodies are empty payloads, null URLs have the empty key.

    Of rows with equal payloads of at least ``min_revisit`` bytes the one with the smallest id is the response and
    those with other ids revisit it; rows with a null id revisit any row with one. Repeated rows are each written.
    Every task attempt writes files of its own name, and only names that a finished attempt returned
    are ever read, so lost executors leave at most unread files. Bodies are shuffled only if the repeated payloads
    are too many to broadcast.
    """
    need(pages, id_col, url_col, body_col)
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    body = F.coalesce(F.col(body_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("body")).withColumn("sha1", F.unhex(F.sha1("body")))
    again = rows.where(F.octet_length("body") >= min_revisit).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    rows = rows.join(small(materialize(again, "repeats")), "sha1", "left").select("page_id", "url", "body", "sha1", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        fs.create_dir(base)
        name, out, at = None, None, 0
        for b in batches:
            got: list[tuple] = []
            for page, url, raw, sha, first in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None or at > ROLL:
                    if out is not None:
                        out.close()
                    name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                record = _gzip(make_record(page, url, raw, base64.b32encode(sha).decode(), first, date), level)
                out.write(record)
                got.append((url_key(url), page, name, at, len(record)))
                at += len(record)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True) if got else [[]] * 5, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    captures = materialize(rows.mapInArrow(run, CAPTURE), "captures")
    return Archive(folder, captures, build_index(spark, captures, folder))


def build_index(spark: SparkSession, captures: DataFrame, folder: str, lines: int = BLOCK_LINES) -> list[tuple[str, int, str]]:
    """Sort captures into compressed blocks, one file per range of keys, each with its sparse directory beside it.

    Ranges include the id, so a URL with a third of all captures is split too. What comes to the driver is a
    row per index file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        out, name, at, first = None, f"index-{uuid.uuid4().hex}", 0, None
        directory: list[list] = []
        held: list[list] = []

        def close() -> None:
            nonlocal at
            block = zlib.compress("\n".join(map(json.dumps, held)).encode(), 6)
            out.write(block)
            directory.append([held[0][0], held[0][1], at, len(block)])
            at += len(block)
            held.clear()

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                row = [row[0], _NO_ID if row[1] is None else row[1], *row[2:]]
                if out is None:
                    out, first = fs.open_output_stream(f"{base}/{name}.blocks", compression=None), row[:2]
                held.append(row)
                if len(held) == lines:
                    close()
        if out is not None:
            if held:
                close()
            out.close()
            with fs.open_output_stream(f"{base}/{name}.directory", compression=None) as f:
                f.write(zlib.compress(json.dumps(directory).encode(), 6))
            yield pa.RecordBatch.from_arrays([pa.array([first[0]]), pa.array([first[1]]), pa.array([name])], ["key", "page_id", "name"])

    order = ["key", "page_id"]
    made = captures.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "page_id", "file", "offset", "length").mapInArrow(run, "key string, page_id long, name string")
    return sorted(tuple(r) for r in materialize(made, "shards").collect())


# --- reading -------------------------------------------------------------------------------------------------------


class Index:
    """Binary search in the list of shards, then in a shard's directory, then a range read of one block."""

    def __init__(self, folder: str, shards: list[tuple[str, int, str]]) -> None:
        self.fs, self.base = _open(folder)
        self.firsts, self.names = [s[:2] for s in shards], [s[2] for s in shards]
        self.directory: tuple[int, list, list] | None = None
        self.block: tuple[tuple, list] | None = None

    def _entries(self, shard: int) -> tuple[list, list]:
        if self.directory is None or self.directory[0] != shard:
            with self.fs.open_input_file(f"{self.base}/{self.names[shard]}.directory") as f:
                rows = json.loads(zlib.decompress(f.read()))
            self.directory = shard, [tuple(r[:2]) for r in rows], rows
        return self.directory[1:]

    def _lines(self, shard: int, entry: list) -> list:
        at = (shard, entry[2])
        if self.block is None or self.block[0] != at:
            with self.fs.open_input_file(f"{self.base}/{self.names[shard]}.blocks") as f:
                f.seek(entry[2])
                raw = zlib.decompress(f.read(entry[3]))
            self.block = at, [json.loads(x) for x in raw.decode().split("\n")]
        return self.block[1]

    def find(self, key: str, page_id: int | None = None, any_id: bool = False) -> Iterator[list]:
        """Captures of a key: [key, id, file, offset, length]; of one id only unless ``any_id``."""
        low = (key, _NO_ID if page_id is None else page_id)
        # entries that start at the key or before it may hold it; equal ones may begin in the entry before
        shard = max(0, bisect.bisect_left(self.firsts, low) - 1)
        while shard < len(self.names):
            firsts, entries = self._entries(shard)
            at = max(0, bisect.bisect_left(firsts, low) - 1)
            while at < len(entries):
                if (firsts[at] > low and not any_id) or firsts[at][0] > key:
                    return
                lines = self._lines(shard, entries[at])
                for i in range(bisect.bisect_left(lines, list(low)), len(lines)):
                    if lines[i][0] != key or not (any_id or lines[i][1] == low[1]):
                        return
                    yield lines[i]
                at += 1
            shard += 1


def read_range(fs: pafs.FileSystem, path: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    with fs.open_input_file(path) as f:
        f.seek(offset)
        return parse_record(zlib.decompress(f.read(length), 31))


def lookup(archive: Archive, url: str) -> list[tuple[dict[str, str], bytes]]:
    """All records of a URL, by three range reads or a few more."""
    fs, base = _open(archive.folder)
    return [read_range(fs, f"{base}/{c[2]}", c[3], c[4]) for c in Index(archive.folder, archive.shards).find(url_key(url), any_id=True)]


def read(archive: Archive, wanted: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the (key, page_id) pairs of ``wanted``: page_id, url, record_type, refers_to, payload_digest, payload_bytes (and payload).

    Pairs are sorted by key, so each task walks through few index blocks; the captures found are then dealt out in
    stretches of archive files, as many tasks as their bytes demand, and read in the order of their offsets. Digests of responses are computed from the payload read
    and must agree with the header. Absent pairs give no row; a revisit has its original's digest and size and no payload.
    """
    folder, shards = archive.folder, archive.shards

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(folder, shards)
        for b in batches:
            got = [c for key, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for c in index.find(key, page)]
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in got], t) for i, t in ((2, pa.string()), (3, pa.int64()), (4, pa.int64()))], ["file", "offset", "length"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        name, f = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):  # bounds the payloads held
                b = batch.slice(start, 256)
                rows = []
                for file, offset, length in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    if file != name:
                        if f is not None:
                            f.close()
                        name, f = file, fs.open_input_file(f"{base}/{file}")
                    f.seek(offset)
                    h, payload = parse_record(zlib.decompress(f.read(length), 31))
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    if h["warc-type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"payload digest of {file} at {offset}")
                    page, to = h.get("x-page"), h.get("x-refers-to-page")
                    rows.append((None if page is None else int(page), h["warc-target-uri"], h["warc-type"], None if to is None else int(to), digest, int(h["x-payload-length"]), payload if payloads and h["warc-type"] == "response" else None))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
                names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    pairs = wanted.select("key", F.col("page_id").cast("long").alias("page_id")).distinct().repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    found = materialize(pairs.mapInArrow(find, "file string, offset long, length long"), "found")
    # dealt by the bytes behind them: stretches of an archive, so that a task reads about READ bytes and seeks forward only
    total = found.agg(F.sum("length")).first()[0] or 0
    stretch = F.floor(F.col("offset") / STRETCH)
    found = found.repartition(max(1, -(-total // READ)), "file", stretch).sortWithinPartitions("file", "offset")
    out = found.mapInArrow(fetch, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")
    return out if payloads else out.drop("payload")


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """``write`` and ``read`` of all pages, in full; nulls and repeated rows as there, a row of ``read`` per distinct (url, page_id)."""
    archive = write(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read(archive, archive.captures.select("key", "page_id"), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


#: RFC 4648 base 32 of the 20 bytes of a digest: eight groups of 40 bits, five bits a letter.
ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h FROM p
), f AS (
  SELECT h, min(page_id) AS first, count(*) AS n FROM d GROUP BY h
), b AS (
  SELECT d.*, CASE WHEN n > 1 AND page_id <> first THEN first END AS refers_to,
         list_transform(range(0, 4), lambda g: CAST('0x' || substr(d.h, CAST(g * 10 + 1 AS INTEGER), 10) AS BIGINT)) AS parts
  FROM d JOIN f USING (h)
)
SELECT page_id, url, payload_bytes, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((parts[CAST(i // 8 + 1 AS INTEGER)] >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest
FROM b"""
