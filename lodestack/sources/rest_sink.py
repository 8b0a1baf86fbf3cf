"""Rows as PATCH requests to a REST collection: a data sink with commit messages, abort, and a ledger by which a replayed batch sends nothing twice."""

from __future__ import annotations

import json
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..storage import new_folder


def _plain(v: object) -> object:
    if isinstance(v, (date, datetime)):
        return v.isoformat()
    if isinstance(v, Decimal):
        return str(v)
    if isinstance(v, Row):
        return {k: _plain(x) for k, x in v.asDict().items()}
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return v


def send(url: str, body: dict, headers: dict[str, str], method: str = "PATCH", timeout: float = 30.0) -> None:
    """One JSON request; anything but success raises."""
    raw = json.dumps(body, ensure_ascii=False).encode()
    urllib.request.urlopen(urllib.request.Request(url, raw, {"Content-Type": "application/json", **headers}, method=method), timeout=timeout).close()


@dataclass
class Sent(WriterCommitMessage):
    """What a partition did: its requests, and rows that an earlier try of the batch had sent."""

    partition: int
    sent: int
    skipped: int


class PatchWriter(DataSourceWriter):
    """A request per row: ``url``/key/ with the row's other nonnull columns.

    Every request carries ``batch:key`` as its Idempotency-Key, and its key is written to the ledger when it was answered, so a retried task or a
    replayed batch goes on where the last one stopped; between an answer and its line the server's own use of the header counts. A batch that ended is marked in
    the ledger and isn't sent again at all. If a partition fails, the job fails, the server is told by POST ``url``/abort (if ``abort`` is set), and no mark is written.
    """

    def __init__(self, schema: StructType, options: dict) -> None:
        self.names = schema.names
        self.url, self.key, self.batch, self.ledger = options["url"].rstrip("/"), options.get("key", "id"), options["batch"], options["ledger"]
        self.tell, self.token = options.get("abort") == "true", options.get("token")
        if self.key not in self.names:
            raise ValueError(f"no column {self.key}")

    def _headers(self, key: object) -> dict[str, str]:
        return {"Idempotency-Key": f"{self.batch}:{key}"} | ({"Authorization": f"Token {self.token}"} if self.token else {})

    def _known(self, fs: pafs.FileSystem, base: str) -> set[str]:
        """Keys that earlier tries of this batch sent. A batch's rows are bounded by its trigger; a table is sent in batches, too."""
        keys: set[str] = set()
        for f in fs.get_file_info(pafs.FileSelector(f"{base}/{self.batch}", allow_not_found=True)):
            with fs.open_input_file(f.path) as s:
                keys.update(s.read().decode().split("\n")[:-1])
        return keys

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        fs, base = pafs.FileSystem.from_uri(self.ledger)
        part, sent, skipped = TaskContext.get().partitionId(), 0, 0
        if ended(fs, base, self.batch):
            return Sent(part, 0, sum(1 for _ in iterator))
        known, out = self._known(fs, base), None
        try:
            for r in iterator:
                row = dict(zip(self.names, r, strict=True))
                key = row.pop(self.key)
                if json.dumps(_plain(key)) in known:
                    skipped += 1
                    continue
                send(f"{self.url}/{key}/", {k: _plain(v) for k, v in row.items() if v is not None}, self._headers(key))
                if out is None:
                    fs.create_dir(f"{base}/{self.batch}")
                    out = fs.open_output_stream(f"{base}/{self.batch}/{part}-{uuid.uuid4().hex}", compression=None, buffer_size=0)
                out.write((json.dumps(_plain(key)) + "\n").encode())
                sent += 1
        finally:
            if out is not None:
                out.close()
        return Sent(part, sent, skipped)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = pafs.FileSystem.from_uri(self.ledger)
        if not ended(fs, base, self.batch):
            fs.create_dir(base)
            with fs.open_output_stream(f"{base}/{self.batch}.done", compression=None) as f:
                f.write(json.dumps({"sent": sum(m.sent for m in messages if m), "skipped": sum(m.skipped for m in messages if m)}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if self.tell:
            send(f"{self.url}/abort", {"batch": self.batch, "sent": sum(m.sent for m in messages if m)}, self._headers("abort"), "POST")


def ended(fs: pafs.FileSystem, base: str, batch: str) -> bool:
    return fs.get_file_info(f"{base}/{batch}.done").type == pafs.FileType.File


class PatchSink(DataSource):
    """``df.write.format("rest_patch").mode("append").option("url", ...).option("batch", ...).option("ledger", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "rest_patch"

    def schema(self) -> str:
        return "id long"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return PatchWriter(schema, self.options)


def patch_rows(rows: DataFrame, url: str, batch: str, ledger: str | None = None, key: str = "id", **options: str) -> dict:
    """Send the rows as one batch and return its counts. Rows with a null key are not sent; keys must be unique in a batch."""
    spark = rows.sparkSession
    spark.dataSource.register(PatchSink)
    ledger = ledger or new_folder(spark, "ledger")
    writer = rows.where(F.col(key).isNotNull()).write.format("rest_patch").mode("append").option("url", url).option("batch", batch).option("ledger", ledger).option("key", key)
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.save()
    return counts(ledger, batch)


def counts(ledger: str, batch: str) -> dict:
    """``sent`` and ``skipped`` of a batch that ended."""
    fs, base = pafs.FileSystem.from_uri(ledger)
    with fs.open_input_file(f"{base}/{batch}.done") as f:
        return json.loads(f.read())


def patch_stream(stream: DataFrame, url: str, ledger: str, checkpoint: str, key: str = "id", **options: str):
    """A stream's rows as requests, a batch of the sink per micro-batch. Returns the stream writer, ready for a trigger and ``start()``."""
    SparkSession.active().dataSource.register(PatchSink)

    def run(df: DataFrame, batch: int) -> None:
        # one row per key and batch, the last to be read of equal ones
        patch_rows(df.dropDuplicates([key]), url, str(batch), ledger, key, **options)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
