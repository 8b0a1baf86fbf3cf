"""Webhook bodies as a stream: a durable log behind HTTP, and a streaming source that can read its events again until they are committed."""

from __future__ import annotations

import json
import os
import threading
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

EVENT = "seq long, ts double, value string"


class EventLog:
    """Bodies in the order they came, numbered from 1, each on disk before it is acknowledged. Committed ones may be asked for no more."""

    def __init__(self, path: str) -> None:
        self.path, self.lock = path, threading.Lock()
        self.events: list[tuple[int, float, str]] = []
        self.committed = 0
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                for line in f:
                    if not line.endswith("\n"):
                        break  # cut off while it was written, so never acknowledged
                    e = json.loads(line)
                    if "committed" in e:
                        self.committed = e["committed"]
                    else:
                        self.events.append((e["seq"], e["ts"], e["value"]))
            self.last = self.events[-1][0] if self.events else 0
            self.events = [e for e in self.events if e[0] > self.committed]
        else:
            self.last = 0

    def _write(self, entry: dict) -> None:
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps(entry) + "\n")
            f.flush()
            os.fsync(f.fileno())

    def append(self, value: str, ts: float | None = None) -> int:
        with self.lock:
            entry = (self.last + 1, time.time() if ts is None else ts, value)
            self._write(dict(zip(("seq", "ts", "value"), entry, strict=True)))
            self.last += 1
            self.events.append(entry)
            return self.last

    def between(self, after: int, upto: int) -> list[tuple[int, float, str]]:
        with self.lock:
            if after < self.committed:
                raise LookupError(f"events up to {self.committed} are committed")
            return [e for e in self.events if after < e[0] <= upto]

    def commit(self, upto: int) -> None:
        with self.lock:
            if upto > self.committed:
                self._write({"committed": upto})
                self.committed = upto
                self.events = [e for e in self.events if e[0] > upto]


def serve(log: EventLog, port: int = 0, allowed=lambda headers: True) -> ThreadingHTTPServer:
    """The log behind HTTP: POST / adds a body, GET /latest, GET /events?after=&upto=, POST /commit?upto=. Returns the running server; ``allowed`` judges request headers."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, code: int, body: dict) -> None:
            raw = json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def _route(self, method: str) -> None:
            url = urllib.parse.urlsplit(self.path)
            q = {k: int(v) for k, v in urllib.parse.parse_qsl(url.query)}
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode("utf-8", "replace")
            if not allowed(self.headers):
                return self._answer(403, {})
            try:
                if (method, url.path) == ("POST", "/"):
                    return self._answer(202, {"seq": log.append(body)})
                if (method, url.path) == ("GET", "/latest"):
                    return self._answer(200, {"last": log.last, "committed": log.committed})
                if (method, url.path) == ("GET", "/events"):
                    return self._answer(200, {"events": log.between(q["after"], q["upto"])})
                if (method, url.path) == ("POST", "/commit"):
                    log.commit(q["upto"])
                    return self._answer(200, {})
            except LookupError as e:
                return self._answer(410, {"error": str(e)})
            return self._answer(404, {})

        def do_GET(self) -> None:
            self._route("GET")

        def do_POST(self) -> None:
            self._route("POST")

        def log_message(self, *args: object) -> None:
            pass

    server = ThreadingHTTPServer(("127.0.0.1", port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


def _ask(url: str, method: str = "GET", timeout: float = 30.0) -> dict:
    with urllib.request.urlopen(urllib.request.Request(url, method=method), timeout=timeout) as r:
        return json.load(r)


class Range(InputPartition):
    """Events after one number up to another."""

    def __init__(self, after: int, upto: int) -> None:
        self.after, self.upto = after, upto


class WebhookReader(DataSourceStreamReader):
    """Offsets are event numbers. A batch is read in ranges of ``pageSize`` events, a task each, as often as it must be; Spark's checkpoint says which batch is next."""

    def __init__(self, options: dict) -> None:
        self.url, self.size = options["url"].rstrip("/"), int(options.get("pageSize", 500))

    def initialOffset(self) -> dict:
        return {"seq": _ask(f"{self.url}/latest")["committed"]}

    def latestOffset(self) -> dict:
        return {"seq": _ask(f"{self.url}/latest")["last"]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Range(i, min(i + self.size, end["seq"])) for i in range(start["seq"], end["seq"], self.size)]

    def read(self, partition: Range) -> Iterator[tuple]:
        got = _ask(f"{self.url}/events?after={partition.after}&upto={partition.upto}")["events"]
        if len(got) != partition.upto - partition.after:
            raise ValueError(f"the log lacks events from {partition.after} to {partition.upto}")
        yield from (tuple(e) for e in got)

    def commit(self, end: dict) -> None:
        """Called once the batch before is in the checkpoint: nothing up to its end is read again."""
        _ask(f"{self.url}/commit?upto={end['seq']}", "POST")


class WebhookSource(DataSource):
    """``spark.readStream.format("webhooks").option("url", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "webhooks"

    def schema(self) -> str:
        return EVENT

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return WebhookReader(self.options)


def read_webhooks(spark: SparkSession, url: str, **options: str) -> DataFrame:
    """The bodies as they come: (seq, ts, value), as ``streaming.queues.parse_webhooks`` takes them."""
    spark.dataSource.register(WebhookSource)
    reader = spark.readStream.format("webhooks").option("url", url)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()
