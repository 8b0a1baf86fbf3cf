"""The stage queues as a stateful stream: events in, state changes out, retries released by timers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import event_tags, route, webhook_doc_id
from ..operators.queues import ATTEMPTS, BASE, LONGEST, SUPPRESS

#: Order of a timer among the events of its second.
LAST = (1 << 63) - 1
CHANGE = "doc_id long, stage string, status string, attempts int, due double, added boolean, ts double, event_id long"

BODY = "doc_url string, document_url string, document_id string, id string, tag_list string, document_tags string"


def parse_webhooks(raw: DataFrame, value: str = "value", ts: str = "ts") -> DataFrame:
    """(doc_id, stage, op, ts) of webhook bodies; bodies that aren't JSON objects or name no document give no row."""
    body = F.from_json(F.col(value), BODY)
    keys = F.coalesce(F.json_object_keys(F.col(value)), F.array().cast("array<string>"))
    rows = raw.select(body.alias("b"), F.array_contains(keys, "tag_list").alias("has"), F.col(ts).alias("ts"))
    doc = webhook_doc_id(*[F.col(f"b.{c}") for c in ("doc_url", "document_url", "document_id", "id")])
    tags = event_tags(F.col("b.tag_list"), F.col("has"), F.col("b.document_tags"))
    return rows.select(doc.alias("doc_id"), route(tags).alias("stage"), F.lit("enqueue").alias("op"), "ts").where("doc_id IS NOT NULL")


def with_current_tags(events: DataFrame, docs: DataFrame) -> DataFrame:
    """Events (doc_id, tags) with the document's tags now, or those of the event where the document isn't known."""
    now = docs.select("doc_id", F.col("tags").alias("_now"))
    return events.join(now, "doc_id", "left").withColumn("tags", F.coalesce("_now", "tags")).drop("_now")


class StageQueue(StatefulProcessor):
    """State of one (document, stage): status, attempts and due time, and until when a marker suppresses its events.

    With ``timers`` due retries are released by themselves; without, ``queues.due`` releases them over the table. Nothing is kept of a document that is
    in no queue, and a marker is dropped by the store ``suppress`` seconds after it was set.
    """

    def __init__(self, timers: bool = True, suppress: int = SUPPRESS) -> None:
        self.timers, self.suppress = timers, suppress

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, attempts int, due double")
        self.marker = handle.getValueState("marker", "until double", self.suppress * 1000)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer: Any) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        status, attempts, due = self.state.get() if self.state.exists() else ("none", 0, None)
        out = []
        for e in events.itertuples(index=False):
            added = False
            if e.op == "suppress":
                self.marker.update((e.ts + self.suppress,))
                continue
            if e.op == "enqueue":
                if self.marker.exists() and e.ts < self.marker.get()[0]:
                    continue
                added, status, due = status != "ready", "ready", None
            elif e.op == "fail":
                attempts += 1
                if attempts >= ATTEMPTS:
                    status, attempts, due = "failed", 0, None
                else:
                    status, due = "delayed", e.ts + min(BASE * 2.0 ** (attempts - 1), LONGEST)
                    if self.timers:
                        self.handle.registerTimer(int(due * 1000))
            else:
                status, attempts, due = "none", 0, None
            out.append((key[0], key[1], status, attempts, due, added, e.ts, e.event_id))
        if status == "none":
            self.state.clear()
        else:
            self.state.update((status, attempts, due))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGE.split(", ")]).astype({"due": "float64"})

    def handleExpiredTimer(self, key: Any, timer: Any, expired: Any) -> Iterator[pd.DataFrame]:
        if not self.state.exists():  # removed since
            return
        status, attempts, due = self.state.get()
        now = expired.getExpiryTimeInMs() / 1000
        if status == "delayed" and due is not None and due <= now:
            self.state.update(("ready", attempts, None))
            yield pd.DataFrame([(key[0], key[1], "ready", attempts, None, True, now, LAST)], columns=[c.split()[0] for c in CHANGE.split(", ")]).astype({"due": "float64"})

    def close(self) -> None:
        pass


def stage_queue(events: DataFrame, timers: bool = True, suppress: int = SUPPRESS) -> DataFrame:
    """State changes of a stream (doc_id, stage, op, ts in seconds, event_id). Needs the RocksDB state store.

    Time is that of processing, as the markers' is; the once mode goes without timers, which would have it wait for them.
    """
    keyed = events.select("doc_id", "stage", "op", F.col("ts").cast("double").alias("ts"), "event_id")
    return keyed.groupBy("doc_id", "stage").transformWithStateInPandas(statefulProcessor=StageQueue(timers, suppress), outputStructType=CHANGE, outputMode="Append", timeMode="ProcessingTime")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and end: the once mode of the workers."""
    spark = stream.sparkSession
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")  # else batches without data follow for as long as there is time
    try:
        _start(stream, path, checkpoint).awaitTermination()
    finally:
        spark.conf.set(name, before)


def distinct_events(events: DataFrame, time: str, delay: str = "10 minutes", keys: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """A stream's events without repeats that come within ``delay`` of each other by the timestamp column ``time``; older keys are forgotten."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def _start(stream: DataFrame, path: str, checkpoint: str):
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each (doc_id, stage), by time and then by event."""
    return changes.groupBy("doc_id", "stage").agg(F.max_by(F.struct("status", "attempts", "due"), F.struct("ts", "event_id")).alias("s")).select("doc_id", "stage", "s.*")
