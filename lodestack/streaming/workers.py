"""The workers' loop: a streaming query per stage that runs until it is told to stop, and stops between two slices of a batch."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.queues import outcomes
from ..storage import materialize

OUTCOME = "stage string, batch string, doc_id long, ok boolean, reached boolean, at double"


@dataclass(frozen=True)
class Stage:
    """A stage's events (doc_id) as a stream, and what it does with documents: (doc_id) in, (doc_id, ok) out; null is neither success nor failure."""

    name: str
    events: DataFrame
    process: Callable[[DataFrame], DataFrame]


class StopFile:
    """A stop request that any process can make: a file in the shared folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm, self._path = spark.sparkContext._jvm, path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _fs(self):
        where = self._jvm.org.apache.hadoop.fs.Path(self._path)
        return where.getFileSystem(self._conf), where

    def request(self) -> None:
        fs, where = self._fs()
        fs.create(where, True).close()

    def clear(self) -> None:
        fs, where = self._fs()
        fs.delete(where, False)

    def __call__(self) -> bool:
        fs, where = self._fs()
        return fs.exists(where)


class _Idle(StreamingQueryListener):
    """Which queries have found nothing new since their last batch, and which have ended."""

    def __init__(self) -> None:
        self.idle: set[str] = set()
        self.ended: set[str] = set()
        self.changed = threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        (self.idle.add if event.progress.numInputRows == 0 else self.idle.discard)(str(event.progress.runId))
        self.changed.set()

    def onQueryIdle(self, event) -> None:
        self.idle.add(str(event.runId))
        self.changed.set()

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))
        self.changed.set()


@dataclass
class Workers:
    """Stages over one folder of outcomes and checkpoints.

    A batch's documents are processed in slices of about ``size``; before each, ``stop`` is asked. Documents that are not reached then get an outcome of
    their own: a failure without a mark for a retry, taken up first at the next start. Every slice's outcomes are written when it ends, so a batch that Spark
    replays after a failure leaves out what was done. A failure between a slice's work and its outcomes repeats that slice alone.
    """

    spark: SparkSession
    folder: str
    stages: Iterable[Stage]
    stop: Callable[[], bool]
    size: int = 5
    poll: float = 300.0
    queries: list[StreamingQuery] = field(default_factory=list)

    def outcomes(self, stage: str | None = None) -> DataFrame:
        fs, where = StopFile(self.spark, f"{self.folder}/outcomes")._fs()
        rows = self.spark.read.schema(OUTCOME).parquet(f"{self.folder}/outcomes") if fs.exists(where) else self.spark.createDataFrame([], OUTCOME)
        return rows if stage is None else rows.where(F.col("stage") == stage)

    def left(self, stage: str) -> DataFrame:
        """(doc_id) of documents that were not reached when they were last asked for."""
        rows = self.outcomes(stage).groupBy("doc_id").agg(F.max_by("reached", "at").alias("reached"))
        return rows.where("NOT reached").select("doc_id")

    def counts(self) -> DataFrame:
        """Successes and failures by stage; documents not reached are failures."""
        return self.outcomes().groupBy("stage").agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))

    def _write(self, rows: DataFrame, stage: str, batch: str, reached: bool) -> None:
        named = rows.select(F.lit(stage).alias("stage"), F.lit(batch).alias("batch"), F.col("doc_id").cast("long").alias("doc_id"), F.col("ok").cast("boolean").alias("ok"), F.lit(reached).alias("reached"), F.lit(time.time()).alias("at"))
        named.write.mode("append").parquet(f"{self.folder}/outcomes")

    def run_batch(self, stage: Stage, docs: DataFrame, batch: str) -> bool:
        """Process the batch's documents that have no outcome in it yet; False if it was stopped before the last."""
        done = self.outcomes(stage.name).where(F.col("batch") == batch).select("doc_id")
        todo = materialize(docs.select("doc_id").where("doc_id IS NOT NULL").distinct().join(done, "doc_id", "left_anti"), "batch")
        n = -(-todo.count() // self.size)
        place = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n)))
        for i in range(n):
            if self.stop():
                self._write(todo.where(place >= i).withColumn("ok", F.lit(False)), stage.name, batch, False)
                return False
            mine = todo.where(place == i)
            self._write(mine.join(stage.process(mine), "doc_id", "left"), stage.name, batch, True)
        return True

    def start(self) -> None:
        """Take up what was left, and start a query per stage."""
        for s in self.stages:
            self.run_batch(s, self.left(s.name), f"again-{uuid.uuid4().hex}")
            if self.stop():
                return
        for s in self.stages:

            def run(df: DataFrame, batch: int, s: Stage = s) -> None:
                self.run_batch(s, df, f"batch-{batch}")

            writer = s.events.select("doc_id").writeStream.foreachBatch(run).option("checkpointLocation", f"{self.folder}/checkpoints/{s.name}")
            self.queries.append(writer.trigger(processingTime=f"{int(self.poll * 1000)} milliseconds").start())

    def run(self, until_idle: bool = False, timeout: float | None = None) -> bool:
        """Start, and wait for a stop request or, with ``until_idle``, until no stage finds anything new. True if no query failed.

        A query ends after the batch it is in, which a stop request cuts short at its next slice.
        """
        seen = _Idle()
        self.spark.streams.addListener(seen)
        until = None if timeout is None else time.monotonic() + timeout
        try:
            self.start()
            mine = {str(q.runId) for q in self.queries}
            while mine - seen.ended and not self.stop():
                if (until_idle and mine <= seen.idle | seen.ended) or (until is not None and time.monotonic() > until):
                    break
                seen.changed.wait(0.2)
                seen.changed.clear()
        finally:
            for q in self.queries:
                while q.isActive and q.status["isTriggerActive"]:
                    time.sleep(0.05)
                q.stop()
            self.spark.streams.removeListener(seen)
            failed = [q.exception() for q in self.queries if q.exception() is not None]
            self.queries.clear()
        return not failed


def summary(workers: Workers, stage: str) -> DataFrame:
    """One row of successes and failures of a stage, as ``queues.outcomes`` counts them."""
    return outcomes(workers.outcomes(stage))
