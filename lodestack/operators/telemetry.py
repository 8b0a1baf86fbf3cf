"""Counts of what passes through a plan, and heartbeats of streams, without extra jobs."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def observed(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """``df`` with an observation of its rows and of aggregates; attributes without a value are left out."""
    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in counts.items() if c is not None]), o


#: Registers of a sketch, as a power of two: a standard error of 0.8 %.
REGISTERS = 14


def sketch(column: Column | str) -> Column:
    """A mergeable sketch of the distinct values that pass, for ``observed``; nulls don't count."""
    return F.hll_sketch_agg(column, REGISTERS)


class Distinct:
    """Distinct documents of each stage over many queries, from one sketch per query and stage. What is held is bounded by the sketches united so far, one per stage and 16 KB each at most, and those since."""

    def __init__(self, spark: SparkSession, unite: int = 100) -> None:
        self.spark, self.unite = spark, unite
        self.held: list[tuple[str, int, bytes]] = []

    def add(self, stage: str, found: bytes | None) -> None:
        """A stage that observed nothing leaves nothing."""
        if found is not None:
            self.held.append((stage, 1, bytes(found)))
        if len(self.held) >= self.unite + len({s for s, _, _ in self.held}):
            self.held = [(r["stage"], r["queries"], bytes(r["sketch"])) for r in self._united().collect()]

    def _united(self) -> DataFrame:
        rows = self.spark.createDataFrame(self.held, "stage string, queries long, sketch binary")
        return rows.groupBy("stage").agg(F.sum("queries").alias("queries"), F.hll_union_agg("sketch").alias("sketch"))

    def counts(self) -> DataFrame:
        """(stage, queries, documents)."""
        return self._united().select("stage", "queries", F.hll_sketch_estimate("sketch").alias("documents"))


class Heartbeats(StreamingQueryListener):
    """The last sign of life of each stream by its name, in epoch seconds."""

    def __init__(self) -> None:
        self.beats: dict[str, float] = {}

    def onQueryStarted(self, event) -> None:
        self.beats[event.name or str(event.id)] = time.time()

    def onQueryProgress(self, event) -> None:
        self.beats[event.progress.name or str(event.progress.id)] = time.time()

    def onQueryIdle(self, event) -> None:
        self.beats[str(event.id)] = time.time()

    def onQueryTerminated(self, event) -> None:
        self.beats.pop(str(event.id), None)
