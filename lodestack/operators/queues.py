"""Stage queues over event tables: dedup, retry with backoff, dead letters, suppression, pending counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import backoff

# Tries, first and longest wait, and how long a marker suppresses, in seconds.
ATTEMPTS, BASE, LONGEST, SUPPRESS = 3, 60, 3600, 300


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def dedup_enqueue(events: DataFrame, keys: tuple[str, ...] = ("doc_id", "stage"), order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Enqueues with ``added``: whether the document wasn't in the stage's queue just then.

    A queue is a set: after a document left it (any ``op`` but enqueue), the next enqueue is new again. Events without a column ``op`` are all enqueues.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    if "op" not in events.columns:
        return events.withColumn("added", F.row_number().over(w) == 1)
    return events.withColumn("added", F.coalesce(F.lag("op").over(w) != "enqueue", F.lit(True))).where("op = 'enqueue'")


def failed_documents(states: DataFrame) -> DataFrame:
    """(doc_id) of documents that failed for good in any stage, each once."""
    return states.where("status = 'failed'").select("doc_id").distinct()


def retries(outcomes: DataFrame, keys: tuple[str, ...] = ("doc_id",), order: tuple[str, ...] = ("ts", "event_id"), attempts: int = ATTEMPTS, base: int = BASE, most: int = LONGEST) -> DataFrame:
    """Failures among outcomes (``ok`` boolean) with their attempt, whether it was the last, and the wait before the next try.

    A success starts the count anew, and so does a dead letter, so attempts cycle within a run of failures.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    island = outcomes.withColumn("_run", F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(*order))
    rows = island.where("NOT ok").withColumn("attempt", ((n - 1) % attempts + 1).cast("int"))
    dead = F.col("attempt") == attempts
    return rows.withColumn("dead", dead).withColumn("delay_s", F.when(~dead, backoff(F.col("attempt"), base, most))).drop("_run")


def suppressed(events: DataFrame, marker: Column, key: str = "doc_id", ts: str = "ts", ttl: int = SUPPRESS) -> DataFrame:
    """Events that aren't markers, with ``ignored``: whether a marker of the document is less than ``ttl`` seconds old.

    The latest marker decides, so one sorted pass per document replaces the join over intervals.
    """
    t = seconds(F.col(ts))
    w = Window.partitionBy(key).orderBy(t).rangeBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(marker, t)).over(w)
    return events.withColumn("_marker", marker).withColumn("ignored", F.coalesce(t - last < ttl, F.lit(False))).where("NOT _marker").drop("_marker")


def pending(states: DataFrame) -> DataFrame:
    """(stage, pending) of ready documents; waiting and failed ones don't count."""
    return states.where("status = 'ready'").groupBy("stage").agg(F.count("*").alias("pending"))


def due(states: DataFrame, now: Column) -> DataFrame:
    """States with retries whose time has come made ready again."""
    hit = (F.col("status") == "delayed") & (F.col("due") <= now)
    return states.withColumn("status", F.when(hit, "ready").otherwise(F.col("status"))).withColumn("due", F.when(~hit, F.col("due")))


def ready(states: DataFrame, stage: str, now: Column) -> DataFrame:
    """Ids of a stage's ready set in order, after due retries were released."""
    return due(states, now).where((F.col("stage") == stage) & (F.col("status") == "ready")).select("doc_id").orderBy("doc_id")


def outcomes(results: DataFrame, ok: str = "ok") -> DataFrame:
    """Successes and failures of a stage run; a null outcome is neither."""
    return results.agg(F.count_if(F.col(ok)).alias("succeeded"), F.count_if(~F.col(ok)).alias("failed"))


def healthy(beats: DataFrame, now: Column, poll: int = 300) -> DataFrame:
    """Whether every stage's last heartbeat is at most max(60, 2 poll + 30) seconds old; false without any."""
    return beats.agg(F.coalesce(F.every(now - F.col("beat") <= max(60, 2 * poll + 30)), F.lit(False)).alias("healthy"))


def replay(events: DataFrame, attempts: int = ATTEMPTS, base: int = BASE, most: int = LONGEST) -> DataFrame:
    """Final state of each (doc_id, stage) after events (doc_id, stage, op, ts, event_id) in order: status, attempts, due.

    enqueue makes ready and keeps the attempts; fail waits or, the last time, dead-letters and forgets the attempts; remove and success
    clear all; suppress drops the enqueues of the next SUPPRESS seconds and changes nothing else. Keys without an event that counted
    have no row. Release of due retries is left to ``due``. One aggregation with a fold over each document's own events.
    """
    op = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "op"))), lambda e: F.struct(e["op"].alias("op"), seconds(e["ts"]).alias("t")))
    zero = F.struct(F.lit("none").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("double").alias("due"), F.lit(None).cast("double").alias("until"), F.lit(False).alias("hit"))

    def state(s: Column, status: Column, n: Column, at: Column) -> Column:
        return F.struct(status.alias("status"), n.cast("int").alias("attempts"), at.cast("double").alias("due"), s["until"].alias("until"), F.lit(True).alias("hit"))

    def step(s: Column, e: Column) -> Column:
        n, none = s["attempts"] + 1, F.lit(None)
        failed = F.when(n >= attempts, state(s, F.lit("failed"), F.lit(0), none)).otherwise(state(s, F.lit("delayed"), n, e["t"] + backoff(n, base, most)))
        marked = F.struct(s["status"].alias("status"), s["attempts"].alias("attempts"), s["due"].alias("due"), (e["t"] + SUPPRESS).cast("double").alias("until"), s["hit"].alias("hit"))
        dropped = (e["op"] == "enqueue") & F.coalesce(e["t"] < s["until"], F.lit(False))
        rest = F.when(e["op"] == "enqueue", state(s, F.lit("ready"), s["attempts"], none)).when(e["op"] == "fail", failed).otherwise(state(s, F.lit("none"), F.lit(0), none))
        return F.when(e["op"] == "suppress", marked).when(dropped, s).otherwise(rest)

    return events.groupBy("doc_id", "stage").agg(F.aggregate(op, zero, step).alias("s")).where("s.hit").select("doc_id", "stage", "s.status", "s.attempts", "s.due")
