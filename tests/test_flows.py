"""Names joined by similarity, state of the queues, the workers' loop, webhooks as a stream and the PATCH sink."""

from __future__ import annotations

import json
import random
import threading
import urllib.request
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lodestack.functions.similarity import length_bound, ratio, ratio_bound
from lodestack.operators import entities as E
from lodestack.operators import queues as K
from lodestack.operators import similar_names as N
from lodestack.sources import rest_sink, webhooks
from lodestack.streaming import queues as SQ
from lodestack.streaming import workers as W

rng = random.Random(9)


# --- names ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def names(spark):
    base = ["Acme Widgets GmbH", "Acme Widgets", "ACME Widget", "Widgets Acme", "Jane Doe", "Jane Dow", "Doe Jane", "Northern Power & Light Inc.", "Northern Power and Light", "Northern Power and Lights", "", "GmbH", "a b c", "a b d", "ab", "ab ab", "Böhm & Söhne", "Boehm Söhne"]
    stems = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "lambda"]
    rows = [(i, n) for i, n in enumerate(base)]
    for i in range(250):
        word = " ".join(rng.choice(stems) for _ in range(rng.choice([1, 2, 3])))
        if rng.random() < 0.5:
            at = rng.randrange(len(word))
            word = word[:at] + rng.choice("xyz") + word[at + 1 :]
        rows.append((100 + i, "Bank " + word))  # one token in all of these names
    return E.records(spark.createDataFrame(rows, "id long, name string"))


def test_near_decisions_are_those_of_all_pairs(names):
    decided = E.decide(E.pair_features(E.candidate_pairs(names), names)).where("decision <> 'reject'")
    want = sorted((r.left, r.right, r.decision) for r in decided.collect())
    near = N.near_decisions(names)
    assert sorted((r.left, r.right, r.decision) for r in N.every_pair(names, near).collect()) == want and len(want) > 50
    assert near.agg(F.sum("weight")).first()[0] + sum(1 for r in decided.where("left_norm = right_norm").select("left").collect()) == len(want)


def test_bounds_change_no_decision(spark, names):
    """Pairs that can't be decided aren't compared, and all others are decided as before."""
    every = E.pair_features(E.candidate_pairs(names), names)
    cols = ["left", "right", "decision", "confidence", "reasons", "ratio", "overlap"]
    key = lambda df: sorted(map(str, df.select(*cols).collect()))
    assert key(E.decisions_of(names)) == key(E.decide(every)) and len(key(E.decide(every))) > 50
    assert E.decidable(every.drop("ratio")).count() < every.count() / 2
    plan = E.decisions_of(names)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("regexp_extract_all")  # the filter lies below the workers


def test_ratio_bound_holds(spark):
    rng = random.Random(8)
    texts = ["", "a", "aaa", "日本語", "😀😀a", "a\nb", "$.*", "x" * 300, "ab" * 150] + ["".join(rng.choice("abc é😀\n") for _ in range(rng.randrange(12))) for _ in range(40)]
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    got = pairs.select("a", "b", ratio("a", "b").alias("r"), ratio_bound("a", "b").alias("most"), length_bound("a", "b").alias("len")).collect()
    for x in got:
        shared = sum((Counter(x.a) & Counter(x.b)).values())
        assert x.r <= x.most <= x.len and x.most == (2.0 * shared / (len(x.a) + len(x.b)) if x.a or x.b else 1.0)


def test_edges_give_the_same_components(names):
    from lodestack.operators.components import connected_components

    def groups(decisions) -> set:
        roots = connected_components(decisions.where("decision = 'merge'").select(F.col("left").alias("a"), F.col("right").alias("b"))).collect()
        by: dict = {}
        for r in roots:
            by.setdefault(r.root, set()).add(r.node)
        return {frozenset(v) for v in by.values()}

    assert groups(N.edges(names)) == groups(E.decide(E.pair_features(E.candidate_pairs(names), names)))


def test_a_token_in_all_names_makes_no_pairs(spark):
    """Three words, one of them in every name: pairs grow with what is near, not with the square of the names."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(8))
    rows = [(i, f"Bank {word()} {word()}") for i in range(1_500)]
    rows += [(2_000 + i, n[:-1] + "z") for i, n in rows[:30]]
    got = N.near_pairs(N.representatives(E.records(spark.createDataFrame(rows, "id long, name string"))))
    assert 20 <= got.count() <= 200


# --- queues --------------------------------------------------------------------------------------------------------------


def test_a_queue_is_a_set(spark):
    ops = ["enqueue", "enqueue", "remove", "enqueue", "fail", "enqueue"]
    events = spark.createDataFrame([(1, "ocr", op, i, i) for i, op in enumerate(ops)], "doc_id long, stage string, op string, ts long, event_id long")
    assert [r.added for r in K.dedup_enqueue(events).orderBy("event_id").collect()] == [True, False, True, True]
    states = spark.createDataFrame([(1, "ocr", "failed"), (1, "embed", "failed"), (2, "ocr", "ready")], "doc_id long, stage string, status string")
    assert [r.doc_id for r in K.failed_documents(states).collect()] == [1]


def test_state_of_removed_documents_goes(spark, tmp_path):
    """The state store holds a row for documents that are in a queue, and for no others."""
    rows = [(d, "ocr", op, t, d * 10 + t) for d in range(1, 9) for t, op in enumerate(["enqueue", "fail" if d % 3 == 0 else "enqueue", "remove" if d % 2 else "enqueue"])]
    events = spark.createDataFrame(rows, "doc_id long, stage string, op string, ts long, event_id long")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    SQ.use_rocksdb(spark)
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    SQ.run_once(SQ.stage_queue(stream, timers=False), str(tmp_path / "out"), str(tmp_path / "log"))
    kept = spark.read.format("statestore").option("path", str(tmp_path / "log")).option("stateVarName", "state").load()
    assert sorted(r.doc_id for r in kept.select("key.doc_id").collect()) == [2, 4, 6, 8]
    got = SQ.latest(spark.read.schema(SQ.CHANGE).parquet(str(tmp_path / "out")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, K.replay(events.withColumn("ts", F.timestamp_seconds("ts"))).collect()))


def test_markers_expire(spark, tmp_path):
    """A marker's row is gone from the store after its time, without an event of its document."""
    folder = tmp_path / "in"
    schema = "doc_id long, stage string, op string, ts long, event_id long"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    write([(1, "ocr", "suppress", 0, 1), (2, "ocr", "enqueue", 0, 2)])
    SQ.use_rocksdb(spark)

    def once() -> set:
        stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(str(folder))
        SQ.run_once(SQ.stage_queue(stream, timers=False, suppress=1), str(tmp_path / "out"), str(tmp_path / "log"))
        rows = spark.read.format("statestore").option("path", str(tmp_path / "log")).option("stateVarName", "marker").load()
        return {r.doc_id for r in rows.select("key.doc_id").collect()}

    assert once() == {1}
    threading.Event().wait(1.5)
    write([(3, "ocr", "enqueue", 9, 3)])
    assert once() == set()


def test_distinct_events(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:05:00"), (2, "2024-01-01 00:01:00")]
    spark.createDataFrame(rows, "event_id long, at string").select("event_id", F.col("at").cast("timestamp").alias("at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, at timestamp").parquet(str(tmp_path / "in"))
    q = SQ.distinct_events(stream, "at").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


# --- workers -------------------------------------------------------------------------------------------------------------


def test_stop_and_restart(spark, tmp_path):
    """Stopped in the middle of a batch, and started again: every document is processed once, and those not reached had failed in between."""
    spark.range(1, 41).withColumnRenamed("id", "doc_id").coalesce(1).write.parquet(str(tmp_path / "in"))
    stop = W.StopFile(spark, f"file://{tmp_path}/stop")
    done: list[int] = []

    def process(docs):
        done.extend(r.doc_id for r in docs.collect())
        if len(done) >= 12 and not stopped:
            stopped.append(True)
            stop.request()
        return docs.withColumn("ok", F.col("doc_id") % 10 != 0)

    stopped: list[bool] = []

    def workers():
        events = spark.readStream.schema("doc_id long").parquet(str(tmp_path / "in"))
        return W.Workers(spark, f"file://{tmp_path}/work", [W.Stage("ocr", events, process)], stop, size=8, poll=0.1)

    assert workers().run(until_idle=True, timeout=120)
    first = workers().counts().first()
    assert 12 <= len(done) < 40 and first.failed > 40 - len(done) - 1
    left = {r.doc_id for r in workers().left("ocr").collect()}
    assert left == set(range(1, 41)) - set(done)
    stop.clear()
    assert workers().run(until_idle=True, timeout=120)
    assert sorted(done) == list(range(1, 41)) and workers().left("ocr").isEmpty()
    ok = workers().outcomes("ocr").where("reached")
    assert ok.count() == 40 and ok.where("ok").count() == 36


def test_a_replayed_batch_leaves_out_what_was_done(spark, tmp_path):
    calls: list[list[int]] = []

    def process(docs):
        ids = sorted(r.doc_id for r in docs.collect())
        calls.append(ids)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return docs.withColumn("ok", F.lit(True))

    w = W.Workers(spark, f"file://{tmp_path}/work", [], lambda: False, size=4)
    docs, stage = spark.range(1, 13).withColumnRenamed("id", "doc_id"), W.Stage("ocr", None, process)
    with pytest.raises(RuntimeError):
        w.run_batch(stage, docs, "batch-0")
    assert w.run_batch(stage, docs, "batch-0")
    first, again = set(calls[0]), {i for c in calls[2:] for i in c}
    assert not first & again and first | again == set(range(1, 13))


# --- webhooks ------------------------------------------------------------------------------------------------------------


def test_webhook_stream_restarts(spark, tmp_path):
    """No event is lost and none doubled over a stop, a restart of the log and a batch that is read again."""
    log = webhooks.EventLog(str(tmp_path / "events"))
    server = webhooks.serve(log)
    url = f"http://127.0.0.1:{server.server_port}"
    post = lambda body: urllib.request.urlopen(urllib.request.Request(url, body.encode(), method="POST"), timeout=10).close()

    def once():
        stream = webhooks.read_webhooks(spark, url, pageSize="3")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.seq, r.value) for r in spark.read.schema(webhooks.EVENT).parquet(str(tmp_path / "out")).collect())

    for i in range(7):
        post(json.dumps({"id": i}))
    assert once() == [(i + 1, json.dumps({"id": i})) for i in range(7)]
    server.shutdown()
    server.server_close()
    again = webhooks.EventLog(str(tmp_path / "events"))
    assert again.last == 7
    server = webhooks.serve(again)
    url = f"http://127.0.0.1:{server.server_port}"
    for i in range(7, 12):
        post(json.dumps({"id": i}))
    assert [s for s, _ in once()] == list(range(1, 13))
    reader = webhooks.WebhookReader({"url": url, "pageSize": "2"})
    parts = reader.partitions({"seq": 7}, reader.latestOffset())
    first, second = ([e for p in parts for e in reader.read(p)] for _ in range(2))
    assert first == second and len(first) == 5
    reader.commit({"seq": 12})
    assert again.events == [] and reader.initialOffset() == {"seq": 12}
    with pytest.raises(Exception, match="410"):
        list(reader.read(parts[0]))
    server.shutdown()


# --- sink ----------------------------------------------------------------------------------------------------------------


@pytest.fixture
def api():
    seen: list[tuple] = []
    refuse: set[str] = set()

    class Handler(BaseHTTPRequestHandler):
        def _take(self) -> None:
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            bad = self.path in refuse
            if not bad:
                seen.append((self.command, self.path, body, self.headers["Idempotency-Key"]))
            self.send_response(500 if bad else 200)
            self.send_header("Content-Length", "0")
            self.end_headers()

        do_PATCH = do_POST = _take

        def log_message(self, *args: object) -> None:
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/documents", seen, refuse
    server.shutdown()


def test_patch_sink(spark, tmp_path, api):
    url, seen, refuse = api
    ledger = f"file://{tmp_path}/ledger"
    rows = spark.createDataFrame([(i, f"title {i}", None if i % 2 else [i]) for i in range(20)] + [(None, "x", None)], "id long, title string, tags array<long>").repartition(4)
    refuse.add("/documents/7/")
    with pytest.raises(Exception, match="500"):
        rest_sink.patch_rows(rows, url, "b1", ledger, abort="true")
    assert ("POST", "/documents/abort") in {s[:2] for s in seen}
    before = [s for s in seen if s[0] == "PATCH"]
    refuse.clear()
    got = rest_sink.patch_rows(rows, url, "b1", ledger)
    patches = [s for s in seen if s[0] == "PATCH"]
    # the second try sent the rest only
    assert sorted(int(p.split("/")[2]) for _, p, _, _ in patches) == list(range(20)) and got == {"sent": 20 - len(before), "skipped": len(before)}
    assert {p: b for _, p, b, _ in patches}["/documents/4/"] == {"title": "title 4", "tags": [4]} and {k for *_, k in patches} == {f"b1:{i}" for i in range(20)}
    rest_sink.patch_rows(rows, url, "b1", ledger)
    assert len([s for s in seen if s[0] == "PATCH"]) == 20


def test_patch_stream(spark, tmp_path, api):
    url, seen, _ = api
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, title string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, title string").parquet(str(tmp_path / "in"))
    for _ in range(2):
        rest_sink.patch_stream(stream, url, f"file://{tmp_path}/ledger", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(p for _, p, _, _ in seen) == ["/documents/1/", "/documents/2/"]
