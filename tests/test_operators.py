"""Operators on small tables: retrieval, entities, chunks, queues, models, sources, streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lodestack.operators import chunks as C
from lodestack.operators import entities as E
from lodestack.operators import lookups as L
from lodestack.operators import models as M
from lodestack.operators import queues as K
from lodestack.operators import retrieval as R
from lodestack.operators import stages as G
from lodestack.operators.components import connected_components
from lodestack.operators.ranking import global_rank
from lodestack.sources import rest, tables
from lodestack.streaming import queues as SQ


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r[0]: r[1] for r in connected_components(e).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}
    assert connected_components(e.limit(0)).count() == 0


def test_global_rank(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"))
    got = global_rank(rows, [F.desc("x")]).orderBy("rank").collect()
    assert [r["x"] for r in got] == sorted((r["x"] for r in got), reverse=True) and [r["rank"] for r in got] == list(range(1, 1001))
    assert global_rank(rows.limit(0), [F.col("x")]).count() == 0


def chunk_table(spark):
    rows = [(1, 0, "alpha beta", [1.0, 0.0], "A", ["x"]), (1, 1, "beta", [0.9, 0.1], "A", ["x"]), (2, 0, "gamma", [0.0, 1.0], "B", ["y", "x"]), (3, 0, "alpha only", [-1.0, 0.0], "A", []), (None, 0, "lost", [1.0, 0.0], "A", [])]
    return spark.createDataFrame(rows, "doc_id long, chunk_index int, text string, embedding array<float>, correspondent string, tags array<string>")


def test_hybrid_search(spark):
    chunks = chunk_table(spark)
    docs = chunks.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("text").alias("text"))
    s = R.HybridSearch(chunks, docs, lambda q: [1.0, 0.0], R.overlap_scorer)
    assert [r["doc_id"] for r in s.search("alpha beta", mode="recall", limit=10).orderBy("rank").collect()] == [1, 3, 2]
    assert [r["doc_id"] for r in s.search("alpha beta").orderBy("rank").collect()] == [1]
    s.judge = lambda q, ids: R.judge_in_batches(q, ids, lambda q, b: [99, 1])
    assert [r["doc_id"] for r in s.search("alpha beta").collect()] == [1]
    for bad in (lambda: s.search(""), lambda: s.search("x", mode="all"), lambda: s.search("x", mode="recall", limit=None), lambda: s.search("x", limit=101)):
        with pytest.raises(ValueError):
            bad()
    assert R.judge_in_batches("q", list(range(7)), lambda q, b: 1 / 0) == list(range(7))


def test_filters(spark):
    chunks = chunk_table(spark)
    assert R.Filters().predicate() is None and R.Filters(tags=()).predicate() is None
    got = R.filtered(chunks, R.Filters(correspondent="A", tags=("x", "z"))).select("doc_id").distinct().collect()
    assert [r[0] for r in got] == [1]
    assert R.resolve_names(spark.createDataFrame([(1, "A"), (2, "B")], "id long, n string"), "id", "n", ["B", "C"]) is None
    assert R.pool_size(10) == 50 and R.pool_size(5000) == 1000 and R.batches([1, 2, 3], 2) == [[1, 2], [3]]


def test_merge_plan(spark, tmp_path):
    senders = spark.createDataFrame([(1, "Acme Corp."), (2, "ACME Corporation"), (3, "John Smith"), (4, "Legacy Sender"), (5, " ")], "id long, name string")
    docs = spark.createDataFrame([(101, "a", 1), (102, "b", 2), (103, "c", 3), (104, "d", 2), (105, "e", 0)], "id long, title string, correspondent long")
    plan = E.merge_plan(senders, docs)
    c = plan["clusters"].first()
    assert (c["canonical_id"], c["merged_ids"], c["document_ids"], c["confidence"]) == (2, [1], [101], "high")
    assert [r["name"] for r in plan["orphans"].collect()] == [" ", "Legacy Sender"]
    text = E.write_plan(plan, str(tmp_path / "plan.json"), "2024-01-01")
    assert json.loads(text)["clusters"][0]["canonical_id"] == 2
    back = E.read_plan(spark, str(tmp_path / "plan.json"))
    approved = {"clusters": back["clusters"].withColumn("status", F.lit("approved")), "orphans": back["orphans"]}
    left, moved, counts = E.apply_plan(approved, senders, docs)
    assert sorted(r["id"] for r in left.collect()) == [2, 3, 4, 5] and {r["id"]: r["correspondent"] for r in moved.collect()}[101] == 2
    assert counts.first().asDict() == {"reassigned": 1, "deleted": 1, "skipped_deletes": 0, "skipped_clusters": 0}
    _, same, dry = E.apply_plan(approved, senders, docs, dry_run=True)
    assert dry.first()["reassigned"] == 1 and dry.first()["skipped_deletes"] == 1 and {r["id"]: r["correspondent"] for r in same.collect()}[101] == 1


def test_conflict_and_judge(spark):
    senders = spark.createDataFrame([(1, "John Smith"), (2, "Smith Holdings"), (3, "Northern Insurance Agency East"), (4, "Northern Insurance Agency Eastern")], "id long, name string")
    rows = E.records(senders)
    got = {(r["left"], r["right"]): r for r in E.decide(E.pair_features(E.candidate_pairs(rows), rows)).collect()}
    assert got[1, 2]["decision"] == "reject" and got[1, 2]["reasons"] == ["entity_shape_conflict"]
    assert got[3, 4]["decision"] in ("merge", "review")
    pair = E.decide(E.pair_features(E.candidate_pairs(rows), rows)).where("left = 3").withColumn("decision", F.lit("review"))
    assert E.judged(pair, lambda a, b: {"same": True, "confidence": "high"}).first()["decision"] == "merge"
    assert E.judged(pair, lambda a, b: {"same": True, "confidence": "low"}).first()["decision"] == "reject"
    assert E.judged(pair, lambda a, b: 1 / 0).first()["reasons"] == ["judge_error"]


def test_chunks_and_hooks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two three " * 60, "T", None, None, "S"), (2, " ", None, None, None, None)], "doc_id long, text string, title string, correspondent string, document_date string, summary string")
    got = C.situate_with(docs)
    assert got.count() > 1 and got.first()["text"].startswith("Title: T\nSender: Unknown\nDate: Unknown\nSummary: S\n---\n")
    hook = tmp_path / "hook.py"
    hook.write_text("def situate_chunks(chunks, text, meta):\n    return ['H ' + c for c in chunks]\n")
    f = C.load_hook(str(hook))
    assert C.load_hook(str(tmp_path / "none.py")) is None and f(["a"], "", {}) == ["H a"]
    mine = lambda cut, text, meta: ["H " + c for c in cut]
    assert C.situate_with(docs, mine).first()["text"].startswith("H ")
    assert C.situate_with(docs, lambda cut, text, meta: []).first()["text"].startswith("Title: T")
    index = spark.createDataFrame([(1, 0, "old"), (1, 9, "old"), (2, 0, "old")], "doc_id long, chunk_index int, text string")
    assert C.replace_documents(index, got.select("doc_id", F.col("chunk_index").cast("int"), "text")).where("text = 'old'").count() == 1


def test_lookups(spark):
    dim = spark.createDataFrame([(1, "Acme Industries"), (2, "acme industries"), (3, "Beta")], "id long, name string")
    names = spark.createDataFrame([("ACME INDUSTRIES",), ("cme Industries",), (" New ",), ("",)], "name string")
    got = {r["name"]: (r["id"], r["created"]) for r in L.find_or_create(names, dim).collect()}
    assert got == {"ACME INDUSTRIES": (1, False), "cme Industries": (1, False), "New": (4, True)}
    assert L.insert_missing(dim, spark.createDataFrame([(9, "Beta"), (10, "C")], dim.schema), "name").count() == 4
    tagged = spark.createDataFrame([(1, [3, 9, 1]), (2, []), (3, None)], "k int, tags array<long>")
    got = {r["k"]: r["names"] for r in L.tag_names(tagged, "k", "tags", dim, "id", "name").collect()}
    assert got == {1: ["Beta", "Acme Industries"], 2: [], 3: []}


EVENTS = [(55, "ocr", "enqueue", 0, 1), (55, "ocr", "fail", 10, 2), (55, "ocr", "enqueue", 20, 3), (55, "ocr", "fail", 30, 4), (42, "ocr", "enqueue", 1, 5), (42, "ocr", "enqueue", 2, 6), (7, "embed", "fail", 1, 7), (7, "embed", "fail", 2, 8), (7, "embed", "fail", 3, 9), (8, "embed", "enqueue", 1, 10), (8, "embed", "remove", 2, 11)]


def test_replay_and_due(spark):
    events = spark.createDataFrame(EVENTS, "doc_id long, stage string, op string, ts long, event_id long").withColumn("ts", F.timestamp_seconds("ts"))
    states = K.replay(events)
    got = {r["doc_id"]: (r["status"], r["attempts"], r["due"]) for r in states.collect()}
    assert got == {55: ("delayed", 2, 150.0), 42: ("ready", 0, None), 7: ("failed", 0, None), 8: ("none", 0, None)}
    assert [r[0] for r in K.ready(states, "ocr", F.lit(149.0)).collect()] == [42]
    assert [r[0] for r in K.ready(states, "ocr", F.lit(150.0)).collect()] == [42, 55]
    assert [r["added"] for r in K.dedup_enqueue(events.where("doc_id = 42")).orderBy("ts").collect()] == [True, False]


#: A marker that drops an enqueue and one whose time is over, one before anything else, and changes of one second.
MARKED = [(9, "ocr", "enqueue", 1, 12), (9, "ocr", "fail", 2, 13), (9, "ocr", "suppress", 5, 14), (9, "ocr", "enqueue", 100, 15), (10, "ocr", "suppress", 1, 16), (10, "ocr", "enqueue", 2, 17), (11, "ocr", "enqueue", 5, 18), (11, "ocr", "fail", 5, 19), (12, "ocr", "suppress", 1, 20), (12, "ocr", "enqueue", 400, 21)]


def test_replay_of_markers(spark):
    events = spark.createDataFrame(MARKED, "doc_id long, stage string, op string, ts long, event_id long").withColumn("ts", F.timestamp_seconds("ts"))
    got = {r["doc_id"]: (r["status"], r["attempts"], r["due"]) for r in K.replay(events).collect()}
    assert got == {9: ("delayed", 1, 62.0), 11: ("delayed", 1, 65.0), 12: ("ready", 0, None)}


def test_stream_equals_replay(spark, tmp_path):
    events = spark.createDataFrame(EVENTS + MARKED, "doc_id long, stage string, op string, ts long, event_id long")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    SQ.use_rocksdb(spark)
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    SQ.run_once(SQ.stage_queue(stream, timers=False), str(tmp_path / "out"), str(tmp_path / "log"))
    got = SQ.latest(spark.read.schema(SQ.CHANGE).parquet(str(tmp_path / "out")))
    want = K.replay(events.withColumn("ts", F.timestamp_seconds("ts")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_webhooks(spark):
    bodies = ['{"doc_url": "http://x/documents/42/", "tag_list": "ocr,embed"}', '{"id": "7", "tag_list": "", "document_tags": "ocr"}', "no json", '{"a": 1}']
    raw = spark.createDataFrame([(b, 0) for b in bodies], "value string, ts long")
    assert sorted((r["doc_id"], r["stage"]) for r in SQ.parse_webhooks(raw).collect()) == [(7, "refresh"), (42, "ocr")]


def test_models(spark):
    assert M.loose_json('x {"a": 1,} y') == {"a": 1} and M.loose_json('{"a": 1\n"b": 2}') == {"a": 1, "b": 2} and M.loose_json("nothing") == {}
    docs = spark.createDataFrame([(1, "Invoice 2024-01-02\nFrom: Acme"), (2, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in M.extract_metadata(docs, M.FirstLineExtractor).collect()}
    assert str(got[1]["date"]) == "2024-01-02" and got[1]["correspondent"] == "Acme" and got[2]["title"] is None
    assert M.tool_arguments(" ") == {} and M.tool_arguments('{"a": 1}') == {"a": 1}
    with pytest.raises(TypeError):
        M.tool_arguments("[1]")
    replies = [M.Reply(calls=[("search", '{"q": "x"}'), ("nope", None)], usage={"prompt": 10, "completion": 2}), M.Reply("done", usage={"prompt": 20, "completion": 4, "total": 24})]
    tools = M.Tools({"search": lambda q: M.ToolResult("hit", sources=[(42, "search")])})
    turn = M.chat_turn(lambda messages: replies.pop(0), tools, "hi")
    assert turn.text == "done" and turn.usage == {"prompt": 30, "completion": 6, "total": 36} and turn.sources == {42: {"matched": True, "inspected": False}}
    pages = spark.createDataFrame([(1, i, bytes([65 + i])) for i in range(7)], "doc_id long, page int, image binary")
    assert M.read_pages(pages, lambda: lambda batch: [bytes(b).decode() for b in batch]).first()["text"] == "\n\n".join("ABCDEFG")


def test_stages(spark):
    docs = spark.createDataFrame([(1, "", None, None, [1, 9]), (2, "Title 2020-01-01", None, None, [2])], "doc_id long, text string, title string, created date, tags array<long>")
    pages = spark.createDataFrame([(1, 0, b"x"), (1, 1, b"y")], "doc_id long, page int, image binary")
    batch = spark.createDataFrame([(1,), (77,)], "doc_id long")
    r = G.ocr_stage(batch, docs, pages, lambda: lambda b: [bytes(x).decode() for x in b], 1, 2)
    row = r.docs.where("doc_id = 1").first()
    assert row["text"] == "x\n\ny" and row["tags"] == [9, 2] and r.counts().first().asDict() == {"succeeded": 1, "failed": 0}
    m = G.metadata_stage(spark.createDataFrame([(1,), (2,)], "doc_id long"), docs, M.FirstLineExtractor, F.lit("2024-01-01").cast("date"), 2, 3)
    assert m.docs.where("doc_id = 2").first()["tags"] == [3] and m.docs.where("doc_id = 2").first()["title"] == "Title 2020-01-01"
    assert sorted(map(tuple, m.results.collect())) == [(1, None), (2, True)]
    full = docs.select("doc_id", "text", "title", F.lit(None).cast("string").alias("correspondent"), F.lit(None).cast("string").alias("document_date"), F.lit(None).cast("string").alias("summary"))
    index = spark.createDataFrame([(2, 5, "stale", [0.0])], "doc_id long, chunk_index int, text string, embedding array<float>")
    e = G.embed_stage(spark.createDataFrame([(1,), (2,)], "doc_id long"), full, index, M.HashEmbedder)
    assert [(r["doc_id"], r["chunk_index"]) for r in e.index.collect()] == [(2, 0)]


def moody():
    # a local class travels to the workers by value
    class Moody:
        """A reader, extractor and embedder that raises on some inputs."""

        def __call__(self, pages):
            if b"bad" in [bytes(p) for p in pages]:
                raise RuntimeError("unreadable")
            return [bytes(p).decode() for p in pages][: 1 if b"short" in [bytes(p) for p in pages] else None]

        def extract(self, text, attempt):
            if "raise" in text:
                raise RuntimeError("offline")
            answers = {"list": "[1]", "number": '{"title": 5}', "day": '{"title": "t", "date": "soon"}', "think": '<think>{"title": "no"}</think>{"title": "yes"}', "nothing": ""}
            return answers.get(text, '{"title": "fine"}')

        def embed_query(self, text):
            if "raise" in text:
                raise RuntimeError("too long")
            return [1.0]

    return Moody


def test_one_document_fails_alone(spark):
    Moody = moody()
    texts = ["raise", "list", "number", "day", "think", "nothing", "fine", "raise " * 200, " "]
    docs = spark.createDataFrame([(i, t, None, None, [2]) for i, t in enumerate(texts)], "doc_id long, text string, title string, created date, tags array<long>")
    batch = docs.select("doc_id")
    m = G.metadata_stage(batch, docs, Moody, F.lit("2024-01-01").cast("date"), 2, 3)
    assert dict(map(tuple, m.results.collect())) == {0: False, 1: False, 2: False, 3: True, 4: True, 5: True, 6: True, 7: False, 8: None}
    got = {r.doc_id: (r.title, r.tags) for r in m.docs.collect()}
    assert got == {0: (None, [2]), 1: (None, [2]), 2: (None, [2]), 3: ("t", [3]), 4: ("yes", [3]), 5: (None, [3]), 6: ("fine", [3]), 7: (None, [2]), 8: (None, [2])}
    assert {r.doc_id: r.error for r in m.errors.collect()}[0] == "RuntimeError: offline" and m.counts().first().asDict() == {"succeeded": 4, "failed": 4}

    pages = spark.createDataFrame([(0, 0, b"a"), (0, 1, b"bad"), (1, 0, b"short"), (1, 1, b"b"), (6, 0, b"c")] + [(5, i, b"bad" if i == 8 else b"d") for i in range(10)], "doc_id long, page int, image binary")
    o = G.ocr_stage(spark.createDataFrame([(0,), (1,), (5,), (6,), (8,)], "doc_id long"), docs, pages, Moody, 2, 4)
    assert dict(map(tuple, o.results.collect())) == {0: False, 1: False, 5: False, 6: True, 8: False}
    assert {r.doc_id: r.error for r in o.errors.collect()} == {0: "RuntimeError: unreadable", 1: "ValueError: 1 texts of 2 pages", 5: "RuntimeError: unreadable", 8: "no pages"}
    assert {r.doc_id for r in o.docs.where("array_contains(tags, 4)").collect()} == {6} and o.docs.count() == len(texts)

    none = F.lit(None).cast("string")
    full = docs.select("*", none.alias("correspondent"), none.alias("document_date"), none.alias("summary"))
    index = spark.createDataFrame([(7, 9, "stale", [0.0]), (6, 9, "stale", [0.0]), (8, 0, "stale", [0.0])], "doc_id long, chunk_index int, text string, embedding array<float>")
    e = G.embed_stage(spark.createDataFrame([(6,), (7,), (8,), (99,)], "doc_id long"), full, index, Moody, tag=2)
    assert dict(map(tuple, e.results.collect())) == {6: True, 7: False, 8: True, 99: None}
    assert sorted((r.doc_id, r.chunk_index) for r in e.index.collect()) == [(6, 0), (7, 9)]
    assert {r.doc_id: r.tags for r in e.docs.where("doc_id > 5").collect()} == {6: [], 7: [2], 8: []}


def test_template_models_are_asked_again(spark):
    class Late:
        def extract(self, text, attempt):
            return "no json" if attempt < 3 else '{"document_date": "2020-02-03", "title": "not a template key"}'

    got = M.extract_metadata(spark.createDataFrame([(1, "x")], "doc_id long, text string"), Late, "NuExtract-2").first()
    assert str(got.date) == "2020-02-03" and got.title is None and got.error is None
    once = M.extract_metadata(spark.createDataFrame([(1, "x")], "doc_id long, text string"), Late).first()
    assert once.date is None and once.error is None


PAGES = {"count": 5}


def transport(url: str) -> dict:
    from urllib.parse import parse_qs, urlsplit

    q = {k: v[0] for k, v in parse_qs(urlsplit(url).query).items()}
    rows = [{"id": i, "name": f"n{i}"} for i in range(5) if "name" not in q or q["name"] == f"n{i}"]
    at = (int(q["page"]) - 1) * int(q["page_size"])
    return {"count": len(rows), "results": rows[at : at + int(q["page_size"])]}


def test_rest_reader():
    from pyspark.sql.datasource import EqualTo, GreaterThan
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([StructField("id", LongType()), StructField("name", StringType())])
    r = rest.RestReader(schema, {"url": "http://x", "pageSize": "2", "transport": f"{__name__}.transport"})
    assert [x for p in r.partitions() for x in r.read(p)] == [(i, f"n{i}") for i in range(5)]
    left = list(r.pushFilters([EqualTo(("name",), "n3"), GreaterThan(("id",), 1)]))
    assert len(left) == 2 and [x for p in r.partitions() for x in r.read(p)] == [(3, "n3")]


def test_sources(spark, tmp_path):
    golden = {"entries": [{"file_path": "/app/a.pdf", "split": "validation", "tags": ["code-test"]}, {"file_path": "/app/b.c.pdf", "original_key": "k"}, {"file_path": "/app/d", "split": "test"}]}
    (tmp_path / "g.json").write_text(json.dumps(golden))
    rows = tables.golden(spark, str(tmp_path / "g.json"))
    assert [tables.of_split(rows, s).count() for s in ("test", "validation", "all", "code-test")] == [2, 1, 3, 1]
    assert sorted(r["key"] for r in rows.collect()) == ["a", "d", "k"]
    (tmp_path / "e.json").write_text(json.dumps({"experiments": [{"name": "x", "config": {"chunk_size": 9}}]}))
    assert tables.experiments(spark, str(tmp_path / "e.json")).first()["settings"] == {"chunk_size": "9"}
    s = tables.Settings.from_env({"CHUNK_SIZE": "7", "METADATA_API_BASE": " http://x/ ", "OTHER": "1"})
    assert (s.chunk_size, s.metadata_api_base) == (7, "http://x") and s.overlay({"chunk_size": "9", "new": 1}).extra == {"new": 1}
    ext = spark.createDataFrame([(i, i % 7, [f"{i}.PNG", f"{i}.tif"]) for i in range(30)], "id int, n_pages int, files array<string>")
    got = tables.external_documents(ext, kept=5).collect()
    assert len(got) == 5 and all(r["file"].endswith("tif") for r in got)
