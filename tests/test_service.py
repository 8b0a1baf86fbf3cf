"""Evaluation runs, telemetry, endpoints and the command line."""

from __future__ import annotations

import json
import threading
import urllib.error
import urllib.request

from pyspark.sql import functions as F

from lodestack import service as V
from lodestack.operators import evaluation as X
from lodestack.operators import telemetry
from lodestack.operators.models import FirstLineExtractor
from lodestack.operators.retrieval import HybridSearch, overlap_scorer
from lodestack.sources.tables import Settings


def make(spark) -> V.Service:
    chunks = spark.createDataFrame([(1, 0, "alpha beta", [1.0, 0.0], "A"), (2, 0, "gamma", [0.0, 1.0], "B")], "doc_id long, chunk_index int, text string, embedding array<float>, correspondent string")
    docs = spark.createDataFrame([(1, "alpha beta", "A"), (2, "gamma", "B")], "doc_id long, text string, correspondent string")
    got: list[str] = []
    s = V.Service(HybridSearch(chunks, docs, lambda q: [1.0, 0.0], overlap_scorer), {"senders": spark.createDataFrame([("B",), ("A",)], "name string")}, got.append, secret="s")
    s.got = got
    return s


def test_service(spark):
    s = make(spark)
    assert s.get_search("alpha") == (200, [1]) and s.get_search("alpha", correspondent="B")[1] == [2]
    assert s.get_search("")[0] == 422 and s.get_search("x", 101)[0] == 422
    assert s.get_metadata() == (200, {"senders": ["A", "B"]})
    assert s.get_health()[0] == 503
    s.beats["ocr"] = 100.0
    assert s.get_health(now=700.0)[0] == 200 and s.get_health(now=800.0)[0] == 503
    assert [s.post_webhook(b, t)[0] for b, t in ((b"{}", "s"), (b"no", "s"), (b"{}", "x"))] == [202, 400, 401] and s.got == ["{}"]
    assert s.tool_read(1).sources == [(1, "read")] and "not found" in s.tool_read(9).content
    assert s.tool_search("alpha").sources == [(1, "search")] and "A, B" in s.tool_metadata().content


def test_http(spark):
    server = V.serve(make(spark), 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    assert json.load(urllib.request.urlopen(f"{base}/search?q=alpha&limit=5")) == [1]
    assert json.load(urllib.request.urlopen(f"{base}/metadata/available")) == {"senders": ["A", "B"]}
    try:
        urllib.request.urlopen(urllib.request.Request(f"{base}/webhook/document", b"{}", method="POST"))
        raise AssertionError
    except urllib.error.HTTPError as e:
        assert e.code == 401
    server.shutdown()


def test_evaluation(spark, tmp_path):
    rows = [("a", "Invoice 2024-01-02\nFrom: Acme Inc.", "Acme", "2024-01-02", "invoice"), ("b", "Letter", None, None, None)]
    entries = spark.createDataFrame(rows, "file_path string, text string, expected_correspondent string, expected_date string, expected_title_contains string")

    def agent(settings: Settings):
        if settings.extra.get("broken"):
            raise RuntimeError
        return FirstLineExtractor()

    got = X.run_experiments(spark, entries, [("plain", {}), ("worse", {"broken": 1})], agent, Settings(), str(tmp_path / "scores")).collect()
    assert [r["experiment"] for r in got][:1] == ["plain"] and got[0]["correspondent_exact_accuracy"] == 1.0 and got[0]["date_exact_accuracy"] == 1.0 and got[0]["n"] == 2
    titles = entries.select("file_path", F.when(F.col("file_path") == "a", "T").alias("title"), "text")
    judges = [lambda t, x: "appropriate", lambda t, x: "appropriate", lambda t, x: 1 / 0]
    assert {r["file_path"]: r["score"] for r in X.jury(titles, judges).collect()} == {"a": 1.0, "b": 0.0}
    assert X.load_agent("lodestack.operators.models.FirstLineExtractor") is FirstLineExtractor


def test_telemetry(spark):
    df, o = telemetry.observed(spark.range(10), "n", even=F.count_if(F.col("id") % 2 == 0))
    df.collect()
    assert o.get == {"rows": 10, "even": 5}


def test_command_line(spark, tmp_path, capsys):
    spark.createDataFrame([(1, "Acme Corp."), (2, "ACME Corporation")], "id long, name string").write.parquet(str(tmp_path / "senders.parquet"))
    spark.createDataFrame([(9, "t", 1)], "id long, title string, correspondent long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, '{"ocr_model": 1}'), (2, "hand-written")], "id long, note string").write.parquet(str(tmp_path / "notes.parquet"))
    plan = tmp_path / "plan.json"
    assert V.main(["--tables", str(tmp_path), "--cleanup-plan", str(plan)], spark) == 0
    plan.write_text(plan.read_text().replace("pending", "approved"))
    out = str(tmp_path / "out")
    V.main(["--tables", str(tmp_path), "--out", out, "--cleanup-apply", str(plan), "--purge-notes"], spark)
    assert "1 notes" in capsys.readouterr().out
    assert [r["id"] for r in spark.read.parquet(f"{out}/notes.parquet").collect()] == [2]
    assert spark.read.parquet(f"{out}/senders.parquet").count() == 1
