"""The inverted file of vectors and the postings, against exact search, brute force and their plans."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestack.operators import postings as P
from lodestack.operators import retrieval as R
from lodestack.operators import vector_index as V

CHUNK = "doc_id long, chunk_index int, text string, correspondent string, embedding array<float>"
rng = random.Random(3)


@pytest.fixture(scope="module")
def clustered(spark):
    """3,000 vectors around 30 centres, copies, and rows whose vector can't be used."""
    r = np.random.default_rng(1)
    centres = r.normal(size=(30, 16))
    rows = [(i, 0, f"t{i}", str(i % 7), [float(x) for x in centres[i % 30] + 0.3 * r.normal(size=16)]) for i in range(3_000)]
    rows += [(3_000 + i, 0, "copy", "1", rows[5][4]) for i in range(20)]
    rows += [(4_000, 0, "null", "1", None), (4_001, 0, "empty", "1", []), (4_002, 0, "zero", "1", [0.0] * 16), (4_003, 0, "nan", "1", [float("nan")] * 16)]
    return spark.createDataFrame(rows, CHUNK)


@pytest.fixture(scope="module")
def index(clustered):
    return V.build(clustered)


def test_all_cells_are_the_exact_search(clustered, index):
    q = [float(x) for x in np.random.default_rng(2).normal(size=16)]
    for k, filters in ((25, None), (10, R.Filters(correspondent="3"))):
        want = R.dense(clustered, q, k, filters).collect()
        got = index.dense(q, k, filters, probes=len(index.cells)).collect()
        assert [(r.doc_id, r.score, r.pos) for r in got] == [(r.doc_id, r.score, r.pos) for r in want]
    assert index.rows.count() == clustered.count()


def test_recall_of_the_default_probes(spark, clustered, index):
    asked = clustered.where("doc_id < 3000 AND doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector"))
    exact = V.exact_search(clustered, asked, 25, 16, others=True)
    assert V.recall(index.search(asked, 25, others=True), exact) >= 0.9 and index.probes < len(index.cells)
    every = index.search(asked, 25, len(index.cells), others=True)
    key = lambda df: sorted((r.query_id, r["rank"], r.id) for r in df.collect())
    assert key(every) == key(exact) and len(key(exact)) == 300 * 25
    # brute force over one query, ties to the smaller id, never itself
    rows = [r for r in clustered.collect() if r.embedding and any(r.embedding) and not np.isnan(r.embedding).any()]
    unit = np.array([r.embedding for r in rows], np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    at = [r.doc_id for r in rows].index(40)
    order = sorted((i for i in range(len(rows)) if i != at), key=lambda i: (-round(float(unit[i] @ unit[at]), 12), rows[i].doc_id))[:25]
    assert [i for q, _, i in key(exact) if q == 40] == [rows[i].doc_id for i in order]


def test_only_probed_cells_are_read(index):
    some = index.nearest([1.0] * 16)[:2]
    plan = index.of_cells(some).where("correspondent = '3'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ivf_cell" in plan or "PartitionFilters: [ivf_cell" in plan
    assert "EqualTo(correspondent,3)" in plan
    files = {p.rsplit("/", 2)[1] for (p,) in index.of_cells(some).select(F.input_file_name()).distinct().collect()}
    assert files == {f"ivf_cell={c}" for c in some}


def test_probing_goes_on_for_k_rows(clustered, index):
    """A rare filter is met outside the nearest cell: as many rows come back as the exact search has."""
    q = [float(x) for x in clustered.where("doc_id = 7").first()["embedding"]]
    filters = R.Filters(correspondent="2")
    assert index.dense(q, 100, filters, probes=1).count() == 100


def test_append_and_reopen(spark, clustered, tmp_path):
    index = V.build(clustered.where("doc_id < 2000"), f"file://{tmp_path}/v", cells=10, probes=10)
    more = index.append(clustered.where("doc_id >= 2000"))
    q = [1.0] * 16
    again = V.VectorIndex.open(spark, more.folder)
    assert [r.doc_id for r in again.dense(q, 30, probes=10).collect()] == [r.doc_id for r in R.dense(clustered, q, 30).collect()]


def test_without_vectors(spark, clustered):
    for rows in (clustered.limit(0), clustered.where("doc_id >= 4000")):
        index = V.build(rows)
        assert index.dense([1.0] * 16, 5).count() == min(5, rows.count())
    one = V.build(clustered.where("doc_id = 9"))
    assert one.dense([1.0] * 16, 5).first()["doc_id"] == 9
    with pytest.raises(ValueError, match="ivf_cell"):
        V.build(clustered.withColumn("ivf_cell", F.lit(1)))


# --- postings ------------------------------------------------------------------------------------------------------------

VOCABULARY = [f"w{i}" for i in range(200)]


def made(n: int, first: int = 0) -> list[tuple]:
    """Documents whose words follow a steep curve: w0 is nearly everywhere."""
    return [(first + i, " ".join(VOCABULARY[min(199, int(rng.paretovariate(0.7)) - 1)] for _ in range(rng.choice([5, 20, 80]))), rng.choice(["en", "de"])) for i in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = made(2_500) + [(9_000, None, "en"), (9_001, "", "de"), (9_002, "W0 w0, w0!", "en"), (9_003, "w0 w0 w0", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def postings(docs):
    return P.Postings.build(docs)


def found(df) -> dict:
    return {r.doc_id: r.bm25 for r in df.collect()}


def scores(df):
    return pytest.approx({r.doc_id: r.bm25 for r in df.collect()}, abs=2e-9)


def best(df, k: int) -> list:
    return [(d, s) for s, d in sorted((-round(r.bm25, 9), r.doc_id) for r in df.collect())[:k] for s in (-s,)]


@pytest.mark.parametrize("query", [["w0", "w3", "w50"], ["w150"], ["w7", "w7", "nowhere"], ["nowhere"]])
def test_scores_equal_the_scan(docs, postings, query):
    assert found(postings.scores(query)) == scores(R.keyword(docs, query))
    for k in (10, 1_000):
        assert [(r.doc_id, r.bm25) for r in postings.top(query, k).collect()] == best(R.keyword(docs, query), k)


def test_bins_are_skipped(spark):
    """With a rare term beside a frequent one most bins can't reach the threshold, and the result is that of the scan."""
    rows = made(20_000, 20_000)
    df = spark.createDataFrame([(d, t + (" rare rare" if d % 5_000 == 0 else ""), x) for d, t, x in rows], "doc_id long, text string, lang string")
    index = P.Postings.build(df)
    report: dict = {}
    got = index.top(["w0", "rare"], 4, report=report)
    assert [(r.doc_id, r.bm25) for r in got.collect()] == best(R.keyword(df, ["w0", "rare"]), 4)
    assert report["read"] < report["bins"] / 4


def test_only_asked_terms_are_read(postings):
    blocks = postings._blocks(["w3", "w50"])
    plan = blocks.select("n", "max_tf", "min_dl")._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [w3,w50])" in plan and "docs" not in plan.split("ReadSchema")[1]
    bins = postings.bounds(["w3"], postings.statistics(["w3"])).limit(3).collect()
    plan = postings._of(postings._blocks(["w3"]), bins)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "In(bin" in plan.replace("Or(", "").replace("And(", "") or "EqualTo(bin" in plan


def test_filters_count_in_the_statistics(docs, postings):
    only = docs.where("lang = 'de'")
    assert found(postings.scores(["w0", "w9"], only.select("doc_id"))) == scores(R.keyword(only, ["w0", "w9"]))
    assert [r.doc_id for r in postings.top(["w0", "w9"], 20, only.select("doc_id")).collect()] == [d for d, _ in best(R.keyword(only, ["w0", "w9"]), 20)]


def test_changes(spark, docs):
    """Added, replaced, deleted, deleted again and unknown documents: at every point the index equals a scan of the documents there are."""
    index = P.Postings.build(docs)
    now = {r.doc_id: r.text for r in docs.collect()}
    frame = lambda d: spark.createDataFrame([(k, v) for k, v in d.items()], "doc_id long, text string")
    new = {10: "w0 w1 w2", 30_000: "w3 w3 w9", 11: "w9"}
    steps = [("add", new), ("delete", [10, 12, 13, 77_777]), ("add", {10: "w9 w0", 13: "w0"}), ("delete", [10, 10]), ("delete", [])]
    for what, arg in steps:
        if what == "add":
            index.add(frame(arg))
            now |= arg
        else:
            index.delete(spark.createDataFrame([(i,) for i in arg], "doc_id long"))
            for i in arg:
                now.pop(i, None)
        again = P.Postings(spark, index.folder)
        assert found(again.scores(["w0", "w9"])) == scores(R.keyword(frame(now), ["w0", "w9"]))
        assert [(r.doc_id, r.bm25) for r in again.top(["w0", "w9"], 15).collect()] == best(R.keyword(frame(now), ["w0", "w9"]), 15)


def test_empty_index(spark, docs):
    index = P.Postings.build(docs.limit(0))
    assert index.top(["w0"], 5).count() == 0 and index.scores(["w0"]).count() == 0
    index.add(docs.where("doc_id < 5"))
    assert index.scores(["w0"]).count() == R.keyword(docs.where("doc_id < 5"), ["w0"]).count()


def test_search_through_indexes(clustered, index, docs, postings):
    """The same hits with indexes and without, filters included."""
    chunks = clustered.where("doc_id < 3000")
    embed = lambda q: [1.0] * 16
    plain = R.HybridSearch(chunks, docs.withColumn("correspondent", F.lit("3")), embed, R.overlap_scorer)
    fast = R.HybridSearch(chunks, plain.docs, embed, R.overlap_scorer, vectors=V.build(chunks, probes=1), postings=postings, probes=1_000)
    for filters in (None, R.Filters(correspondent="3")):
        a, b = (sorted(map(tuple, s.search("w0 w9", filters).collect())) for s in (plain, fast))
        assert a == b and a


@pytest.mark.parametrize("most", [1, 700, 10**9])
def test_blocks_are_made_from_some_bins_at_a_time(monkeypatch, most):
    """Memory of a worker: what is numbered at once has at most TERMS terms or is one document, and the blocks are those of all documents."""
    monkeypatch.setattr(P, "TERMS", most)
    monkeypatch.setattr(P, "BIN", 16)
    monkeypatch.setattr(P, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 3})())}))
    r = random.Random(4)
    texts = [[r.choice("abcdefgh") for _ in range(r.choice([0, 1, 5, 60]))] for _ in range(300)] + [["long"] * 2_000]
    batches = [pa.RecordBatch.from_arrays([pa.array(list(range(i, j))), pa.array(texts[i:j], pa.list_(pa.string()))], ["doc_id", "t"]) for i, j in ((0, 200), (200, 301), (301, 301))]
    got, bins = [], {}
    for b in P._blocks_of(iter(batches)):
        docs = 0
        for term, bin_, packed in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            n = len(packed) // 2
            assert 0 < n <= 16 and bin_ >> 32 == 3
            for d, x in zip(packed[:n], packed[n:], strict=True):
                got.append((term, d, x >> 32, x & (1 << 32) - 1))
                assert bins.setdefault(d, bin_) == bin_
                docs += term == P.ALL
        own = {d for d, bin_ in bins.items() if bin_ in set(b.column(1).to_pylist())}
        assert docs == len(own) and (docs == 1 or sum(len(texts[d]) for d in own) <= most)
    want = [(t, d, texts[d].count(t), len(texts[d])) for d in range(301) for t in sorted(set(texts[d]))] + [(P.ALL, d, 0, len(texts[d])) for d in range(301)]
    assert sorted(got) == sorted(want)


def test_cells_are_compared_with_some_vectors_at_a_time(monkeypatch):
    """Similarities held at once are at most HELD, or one vector's."""
    r = np.random.default_rng(5)
    unit, centroids = r.normal(size=(101, 4)), r.normal(size=(30, 4))
    for held in (1, 100, 10**9):
        monkeypatch.setattr(V, "HELD", held)
        seen = V._to_cells(unit, centroids, lambda s, _: np.array([s.size]))
        assert max(int(x[0]) for x in seen) <= max(held, 30) and sum(int(x[0]) for x in seen) == 101 * 30
        assert (V._cells_of(unit, centroids) == np.argmax(unit @ centroids.T, axis=1)).all()
    assert len(V._cells_of(unit[:0], centroids)) == 0
