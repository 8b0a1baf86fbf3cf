"""The chunk store against dictionaries, its plans and its files."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestack.operators import chunk_store as S
from lodestack.operators import models as M
from lodestack.operators import stages as G

ROW = "doc_id long, chunk_index int, text string, title string"


def held(store) -> dict:
    got = store.rows().collect()
    assert len({(r.doc_id, r.chunk_index) for r in got}) == len(got)  # a point is in the store once
    return {(r.doc_id, r.chunk_index): (r.text, r.title) for r in got}


@pytest.fixture
def store(spark):
    rows = [(i, j, f"t{i}.{j}", "old") for i in range(300) for j in range(3)] + [(7, j, "hot", "old") for j in range(3, 500)]
    rows += [(None, 0, "no id", "x"), (1, None, "no position", "x"), (2, 0, "t2.0", "old"), (2, 0, "a smaller row", "old"), (-5, 0, "negative", None)]
    return S.ChunkStore.create(spark.createDataFrame(rows, ROW), span=100, buckets=4)


def test_build_leaves_out_rows_without_a_point(store):
    got = held(store)
    assert len(got) == 900 + 497 + 1 and got[2, 0] == ("t2.0", "old") and got[-5, 0] == ("negative", None)


def test_random_updates_equal_dictionaries(spark, store):
    rng, want = random.Random(5), held(store)
    for _ in range(3):
        new = {(rng.randrange(-20, 420), rng.randrange(5)): (rng.choice(["a", "", None]), rng.choice(["n", None])) for _ in range(30)}
        df = spark.createDataFrame([(*k, *v) for k, v in new.items()] * 2, ROW)
        kind = rng.choice(["upsert", "replace", "ids"])
        if kind == "upsert":
            store.upsert(df)
            want |= new
        else:
            ids = {k[0] for k in new} if kind == "replace" else set(rng.sample(range(300), 20))
            store.replace(df, None if kind == "replace" else spark.createDataFrame([(i,) for i in ids] * 2, "doc_id long"))
            want = {k: v for k, v in want.items() if k[0] not in ids} | new
        assert held(store) == want
        gone = rng.sample(range(300), 10)
        store.delete(spark.createDataFrame([(i,) for i in [*gone, None, 10**9]], "doc_id long"))
        want = {k: v for k, v in want.items() if k[0] not in gone}
        meta = {i: rng.choice(["m", None]) for i in rng.sample(range(300), 10)}
        store.refresh(spark.createDataFrame([*meta.items(), (None, "z")], "doc_id long, title string"), ("title",))
        want = {k: (v[0], meta.get(k[0], v[1])) for k, v in want.items()}
        assert held(store) == want


def test_files_of_untouched_parts_stay(spark, store):
    before = set(store.rows().inputFiles())
    assert store.upsert(spark.createDataFrame([(150, 0, "new", "n")], ROW)) == [1]
    after = set(store.rows().inputFiles())
    of = lambda files, part: {f for f in files if f"{S.PART}={part}/" in f}
    assert not of(before, 1) & of(after, 1) and of(before, 1)
    assert of(before, 0) == of(after, 0) and of(before, 2) == of(after, 2)


def test_emptied_part_goes_and_comes_back(spark, store):
    assert store.delete(spark.range(100, 200).toDF("doc_id")) == [1]
    assert not any(f"{S.PART}=1/" in f for f in store.rows().inputFiles()) and store.rows().where("doc_id BETWEEN 100 AND 199").isEmpty()
    store.upsert(spark.createDataFrame([(150, 2, "again", None)], ROW))
    assert store.rows().where("doc_id BETWEEN 100 AND 199").collect() == [(150, 2, "again", None)]


def test_updates_of_nothing_write_nothing(spark, store):
    before = store.rows().inputFiles()
    none = spark.createDataFrame([], ROW)
    assert store.upsert(none) == store.replace(none) == store.delete(none) == store.refresh(none, ("title",)) == []
    assert store.rows().inputFiles() == before


def test_empty_store_fills(spark):
    store = S.ChunkStore.create(spark.createDataFrame([], ROW), buckets=2)
    assert store.rows().isEmpty()
    store.upsert(spark.createDataFrame([(1, 0, "a", "b")], ROW).withColumn("extra", F.lit(1)))
    assert store.rows().collect() == [(1, 0, "a", "b")]
    with pytest.raises(ValueError):
        S.ChunkStore.create(spark.createDataFrame([], ROW).withColumn(S.PART, F.lit(1)))


def test_the_index_is_not_shuffled(spark, store):
    new = spark.createDataFrame([(1, 0, "a", "b")], ROW)
    meta = new.select("doc_id", F.struct("title").alias("_new"))
    with S._settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__requireAllClusterKeysForCoPartition="false"):
        for kept in (S.without_points(store._held([0, 1]), new), S.without_documents(store._held([0, 1]), new), S.refreshed(store._held([0, 1]), meta, ("title",))):
            plan = kept._jdf.queryExecution().executedPlan().toString()
            # one shuffle, of the update: the index is read bucket by bucket, and only its touched parts
            assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
            assert "PartitionFilters: [_part" in plan and "SortMergeJoin" in plan
            at = plan.index("Exchange hashpartitioning")
            assert "FileScan" not in plan[at:]


def test_points_of_other_documents_are_read_from_their_parts(spark, store):
    got = store.of_documents(spark.createDataFrame([(7,), (7,), (250,), (None,)], "doc_id long"))
    assert got.count() == 503
    assert {f.rpartition("/")[0].rpartition("=")[2] for f in got.inputFiles()} == {"0", "2"}


def test_stages_keep_a_store(spark):
    store = S.ChunkStore.create(spark.createDataFrame([(2, 5, "stale", "t", [0.0]), (3, 0, "kept", "t", [1.0])], f"{ROW}, embedding array<float>"), buckets=2)
    none = F.lit(None).cast("string")
    docs = spark.createDataFrame([(2, "some text", "new"), (3, "more", "newer")], "doc_id long, text string, title string")
    docs = docs.select("*", none.alias("correspondent"), none.alias("document_date"), none.alias("summary"))
    G.embed_stage(spark.createDataFrame([(2,), (9,)], "doc_id long"), docs, store, M.HashEmbedder)
    assert {(r.doc_id, r.chunk_index) for r in store.rows().collect()} == {(2, 0), (3, 0)}
    G.refresh_stage(spark.createDataFrame([(3,)], "doc_id long"), docs, store)
    got = store.rows().where("doc_id = 3").first()
    assert (got.title, got.text, got.embedding) == ("newer", "kept", [1.0])
