"""Names by containment, the chunker as a table function, and sketches of distinct counts."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodestack.functions import tables
from lodestack.operators import chunks as C
from lodestack.operators import lookups as L
from lodestack.operators import substrings as S
from lodestack.operators import telemetry

LETTERS = "aab é😀"


def words(rng, n: int, longest: int) -> list[str | None]:
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(longest + 1))) for _ in range(n)] + [None, "", "aab", "aab"]


def test_containing_equals_all_pairs(spark):
    """Texts of no, one, two and more characters, outside the basic plane too, repeated rows and nulls."""
    rng = random.Random(5)
    asked, have = words(rng, 120, 6), list(enumerate(words(rng, 200, 14)))
    got = S.containing(spark.createDataFrame([(a,) for a in asked], "l string"), spark.createDataFrame(have, "id long, d string"), "l", "d")
    want = sorted((a, i) for a in asked if a for i, d in have if d and a in d)
    assert sorted((r.l, r.id) for r in got.collect()) == want and want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("hint", ["broadcast", "merge"])
def test_containing_never_broadcasts_runs(spark, tmp_path, monkeypatch, hint):
    """A file of names under the threshold has runs of many times its size: they must not be the side that goes through the driver."""
    if hint == "merge":
        monkeypatch.setattr(S, "BROADCAST_BYTES", 0)
    spark.createDataFrame([(i, f"part {i} of {i % 7}") for i in range(500)], "id long, d string").write.parquet(str(tmp_path / "dim"))
    dim = spark.read.parquet(str(tmp_path / "dim"))
    asked = spark.createDataFrame([("part 1",), ("of 6",), ("f",), ("none",)], "l string")
    got = S.containing(asked, dim, "l", "d")
    lines = got._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    sides = 0
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = list(itertools.takewhile(lambda x: depth(x) > depth(line), lines[i + 1 :]))
            assert not any("Generate" in x for x in below)
            sides += 1
    assert sides or hint == "merge"
    want = {a: sum(a in f"part {i} of {i % 7}" for i in range(500)) for a in ("part 1", "of 6", "f")}
    assert {r["l"]: r["count"] for r in got.groupBy("l").count().collect()} == want


@pytest.mark.parametrize("asked,have", [([], ["abc"]), (["abc"], []), ([], [])])
def test_containing_of_empty_tables(spark, asked, have):
    got = S.containing(spark.createDataFrame([(a,) for a in asked], "l string"), spark.createDataFrame(list(enumerate(have)), "id long, d string"), "l", "d")
    assert got.count() == 0


def brute(names: list[str], dim: list[tuple[int, str]], least: float, candidates: int) -> dict[str, tuple[int, bool]]:
    from difflib import SequenceMatcher

    out, fresh = {}, []
    for name in sorted({n.strip() for n in names} - {""}):
        exact = [i for i, d in dim if d.lower() == name.lower()]
        near = sorted((i, d.lower()) for i, d in dim if name.lower() in d.lower())[:candidates]
        scored = [(SequenceMatcher(None, name.lower(), d).ratio(), -i) for i, d in near]
        scored = [s for s in scored if s[0] >= least]
        if exact:
            out[name] = (min(exact), False)
        elif scored:
            out[name] = (-max(scored)[1], False)
        else:
            fresh.append(name)
    top = max((i for i, _ in dim), default=0)
    return out | {n: (top + k, True) for k, n in enumerate(fresh, 1)}


@pytest.mark.parametrize("candidates", [3, 100])
def test_find_or_create_equals_brute_force(spark, candidates):
    rng = random.Random(7)
    dim = [(i, "".join(rng.choice("AbcB ") for _ in range(rng.randrange(1, 9)))) for i in range(150)]
    # long names, where the matcher leaves frequent characters out, and names of all rows' words
    dim += [(200, "xy" * 110), (201, "xy" * 108 + "z")]
    names = ["".join(rng.choice("aBc") for _ in range(rng.randrange(0, 6))) for _ in range(60)] + ["xy" * 105, "xy" * 109]
    got = L.find_or_create(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(dim, "id long, name string"), candidates=candidates)
    assert {r["name"]: (r["id"], r["created"]) for r in got.collect()} == brute(names, dim, 0.80, candidates)


def test_a_word_in_all_names_is_not_looked_up(spark):
    """Every name has the run of "bank"; texts are found by their rarer runs, so pairs that are compared stay few."""
    dim = spark.range(3_000).select("id", F.concat(F.lit("bank "), F.lpad(F.conv(F.col("id") * 7919, 10, 36), 6, "0")).alias("d"))
    asked = dim.where("id % 50 = 0").select(F.lower("d").alias("l"))
    dim = dim.withColumn("d", F.lower("d"))
    held = dim.select("id", F.explode(S.held_runs(F.col("d"))).alias("run"))
    size = held.groupBy("run").count()
    read = asked.select("l", F.explode(S.asked_runs(F.col("l"))).alias("run")).join(size, "run").groupBy("l").agg(F.min("count").alias("n")).agg(F.sum("n")).first()[0]
    assert S.containing(asked, dim, "l", "d").count() == 60 and read < 60 * 200


# --- chunks_of -----------------------------------------------------------------------------------------------------------


def test_table_function_gives_the_chunks(spark):
    tables.register(spark)
    rows = [(1, "one two three\n" * 100), (2, None), (3, "  "), (4, "x" * 1_300), (5, "one two three\n" * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for args, size, overlap in (("", C.SIZE, C.OVERLAP), (", 100, 10", 100, 10), (", overlap => 0, size => 64", 64, 0)):
        got = spark.sql(f"SELECT d.doc_id, c.chunk_index, c.text FROM {{docs}} d, LATERAL chunks_of(d.text{args}) c", docs=docs)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, C.chunk(docs, size=size, overlap=overlap).collect()))


@pytest.mark.parametrize("call", ["chunks_of('a', 0)", "chunks_of('a', 10, -1)", "chunks_of(1)", "chunks_of('a', 'b')"])
def test_wrong_sizes_are_refused_before_a_job(spark, call):
    tables.register(spark)
    with pytest.raises(Exception, match="must be"):
        spark.sql(f"SELECT * FROM {call}").schema  # noqa: B018


# --- sketches ------------------------------------------------------------------------------------------------------------


def test_sketches_unite(spark):
    """Distinct counts of stages in one pass of each query, united over queries."""
    kept = telemetry.Distinct(spark)
    for first in (0, 4_000):
        rows = spark.range(first, first + 8_000).select(F.col("id").alias("doc_id"))
        found, o = telemetry.observed(rows, f"q{first}", doc=telemetry.sketch("doc_id"), nothing=None)
        found.write.format("noop").mode("overwrite").save()
        kept.add("dense", o.get["doc"])
        assert "nothing" not in o.get and o.get["rows"] == 8_000
    kept.add("rerank", None)
    counts = {r["stage"]: (r["queries"], r["documents"]) for r in kept.counts().collect()}
    assert counts["dense"][0] == 2 and abs(counts["dense"][1] - 12_000) < 12_000 * 0.03 and "rerank" not in counts
    assert telemetry.Distinct(spark).counts().count() == 0
