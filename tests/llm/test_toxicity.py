"""Class-conditional models of characters and the map to a probability, against the definition."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import kneser_ney, toxicity

rng = random.Random(9)


def text(n: int, extra: str = "") -> str:
    return " ".join(rng.choice(f"the of and river stone walks quietly under old trees {extra}".split()) for _ in range(n))


def ngrams(t: str | None, order: int) -> list[str]:
    s = kneser_ney.START * (order - 1) + (t or "") + kneser_ney.END
    return [s[i : i + order] for i in range(len(s) - order + 1)]


def discounts(counts) -> list[float]:
    n = [0, *(sum(v == i for v in counts) for i in (1, 2, 3, 4))]
    if not all(n[1:]):
        return [0.0, 0.5, 1.0, 1.5]
    y = n[1] / (n[1] + 2 * n[2])
    return [0.0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.1), k - 0.05) for k in (1, 2, 3))]


def brute(rows: list[tuple], order: int, shared: int):
    """p(gram, class): counts of a class at the highest order, its continuation counts down to ``shared`` + 1, those of both classes below."""
    tops = [Counter(g for y, t in rows if y == k for g in ngrams(t, order)) for k in (0, 1)]
    levels = {order: [dict(c) for c in tops]}
    for n in range(order - 1, 0, -1):
        if n >= shared + 1:
            levels[n] = [dict(Counter(g[1:] for g in c)) for c in levels[n + 1]]
        else:
            both = dict(Counter(g[1:] for g in {*levels[n + 1][0], *levels[n + 1][1]}))
            levels[n] = [both, both]
    ds = {n: [discounts(c.values()) for c in levels[n]] for n in levels}

    def p(g: str, k: int) -> float:
        if not g:
            return 1.0 / (len(levels[1][0]) + 1)
        c = levels[len(g)][k]
        mine = {x: v for x, v in c.items() if x[:-1] == g[:-1]}
        total, d = sum(mine.values()), ds[len(g)][k]
        if not total:
            return p(g[1:], k)
        own = c.get(g, 0)
        return (own - d[min(own, 3)]) / total + sum(d[min(v, 3)] for v in mine.values()) / total * p(g[1:], k)

    return p


@pytest.mark.parametrize("order, shared", [(4, 2), (3, 2), (3, 1)])
def test_whole_likelihoods_by_definition(spark, order, shared):
    """The ratio is the difference of both log-likelihoods of all of a text over its length; ordinary evidence and repeats count."""
    rows = [(0, text(25)) for _ in range(14)] + [(1, text(20, "grox vile")) for _ in range(6)] + [(0, None), (1, "")]
    model = toxicity.class_models(toxicity.class_grams(spark.createDataFrame(rows, "cls int, text string").repartition(3), order), order, shared)
    p = brute(rows, order, shared)
    asked = ["grox", "grox grox grox", "the old river", "the old river grox", "zzz qé", "", None, text(40, "vile")]
    got = {r["id"]: r for r in toxicity.length_ratios(spark.createDataFrame(list(enumerate(asked)), "id long, text string").repartition(2), model).collect()}
    for i, t in enumerate(asked):
        whole = [sum(np.log(p(g, k)) for g in ngrams(t, order)) for k in (0, 1)]
        assert got[i]["n_chars"] == len(t or "") + 1
        assert got[i]["ratio"] == pytest.approx((whole[1] - whole[0]) / (len(t or "") + 1), abs=1e-4)
    assert got[1]["ratio"] > got[3]["ratio"] > got[2]["ratio"] != 0


def test_ordinary_text_lowers_a_score(spark):
    """The same toxic words among more ordinary ones are weaker evidence, and ordinary texts differ in their ratios."""
    rows = [(i, text(30, "grox grox" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    asked = ["grox " + text(8), "grox " + text(300), text(30), text(30)]
    got = {r["id"]: r for r in toxicity.score_toxicity(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), labelled, F.col("doc_id") % 5 == 0).collect()}
    assert got[0]["score"] >= 0.7 > got[2]["score"] and got[0]["ratio"] > got[1]["ratio"] > got[2]["ratio"]
    assert got[2]["ratio"] != got[3]["ratio"]


def test_rising_map(spark):
    x = np.array([0.1, 0.2, 0.2, 0.3, 0.4, 0.5, 0.6])
    at, p = toxicity.isotonic(x, np.array([0, 1, 0, 0, 1, 1, 1.0]))
    assert at == pytest.approx([0.1, 0.1, 0.2, 0.3, 0.4, 0.6]) and p == pytest.approx([0, 0, 1 / 3, 1 / 3, 1, 1])
    asked = [-5.0, 0.1, 0.15, 0.25, 0.35, 0.5, 9.0]
    rows = spark.createDataFrame([(v,) for v in asked], "x double").select("x", toxicity._between(F.col("x"), at, p).alias("p")).collect()
    assert [r["p"] for r in rows] == pytest.approx(np.interp(asked, at, p).tolist())


def test_pipeline_stage_weighs_whole_texts(spark, tmp_path):
    """The stage's verdict is that of whole likelihoods: one toxic word that fills a text is enough, ordinary texts stay, and null ids, null texts and repeated rows are kept or go alike."""
    import corpus_pipeline

    ordinary = lambda: " ".join(w + str(rng.randrange(40)) for w in text(40).split())
    rows = [(i, ordinary() + "".join(f" grox{c}" for c in rng.sample("abcdefgh", 3 if i % 4 == 0 else 0))) for i in range(400)]
    asked = [(1000, "groxa " * 40), (1000, "groxa " * 40), (None, ordinary()), (1001, ordinary()), (1002, ordinary())]
    spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = [r["doc_id"] for r in corpus_pipeline.toxic(spark, spark.createDataFrame(rows + asked, "doc_id long, text string"), str(tmp_path)).collect()]
    assert 1000 not in kept and {None, 1001, 1002} <= set(kept)
    assert sum(i % 4 != 0 for i in kept if i is not None and i < 1000) >= 290


def test_pipeline_stage_by_definition(spark, tmp_path):
    """The rows that the stage takes out are those of both whole log-likelihoods with shared backoff counts, over the length, through the rising map: counts and map from the rows left, by definition."""
    import corpus_pipeline

    rows = [(i, text(12, "grox vile" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(90)]
    asked = [(1000 + i, t) for i, t in enumerate(["grox vile grox", "the old river", "", None, text(30), text(30, "grox"), "zzz qé"])]
    spark.createDataFrame([(i, y) for i, _, y in rows] + [(7000, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + asked, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.toxic(spark, docs, str(tmp_path)).collect()}
    order, held = toxicity.ORDER, lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    p = brute([(y, t) for i, t, y in rows if not held(i)], order, toxicity.SHARED)

    def ratio(t: str | None) -> float:
        return sum(np.log(p(g, 1)) - np.log(p(g, 0)) for g in ngrams(t, order)) / (len(t or "") + 1)

    at, level = toxicity.isotonic(np.array([ratio(t) for i, t, _ in rows if held(i)]), np.array([float(y) for i, _, y in rows if held(i)]))
    score = {i: float(np.interp(ratio(t), at, level)) for i, t in [(i, t) for i, t, _ in rows] + asked}
    sure = {i for i, s in score.items() if abs(s - corpus_pipeline.TOXIC) > 0.01}
    assert {i for i in sure if score[i] < corpus_pipeline.TOXIC} == kept & sure
    assert len(sure) > 80 and 10 < len(sure - kept) < 60 and 1000 not in kept
