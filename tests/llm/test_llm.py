"""Operators of the training-data pipeline on small tables, against brute force, round trips and held-out labels."""

from __future__ import annotations

import hashlib
import json
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.llm import blocks, bpe, chat, kneser_ney, language_id, mixing, quality_lm, quality_rules, simhash, topk, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
rng = random.Random(5)


def words(n: int, vocab: str = "the of and bright river stone walks quietly under old tall trees near water every day while birds sing") -> str:
    return " ".join(rng.choice(vocab.split()) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, long, repeated and tied rows, with columns whose names operators use themselves."""
    long = "x" * 50_000 + " " + words(3_000)
    rows = [(1, None, "en", None, 1), (2, "", None, "s", None), (3, " \n\t", "en", "s", 1), (4, long, "en", "s", 1), (5, "The the THE", "en", "s", 1), (5, "The the THE", "en", "s", 1), (None, "the the the", "de", "s", 1), (7, "ünï 漢字   x", "de", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("id", "fp", "fingerprint", "component", "words", "kept", "score", "rank", "t", "p", "row", "turns", "gram", "key"):
        df = df.withColumn(c, F.lit("clash"))
    return df


# --- 1 ---------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text: str | None) -> int:
    lowered = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(fps: list[int], ids: list, distance: int = 4) -> list:
    root = list(range(len(fps)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least: dict[int, int] = {}
    for i, v in enumerate(ids):
        r = find(i)
        least[r] = v if r not in least else min(least[r], v)
    return [least[find(i)] for i in range(len(fps))]


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet="aAbÜ \n\x0b\x85 ", max_size=80)))
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == brute_fingerprint(text)


def test_near_duplicates(spark):
    rows = []
    for g in range(12):
        base = words(80).split()
        for k in range(6):
            w = list(base)
            for _ in range(k):
                w[rng.randrange(len(w))] = f"z{rng.randrange(99)}"
            rows.append((len(rows) * 3 + 1, " ".join(w)))
    rows += [(900, None), (901, ""), (902, "one"), (903, "One"), (904, words(5_000))]
    got = {r["id"]: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    fps = [brute_fingerprint(t) for _, t in rows]
    want = brute_components(fps, [i for i, _ in rows])
    assert [got[i]["fingerprint"] for i, _ in rows] == [format(f, "016x") for f in fps]
    assert [got[i]["component"] for i, _ in rows] == want
    assert len(set(want)) < len(rows)


@pytest.mark.parametrize("cap", [3, 16_384])
def test_links_of_clouds(spark, cap):
    """Clouds of close fingerprints, which fill buckets, and lone ones; also where every longer run is dealt out again."""
    fps = []
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            fps.append(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))))
    fps = list(dict.fromkeys(fps + [rng.getrandbits(64) for _ in range(100)]))
    nodes = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    roots = dict(map(tuple, simhash.connected_components(simhash.near_links(nodes, cap=cap)).collect()))
    got = [roots.get(simhash._signed(f), simhash._signed(f)) for f in fps]
    want = brute_components(fps, [simhash._signed(f) for f in fps])
    assert got == want


def test_masks():
    masks = simhash.block_masks(4, 7)
    assert len(masks) == 35
    for _ in range(200):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(flips & m == 0 for m in masks)


def test_simhash_odd_rows(spark, odd):
    got = simhash.near_duplicates(odd)
    rows = got.collect()
    assert len(rows) == odd.count() and {r["component"] for r in rows if r["id"] in (1, 2, 3)} == {1}
    assert {r["component"] for r in rows if r["id"] in (5, None)} == {5}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


# --- 2, 4 -------------------------------------------------------------------------------------------------------------


def brute_kn(counts: dict[str, int], order: int) -> tuple:
    """Interpolated modified Kneser-Ney probabilities by definition, for n-grams of ``order`` characters and below."""
    levels = {order: dict(counts)}
    for n in range(order - 1, 0, -1):
        levels[n] = {}
        for g in levels[n + 1]:
            levels[n][g[1:]] = levels[n].get(g[1:], 0) + 1

    def discounts(c: dict) -> list[float]:
        n = [0, *(sum(v == i for v in c.values()) for i in (1, 2, 3, 4))]
        if not all(n[1:]):
            return [0.0, 0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        return [0.0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.1), k - 0.05) for k in (1, 2, 3))]

    ds = {n: discounts(levels[n]) for n in levels}

    def p(g: str) -> float:
        if not g:
            return 1.0 / (len(levels[1]) + 1)
        n, ctx = len(g), g[:-1]
        mine = {k: v for k, v in levels[n].items() if k[:-1] == ctx}
        total = sum(mine.values())
        if not total:
            return p(g[1:])
        gamma = sum(ds[n][min(v, 3)] for v in mine.values()) / total
        c = mine.get(g, 0)
        return (c - ds[n][min(c, 3)]) / total + max(gamma, 1e-6) * p(g[1:])

    return p


def ngrams(text: str | None, order: int) -> list[str]:
    s = kneser_ney.START * (order - 1) + (text or "") + kneser_ney.END
    return [s[i : i + order] for i in range(len(s) - order + 1)]


@pytest.mark.parametrize("dense", [1 << 27, 10])
def test_windows(monkeypatch, dense):
    monkeypatch.setattr(kneser_ney, "DENSE", dense)
    monkeypatch.setattr(kneser_ney, "SLICE", 7)
    for order in (1, 2, 3, 5, 6):
        texts = ["".join(rng.choice("ab é😀\n\x02") for _ in range(rng.choice((0, 1, 3, 9, 60)))) for _ in range(30)] + [None, ""]
        g = kneser_ney.grams(pa.array(texts), order)
        n = np.bincount(g.ids, minlength=len(g.codes))
        want = Counter(x for t in texts for x in ngrams((t or "").replace("\x02", "\x01"), order))
        assert {"".join(map(chr, g.codes[i])): int(n[i]) for i in g.real} == dict(want)
    assert len(kneser_ney.grams(pa.array([], pa.string()), 3).real) == 0


def test_language_model(spark, monkeypatch):
    """Counts, probabilities and log-likelihoods of small blocks, against the definition; contexts cross words."""
    monkeypatch.setattr(kneser_ney, "SLICE", 11)
    monkeypatch.setattr(kneser_ney, "PIECE", 500)
    texts = [words(60) for _ in range(30)] + [None, ""]
    top = kneser_ney.count_chars(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), 3)
    counts = Counter(g for t in texts for g in ngrams(t, 3))
    assert {r["gram"]: r["c"] for r in top.collect()} == dict(counts)
    p = brute_kn(counts, 3)
    asked = ["the1 of2", "of2 the1", "river39", "zzz", "trqx é", "", None, words(50)]
    rows = spark.createDataFrame(list(enumerate(asked)), "id long, text string").repartition(3)
    got = {r["id"]: r for r in kneser_ney.log_likelihoods(rows, kneser_ney.char_model(top, 3)).collect()}
    for i, t in enumerate(asked):
        assert got[i]["log_likelihood"] == pytest.approx(sum(np.log(p(g)) for g in ngrams(t, 3)), abs=1e-2)
        assert got[i]["n_chars"] == len(t or "") + 1
    assert got[0]["log_likelihood"] != got[1]["log_likelihood"]
    seen = next(g for g in counts if g.startswith(kneser_ney.START + "t"))[:-1]
    assert sum(p(seen + c) for c in {g[-1] for g in counts}) == pytest.approx(1.0, abs=0.05)


def test_blocks_of_any_size(monkeypatch):
    rows = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([words(rng.randrange(30)) if i % 7 else None for i in range(40)])], ["id", "text"])
    for size in (1, 100, 1 << 20):
        for cut in (40, 3):
            got = list(blocks.blocks(iter([rows.slice(i, cut) for i in range(0, 40, cut)]), size))
            assert [x for _, b in got for x in b.column(0).to_pylist()] == list(range(40))
            assert len({label for label, _ in got}) == len(got)
            assert got == list(blocks.blocks(iter([rows.slice(i, cut) for i in range(0, 40, cut)]), size))


def test_quality_lm(spark, odd):
    good = [(i, words(60), "en" if i % 2 else None, "s", 0) for i in range(160)]
    bad = [(500 + i, " ".join("#|&$!"[rng.randrange(5)] * 4 + str(rng.random()) for _ in range(40)), "en", "s", 0) for i in range(10)]
    docs = spark.createDataFrame(good + bad, DOCS)
    got = {r["id"]: r for r in quality_lm.classify(docs, spark.createDataFrame([(i,) for i in range(140)], "id long"), quantile=0.9).collect()}
    assert not any(got[500 + i]["kept"] for i in range(10))
    for lang in ("en", None):
        held = sorted(r["perplexity"] for r in got.values() if r["fold"] == "threshold" and r["lang"] == lang)
        mine = [r for r in got.values() if r["lang"] == lang]
        assert all(r["threshold"] == pytest.approx(held[int(np.ceil(0.9 * len(held))) - 1], rel=1e-4) for r in mine)
        assert all(r["kept"] == (r["perplexity"] <= r["threshold"] * (1 + 1e-9)) for r in mine)
    assert {r["fold"] for i, r in got.items() if i < 140} == {"model", "threshold"} and {r["fold"] for i, r in got.items() if i >= 140} == {None}
    rows = quality_lm.classify(odd.drop("id", "kept"), spark.createDataFrame([(4,), (99,)], "id long")).collect()
    assert len(rows) == odd.count() and {r["id"] for r in rows if r["perplexity"] is None} == {1, 2, 3}
    assert quality_lm.classify(odd.limit(0), spark.createDataFrame([], "id long")).count() == 0


def toxic_rows(n: int) -> list[tuple]:
    out = []
    for i in range(n):
        t = words(40).split()
        bad = i % 4 == 0
        if bad:
            for at, end in zip(rng.sample(range(len(t)), 3), rng.sample("abcdefgh", 3), strict=True):
                t[at] = "grox" + end + rng.choice("!, ").strip()
        out.append((i, " ".join(t), "en", "s", int(bad)))
    return out


def test_toxicity_by_definition(spark):
    """Counts, log ratios and the ratios of texts, recomputed."""
    rows = toxic_rows(200)
    labelled = spark.createDataFrame([(t, y) for _, t, _, _, y in rows] + [(None, 0), ("", 1)], "text string, cls int").repartition(3)
    strip = lambda t: {w for w in (x.strip(toxicity.MARKS) for x in (t or "").lower().split()) if w}
    counts = [Counter(w for _, t, _, _, y in rows if y == k for w in strip(t)) for k in (0, 1)]
    table = toxicity.class_counts(labelled)
    assert {r["key"]: (r["c0"], r["c1"]) for r in table.collect()} == {w: (counts[0][w], counts[1][w]) for w in {*counts[0], *counts[1]}}
    off = lambda c: min(c, 2)
    total, free = [sum(c.values()) for c in counts], [sum(map(off, c.values())) for c in counts]
    g = max(f / t for f, t in zip(free, total, strict=True))

    def value(w: str) -> float:
        q = (counts[0][w] + counts[1][w]) / sum(total)
        p = [(c[w] - off(c[w])) * (1 - g) / (t - f) + g * q for c, t, f in zip(counts, total, free, strict=True)]
        return float(np.log(p[1] / p[0]))

    model = toxicity.contrast(table)
    got = {r["key"]: r["value"] for r in model.collect()}
    assert got == pytest.approx({w: value(w) for w in {*counts[0], *counts[1]}})
    strong = model.where(F.col("value") >= toxicity.EVIDENCE)
    asked = [rows[0][1], rows[1][1], "Groxa, groxa GROXB! never", "", None]
    made = {r["id"]: r["ratio"] for r in toxicity.ratios(spark.createDataFrame(list(enumerate(asked)), "id long, text string").repartition(2), strong).collect()}
    for i, t in enumerate(asked):
        v = [got.get(w, 0.0) for w in strip(t)]
        assert made[i] == pytest.approx(sum(x for x in v if x >= toxicity.EVIDENCE) / (len(v) + toxicity.SHORT) ** 0.5, abs=1e-6)
    assert made[2] > 0.5 and made[3] == made[4] == 0


def test_toxicity(spark, odd):
    rows = toxic_rows(400)
    docs = spark.createDataFrame(rows, DOCS)
    labelled = docs.where("doc_id < 300").withColumn("toxic", F.col("n_chars").cast("int"))
    got = {r["id"]: r["score"] for r in toxicity.score_toxicity(docs, labelled, F.col("doc_id") % 5 == 0).collect()}
    held = [(got[i], y) for i, _, _, _, y in rows if i >= 300]
    assert all((s >= 0.7) == bool(y) for s, y in held)
    some = toxicity.score_toxicity(odd.drop("id"), labelled, F.col("doc_id") % 5 == 0).collect()
    assert len(some) == odd.count() and all(0 <= r["score"] <= 1 for r in some)
    none = toxicity.score_toxicity(docs.limit(3), labelled.limit(0), F.lit(True)).collect()
    assert len(none) == 3 and all(r["score"] < 0.01 for r in none)
    assert toxicity.score_toxicity(docs.limit(0), labelled, F.col("doc_id") % 5 == 0).count() == 0


def test_calibration_spreads_over_rows(spark, monkeypatch):
    """A table ordered by its label, with more rows to calibrate on than are taken."""
    monkeypatch.setattr(toxicity, "CALIBRATION_ROWS", 40)
    rows = sorted(toxic_rows(600), key=lambda r: r[4])
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    labelled = docs.withColumn("toxic", F.col("n_chars").cast("int"))
    got = {r["id"]: r["score"] for r in toxicity.score_toxicity(docs, labelled, F.col("doc_id") % 3 == 0).collect()}
    assert len(set(got.values())) > 1
    held = [(got[i] >= 0.7) == bool(y) for i, _, _, _, y in rows if i % 3 == 0]
    assert sum(held) >= 0.95 * len(held)


# --- 3 ---------------------------------------------------------------------------------------------------------------


def test_chat_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]},
        {"messages": [{"role": "user"}, {"role": "assistant", "content": "b"}]},
        {"messages": []},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "w"}]},
        {"prompt": "p", "response": "r"},
        {"instruction": "i", "input": "", "output": "o"},
        {"instruction": "i", "input": "more", "output": 5},
        {"unknown": 1},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(8, "no json"), (9, None), (9, None)]
    got = chat.canonical_turns(spark.createDataFrame(rows, "k long, record string").withColumn("turns", F.lit(1)), "k", "record").collect()
    turns = {r["id"]: (r["layout"], [tuple(t) for t in r["turns"]]) for r in got}
    assert len(got) == 11
    assert turns[0] == ("messages", [("user", "a"), ("assistant", "")]) and turns[1] == ("messages", [("user", ""), ("assistant", "b")]) and turns[2] == ("messages", [])
    assert turns[3] == ("shared", [("user", "q"), ("assistant", "w")]) and turns[4] == ("prompt", [("user", "p"), ("assistant", "r")])
    assert turns[5] == ("instruction", [("user", "i"), ("assistant", "o")]) and turns[6] == ("instruction", [("user", "i\n\nmore"), ("assistant", "5")])
    assert all(turns[i] == (None, []) for i in (7, 8, 9))


def test_chat_typed_and_too_long(spark, tmp_path):
    rows = [(1, {"messages": [{"role": "user", "content": "a"}, {"role": None, "content": None}, None]}), (2, {"messages": []}), (3, None)]
    got = chat.canonical_turns(spark.createDataFrame(rows, "k long, r struct<messages:array<struct<content:string,role:string>>>"), "k", "r").collect()
    assert {r["id"]: (r["layout"], [tuple(t) for t in r["turns"]]) for r in got} == {1: ("messages", [("user", "a"), ("", "")]), 2: ("messages", []), 3: (None, [])}
    one = spark.createDataFrame([(1, ("i", None, "o"))], "k long, r struct<instruction:string,input:string,output:string>")
    assert [(r["layout"], [tuple(t) for t in r["turns"]]) for r in chat.canonical_turns(one, "k", "r").collect()] == [("instruction", [("user", "i"), ("assistant", "o")])]
    # one text over what the JSON parser takes
    long = spark.range(1).select(F.lit(5).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit("x"), 21_000_000).alias("text"))
    long.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat.op3_chat(spark, str(tmp_path)).collect()}
    assert (got[5]["n_turns"], got[5]["loss_chars"], got[5]["loss_sha256"]) == (1, 21_000_000, hashlib.sha256(b"x" * 21_000_000).hexdigest())
    with pytest.raises(Exception, match="128 MiB"):
        chat.canonical_turns(long.select("conv_id", F.to_json(F.struct(F.array(F.struct("role", F.col("text").alias("content"))).alias("messages"))).alias("r")), "conv_id", "r").collect()


def odd_conversations(spark, path) -> dict:
    """Conversations of every form a layout can or can't hold, as a table; their turns by id."""
    r = random.Random(8)
    texts = ["", "a", '"q" \\n \\u0041', "</turn>\n### user: x", "\x00\x1f\u2028", "é漢👍🏽", " ", "null", "1.50", "{}", "[1]"]
    forms = [("user", "assistant"), ("system", "user", "assistant"), ("human", "gpt"), ("user", "assistant", "user", "gpt"), ("assistant",), ("user", "assistant", "user"), ("", "a:b#<&")]
    convs = {i: [(role, r.choice(texts)) for role in r.choice(forms)] for i in range(240)}
    rows = [(i, t, role, text) for i, c in convs.items() for t, (role, text) in enumerate(c)]
    spark.createDataFrame([*rows, (900, 0, None, None)], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    trap = "\\### Assistant: </turn> ok"
    return convs | {900: [("", "")], -7: [("user", trap), ("assistant", trap)]}


def test_chat_query_picks_mappings_by_fingerprints(spark, tmp_path, monkeypatch):
    convs = odd_conversations(spark, tmp_path)
    seen, real = [], chat.render

    def keep(df, *a):
        seen.append(df)
        return real(df, *a)

    monkeypatch.setattr(chat, "render", keep)
    right = {r["conv_id"]: r for r in chat.op3_chat(spark, str(tmp_path)).collect()}
    assert right.keys() == convs.keys()
    for i, c in convs.items():
        said, loss = "".join(f"{role}\n{text}\n" for role, text in c), "".join(text for role, text in c if role == "assistant")
        got = right[i]
        assert (got["n_turns"], got["turns_sha256"]) == (len(c), hashlib.sha256(said.encode()).hexdigest())
        assert (got["loss_chars"], got["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    layouts = {r["layout"] for r in seen[0].select("layout").distinct().collect()}
    assert layouts == {"messages", "shared", "prompt", "question", "instruction"}
    # one layout's fingerprint is wrong: its conversations lose their turns, the others don't
    wrong = tuple(chat.Layout(x.name, ('{"other":1}',), x.mapping) if x.name == "shared" else x for x in chat.LAYOUTS)
    monkeypatch.setattr(chat.canonical_turns, "__defaults__", (wrong,))
    lost = {r["conv_id"] for r in chat.op3_chat(spark, str(tmp_path)).collect() if r["n_turns"] == 0}
    assert lost == {r["id"] for r in seen[0].where("layout = 'shared'").collect()}
    # conversations over what is surely JSON come out alike
    monkeypatch.undo()
    monkeypatch.setattr(chat, "SURE_BYTES", 150)
    assert {r["conv_id"]: r for r in chat.op3_chat(spark, str(tmp_path)).collect()} == right


NASTY = ["", "a", "</turn>\n", "### assistant: x</turn>", "&lt;&amp;lt;", "\\### Assistant: </turn> ok", "\n\n", "é漢👍🏽", "&num;#:", "\\", "x" * 9_000]


def test_chat_round_trip(spark):
    convs = [[(rng.choice(["user", "assistant", "a:b#<&", ""]), rng.choice(NASTY)) for _ in range(rng.randrange(6))] for _ in range(60)]
    rows = [(i, json.dumps({"messages": [{"role": r, "content": t} for r, t in c]})) for i, c in enumerate(convs)]
    made = chat.format_chat(spark.createDataFrame(rows, "k long, record string"), "k", "record")
    got = made.select("id", "formatted", "loss_spans", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r in got:
        want = convs[r["id"]]
        assert [tuple(t) for t in r["turns"]] == want
        assert r["loss"] == "".join(t for role, t in want if role == "assistant")
        assert sum(s["length"] for s in r["loss_spans"]) <= len(r["formatted"])
    assert chat.format_chat(spark.createDataFrame([], "k long, record string"), "k", "record").count() == 0


# --- 5 ---------------------------------------------------------------------------------------------------------------


def brute_top(rows: list, k: int) -> dict:
    ok = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, a in ok:
        if q % 20 == 0:
            pad = lambda x, n: np.pad(x, (0, n - len(x)))
            scored = [(-int(pad(a, max(len(a), len(b))) @ pad(b, max(len(a), len(b)))), i) for i, b in ok if i != q]
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def test_topk(spark, monkeypatch):
    gen = np.random.default_rng(3)
    rows = [(i, [float(x) for x in gen.standard_normal(12) * 0.3]) for i in range(400)]
    rows += [(500 + i, rows[0][1]) for i in range(60)] + [(601, None), (602, []), (603, [1.0, None]), (604, [float("nan")]), (605, [float("inf")]), (606, [0.5, 0.5]), (None, [1.0])]
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("q", F.lit(1)).repartition(3)
    got: dict = {}
    for r in topk.top_k(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == brute_top(rows, 20)
    few = df.where("vec_id < 3")
    assert topk.top_k(few, few.where("vec_id = 0")).count() == 2
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_topk_of_large_components(spark):
    """No component is cut: the scores of the issue's example, ties beyond 2**53, and an error over a long."""
    rows = [(20, [0.5, 0.0]), (1, [1e8, 1.0]), (2, [4e7, 2.0]), (3, [2e8, 3.0]), (4, [2e8, 9.0]), (40, [3e6, 3e5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in topk.top_k(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == brute_top(rows, 20) and got[20][:2] == [(3, 32 * 64 * 200_000_000), (4, 32 * 64 * 200_000_000)]
    for big in (1e17, 1e300):
        over = spark.createDataFrame([(20, [big]), (1, [big])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="long|overflow|Overflow|int"):
            topk.top_k(over, over.where("vec_id = 20")).collect()


def test_outsiders_are_not_read():
    gen = np.random.default_rng(7)
    x = np.floor(64 * gen.standard_normal((4_000, 64)) / 8).astype(np.int8)
    q, held = x[:20], [(np.empty(0), np.empty(0, np.int64))] * 20
    read = topk.no_random_access(x, np.arange(4_000), q, np.arange(20), held, 20)
    assert 0.5 < read / (20 * x.size) < 0.95
    scores = x.astype(int) @ q.astype(int).T
    for j in range(20):
        want = sorted((-int(scores[i, j]), i) for i in range(4_000) if i != j)[:20]
        assert [(-int(s), int(i)) for s, i in zip(*held[j], strict=True)] == want


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e9])
def test_no_random_access(scale):
    gen = np.random.default_rng(1)
    x = np.floor(gen.standard_normal((300, 8)) ** 3 * scale).astype(np.int64)
    q = x[:9]
    held = [(np.empty(0), np.empty(0, np.int64))] * 9
    for at in range(0, 300, 100):
        topk.no_random_access(x[at : at + 100], np.arange(at, at + 100), q, np.arange(9), held, 5)
    for j in range(9):
        want = sorted((-(int(sum(int(a) * int(b) for a, b in zip(x[i], q[j], strict=True)))), i) for i in range(300) if i != j)[:5]
        assert [(-int(s), int(i)) for s, i in zip(*held[j], strict=True)] == want


# --- 6 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("leaf", "long"), [(8, 20), (1_024, 4_096)])
def test_codec_matches_library(leaf, long):
    from tokenizers import Tokenizer

    lib, mine = Tokenizer.from_file(BPE), bpe.Codec(BPE, leaf, long)
    alphabets = ["ab", "abcdefghijklmnopqrstuvwxyz", "aé漢字ñ́", "the and ing tion", "a1!?'s", "abß.,!? ", "👍🏽é\x1c\x85\xa0", "Σσς İIı", "<|endoftext|>"]
    for i in range(700):
        t = "".join(rng.choice(alphabets[i % len(alphabets)]) for _ in range(rng.choice([0, 1, 5, 30, 300])))
        t += "<|endoftext|>It's" * (i % 7 == 0)
        e = lib.encode(t, add_special_tokens=False)
        got = next(iter(mine.encode([t])))
        assert " ".join(x[1] for x in got) == " ".join(map(str, e.ids)), repr(t)
        assert " ".join(x[2] for x in got) == lib.decode(e.ids, skip_special_tokens=False)


def test_tree_of_unsplit_text():
    from tokenizers import Tokenizer

    lib, mine = Tokenizer.from_file(BPE), bpe.Codec(BPE)
    for alphabet in ("a", "ab", "etaoinshrdlu", "漢字é"):
        t = "".join(rng.choice(alphabet) for _ in range(20_000))
        assert [int(i) for x in next(iter(mine.encode([t]))) for i in x[1].split()] == lib.encode(t, add_special_tokens=False).ids


def test_bpe_tables(spark, odd):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BPE)
    got = bpe.encode(odd.drop("id"), BPE).collect()
    texts = {(r["doc_id"]): r["text"] or "" for r in odd.collect()}
    assert len(got) == odd.count() and all(r["ids"] == lib.encode(texts[r["id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"]) for r in got)
    d = {r["id"]: r for r in bpe.encode(odd.drop("id"), BPE, digests=True).collect()}
    ids = lib.encode(texts[4], add_special_tokens=False).ids
    assert d[4]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert d[4]["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = {r["id"]: r["decoded"] for r in bpe.decode(bpe.encode(odd.drop("id"), BPE), BPE).collect()}
    assert back[4] == lib.decode(ids, skip_special_tokens=False) and back[1] == ""


# --- 7 ---------------------------------------------------------------------------------------------------------------


def test_url_key():
    assert warc.url_key("http://User@WWW.Example.com:8080/a?b#c") == "com,example,www:8080)/a?b"
    assert warc.url_key("https://example.com") == "com,example)/" and warc.url_key(None) == "" and warc.url_key("http://[bad") == "http://[bad"


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    bodies = [None, "", "<p>é\r\n\r\nWARC/1.1\r\n</p>", "x" * 200_000] + [f"<b>{i}</b>" for i in range(40)]
    pages = [(i, f"http://h{i % 3}.example.com/{i % 5}" if i % 11 else None, bodies[i % len(bodies)]) for i in range(150)] + [(7, "http://bad\r\nurl/", "dup"), (7, "http://bad\r\nurl/", "dup"), (None, "http://n.example.com/", "<b>1</b>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("sha1", F.lit(2)).repartition(4)
    archive = warc.write(df)
    archive.shards = warc.build_index(spark, archive.captures, archive.folder, lines=5)
    got = warc.read(archive, archive.captures).collect()
    assert len(got) == len(pages)
    first: dict = {}
    for i, _, b in pages:
        if i is not None:
            first[b or ""] = min(first.get(b or "", i), i)
    import base64

    def row(i, u, b) -> tuple:
        raw = (b or "").encode()
        to = first[b or ""] if i != first[b or ""] else None
        return i, payload(raw if to is None else None), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if to is None else "revisit", to

    payload = lambda raw: None if raw is None else hashlib.sha1(raw).hexdigest()
    assert Counter((r["page_id"], payload(r["payload"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == Counter(row(*p) for p in pages)
    hits = warc.lookup(archive, "http://h1.example.com/1")
    assert sorted(int(h["x-page"]) for h, _ in hits) == sorted(i for i, u, _ in pages if u == "http://h1.example.com/1")
    assert warc.lookup(archive, "http://absent.example.com/") == []
    small = warc.write(df, min_revisit=10)
    kinds = {r["page_id"]: r["record_type"] for r in warc.read(small, small.captures, payloads=False).collect()}
    assert kinds[1] == kinds[1 + len(bodies)] == "response" and kinds[3 + len(bodies)] == "revisit"
    none = warc.write(df.limit(0))
    assert warc.read(none, none.captures).count() == 0


# --- 8 ---------------------------------------------------------------------------------------------------------------


def brute_measures(text: str | None) -> dict:
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    covered = set()
    for i, x in enumerate(windows):
        if windows.count(x) > 1:
            covered.update(range(i, i + 8))
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def test_quality_rules(spark, odd):
    texts = [None, "", "a b\na b\n \na b", "# | & <>", "p q r s t u v w x " * 4, words(30), words(12) + " " + words(12)]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(40)] + [" x y z\x0bw\x85"]
    got = quality_rules.apply_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        want = brute_measures(texts[r["id"]])
        assert {k: r[k] for k in want} == want
        assert r["base_failed"] == (want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"]) and not (r["base_failed"] and r["kept"])
    rows = quality_rules.apply_rules(odd.drop("id")).collect()
    assert len(rows) == odd.count() and not any(r["kept"] for r in rows if r["id"] in (1, 2, 3, 5))
    assert quality_rules.apply_rules(odd.drop("id").limit(0)).count() == 0
    rules = (quality_rules.Rule("n_words", 2, 3),)
    assert [r["kept"] for r in quality_rules.apply_rules(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), rules=rules).collect()] == [False]


# --- 9 ---------------------------------------------------------------------------------------------------------------


def test_mixing(spark, odd):
    rows = [(i, words(40) if i % 4 else words(25, "der die und haus baum wasser"), "en" if i % 4 else "de", "s", 0) for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS)
    labelled = docs.where("doc_id < 120").withColumn("domain", F.col("lang"))
    c = mixing.fit_classifier(labelled)
    assert c.domains == ["de", "en"]
    for targets, no_loss in ((None, False), ({"de": 0.5, "en": 0.5}, False), ({"de": 1.0}, False), (None, True)):
        mix, table = mixing.fit(docs, c, targets, no_loss=no_loss)
        r = mixing.rates(docs, mix).toPandas()
        assert (r.rate >= 0).all()
        tokens = {d: (r.rate * r.n_tokens)[r.domain == d].sum() for d in c.domains}
        assert mix.reached == pytest.approx(mix.targets, rel=0.02, abs=0.02 * mix.targets.sum())
        assert tokens["de"] == pytest.approx(mix.targets[0], rel=0.1, abs=0.05 * mix.targets.sum())
    mix, _ = mixing.fit(docs, c, no_loss=True)
    more = mixing.repeat_rows(docs, mix)
    assert more.columns == docs.columns and more.select("doc_id").distinct().count() == 200 and more.count() > 200
    got = mixing.rates(odd.drop("id", "p", "t"), mix).collect()
    assert len(got) == odd.count() and all(r["rate"] >= 0 for r in got)
    with pytest.raises(ValueError):
        mixing.fit(docs, c, {"xx": 1.0})
    none = mixing.fit_classifier(labelled.limit(0))
    empty, _ = mixing.fit(docs, none)
    assert {r["rate"] for r in mixing.rates(docs, empty).collect()} == {1.0}
    assert mixing.rates(docs.limit(0), mix).count() == 0


# --- 10 --------------------------------------------------------------------------------------------------------------


def brute_forward(pieces, table, word):
    place = {p: i for i, p in enumerate(pieces.names)}
    w = language_id.BLANK + word
    a = [np.ones(table.shape[1])]
    for e in range(1, len(w) + 1):
        x = a[e - 1] * language_id.UNKNOWN
        for n in range(1, min(e, pieces.longest) + 1):
            if w[e - n : e] in place:
                x = x + a[e - n] * table[place[w[e - n : e]]]
        a.append(x)
    return np.log(a[-1])


def test_forward():
    p = language_id.pieces_of(PIECES)
    gen = np.random.default_rng(0)
    table = gen.random((p.size, 3)) + 0.01
    table /= table.sum(axis=0)
    asked = ["hello", "ñandú", "x", "the", "internationalization", "漢字", "ab" * 14, "hello" * 16]
    got = language_id.forward(p, table, asked)
    for w, row in zip(asked, got, strict=True):
        assert row == pytest.approx(brute_forward(p, table, w), rel=1e-9)
    long = "bright" * 30
    codes = language_id._matrix([language_id.BLANK + long], len(long) + 1)[0]
    assert language_id._forward_long(p, table, codes) == pytest.approx(brute_forward(p, table, long), rel=1e-9)
    assert np.isfinite(language_id.forward(p, table, ["q" * 5_000])).all()
    # expected counts are the gradient of the likelihood by the logarithm of a piece's probability
    counts = language_id.expected_counts(p, table, ["hello"], np.ones((1, 3)))
    i = p.names.index("hell")
    moved = table.copy()
    moved[i] *= 1.0001
    slope = (language_id.forward(p, moved, ["hello"]) - language_id.forward(p, table, ["hello"]))[0] / np.log(1.0001)
    assert counts[i] == pytest.approx(slope, rel=1e-2)


@pytest.mark.parametrize("cells", [100_000, 90])
def test_counts_of_long_words(monkeypatch, cells):
    """Against the gradient of the likelihood by definition, alone and grouped, with and without blocks of positions."""
    monkeypatch.setattr(language_id, "CELLS", cells)
    p = language_id.pieces_of(PIECES)
    table = np.random.default_rng(0).random((p.size, 2)) + 0.01
    table /= table.sum(axis=0)
    asked = ["hello" * 9, "brighthell" * 5, "hellstone" * 25, "ⴰ" * 70 + "hell"]
    i = p.names.index("hell")
    moved = table.copy()
    moved[i] *= 1.0001
    slopes = [(brute_forward(p, moved, w) - brute_forward(p, table, w)) / np.log(1.0001) for w in asked[:2]]
    for w, slope in zip(asked, slopes, strict=False):
        assert language_id.expected_counts(p, table, [w], np.ones((1, 2)))[i] == pytest.approx(slope, rel=1e-2)
    slope = (language_id.forward(p, moved, asked) - language_id.forward(p, table, asked)).sum(axis=0) / np.log(1.0001)
    together = language_id.expected_counts(p, table, asked, np.ones((4, 2)))
    assert together[i] == pytest.approx(slope, rel=1e-2)
    alone = sum(language_id.expected_counts(p, table, [w], np.ones((1, 2))) for w in asked)
    assert together == pytest.approx(alone, rel=1e-9)
    monkeypatch.setattr(language_id, "PLAIN", 0)
    short = ["hello", "internationalization", "漢字", "x"]
    long = language_id.expected_counts(p, table, short, np.ones((4, 2)))
    monkeypatch.setattr(language_id, "PLAIN", 32)
    assert long == pytest.approx(language_id.expected_counts(p, table, short, np.ones((4, 2))), rel=1e-9)


def test_nul_and_other_controls():
    """A NUL is a character like others: it does not end a word."""
    pieces = language_id.pieces_of(PIECES)
    table = np.full((pieces.size, 2), 1.0 / pieces.size)
    place = {p: i for i, p in enumerate(pieces.names)}
    asked = ["hello", "hello\0\0\0", "\0", "a\0b", "x" * 450 + "\0" + "y" * 10]
    for w, got in zip(asked, language_id.forward(pieces, table, asked), strict=True):
        text = language_id.BLANK + w
        logs = np.full(len(text) + 1, -np.inf)
        logs[0] = 0.0
        for e in range(1, len(text) + 1):
            ways = [logs[e - 1] + np.log(language_id.UNKNOWN)] + [logs[e - n] - np.log(pieces.size) for n in range(1, min(e, pieces.longest) + 1) if text[e - n : e] in place]
            logs[e] = np.logaddexp.reduce(ways)
        assert got[0] == pytest.approx(logs[-1], abs=1e-6)


def test_unspaced_languages(spark):
    common = [x for x in language_id.pieces_of(PIECES).names if len(x) == 1 and "\u4e00" <= x <= "\u9fff"][:120]
    own = {"ja": common[:80], "zh": common[40:]}
    rows = [(lang, "".join(rng.choice(own[lang]) for _ in range(rng.randrange(70, 300)))) for lang in ("zh", "ja") * 60]
    langs, table = language_id.learn(spark.createDataFrame([(t, x) for x, t in rows[:80]], "text string, lang string"), PIECES)
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["id"]: r["lang"] for r in language_id.identify(docs, langs, table, PIECES).collect()}
    assert all(got[i] == rows[i][0] for i in range(80, 120))


def test_language_id(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id.op10_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang == got.lang_pred)[got.held_out].mean() > 0.95 and got.score.between(0, 1).all()
    langs, table = language_id.learn(docs.select("text", "lang"), PIECES)
    rows = {r["id"]: r for r in language_id.identify(odd.drop("id", "score"), langs, table, PIECES).collect()}
    assert {i for i, r in rows.items() if r["lang"] == "und"} == {1, 2, 3} and rows[4]["lang"] in langs
    none, empty = language_id.learn(docs.limit(0).select("text", "lang"), PIECES)
    assert none == [] and {r["lang"] for r in language_id.identify(docs.limit(3), none, empty, PIECES).collect()} == {"und"}


# --- queries and pipeline ---------------------------------------------------------------------------------------------


def test_queries_match_sql(spark, sf_dir):
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
    import compare

    from lodestack.llm import registry

    con = compare.connect(sf_dir)
    for name in registry.oracle_sql():
        assert compare.differ(spark, con, name, sf_dir) == "", name
    assert {re.match(r"op\d+", n)[0] for n in registry.queries()} == {f"op{i}" for i in range(1, 14)}


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps = []
    now = docs
    for _, stage in P.STAGES:
        now = stage(spark, now, sf_dir)
        now = P.bpe.materialize(now, "t") if hasattr(P.bpe, "materialize") else now.cache()
        steps.append(now)
    good, clean, single, mixed, tokens = steps
    assert all(d.columns == docs.columns for d in steps[:-1])
    want = {r["id"] for r in quality_rules.apply_rules(docs).where("kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == want
    assert clean.count() <= good.count()
    rows = clean.collect()
    comp = brute_components([brute_fingerprint(r["text"]) for r in rows], [r["doc_id"] for r in rows])
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(comp))
    assert {r["doc_id"] for r in mixed.collect()} == set(comp)
    assert tokens.count() == mixed.count() and tokens.columns == ["doc_id", "n_tokens", "ids"]
    assert P.run(spark, sf_dir).count() == tokens.count()


def test_near_copies_of_null_and_repeated_ids(spark, sf_dir):
    import corpus_pipeline as P

    a, b, c, d, e, f = (words(60) for _ in range(6))
    # groups: three of null ids only, one with ids and a null, one id with texts of two groups, whole rows repeated
    rows = [(None, a), (None, a), (None, b), (None, c), (None, d), (7, d), (9, d), (8, e), (8, e), (8, f), (3, f.upper())]
    docs = spark.createDataFrame([(i, t, "en", "s", n) for n, (i, t) in enumerate(rows)], DOCS).repartition(3)
    got = P.near_copies(spark, docs, sf_dir)
    assert got.columns == docs.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=key) == sorted([(None, a), (None, b), (None, c), (7, d), (8, e), (3, f.upper())], key=key)
    more = spark.createDataFrame([(8, e, "en", "s", 1), (8, f, "en", "s", 2)], DOCS)
    assert {r["text"] for r in P.near_copies(spark, more, sf_dir).collect()} == {e, f}
