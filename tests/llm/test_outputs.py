"""Token files, fill-in-middle and the audit of filters, against the library, brute force and round trips."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from itertools import permutations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestack.llm import fim, interactions, mixing_coder, token_files

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
rng = random.Random(11)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, long, repeated and tied rows, with columns whose names operators use themselves."""
    long = "x" * 30_000 + " " + " ".join(rng.choice(["river", "Stone", "a\nb", "#1", "\x01\x02", "end."]) for _ in range(3_000))
    rows = [(1, None, "en", None, 1), (2, "", None, "s", None), (3, " \n\t", "en", "s", 1), (4, long, "en", "s", 1), (5, "The the THE", "en", "s", 1), (5, "The the THE", "en", "s", 1)]
    rows += [(6, "The the THE", "de", "s", 1), (None, "The the THE", "de", "s", 1), (None, "ünï 漢字   x\x01y\x022", "de", "s", 1), (7, "has <P> in it", "fr", "s", 1), (8, long, "fr", "s", 1), (9, None, "fr", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("id", "own", "part", "digest", "mask", "n", "row", "words", "h1", "marked", "output", "form", "start", "first", "good", "toxic"):
        df = df.withColumn(c, F.lit("clash"))
    return df


# --- 11 --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("n", "k", "block"), [(1, 1, 512), (5, 3, 512), (600, 2, 512), (513, 50_000, 512), (2_000, 1, 700), (9_000, 40, 512)])
def test_coder_round_trip(n, k, block):
    r = np.random.default_rng(n)
    ids = np.where(r.random(n) < 0.5, r.integers(0, k, n), np.arange(n) % min(k, 7))
    lengths = np.full(-(-n // block), block)
    lengths[-1] = n - block * (len(lengths) - 1)
    prior = mixing_coder.prior_of(ids, k)
    blocks = mixing_coder.encode(ids, lengths, prior)
    assert (mixing_coder.decode(blocks, lengths, prior) == ids).all()
    # every block alone, since none needs another
    for i, (b, size) in enumerate(zip(blocks, lengths, strict=True)):
        assert (mixing_coder.decode([b], np.array([size]), prior) == ids[i * block : i * block + size]).all()


def test_coder_learns():
    """Contexts help: a repeated pattern of order 2 costs far less than its order-0 entropy, and noise costs little more than it must."""
    pattern = np.tile(np.array([1, 2, 1, 3, 4, 2, 5, 6] * 4), 128)
    lengths = np.array([len(pattern)])
    bits = 8 * len(mixing_coder.encode(pattern, lengths, mixing_coder.prior_of(pattern, 7))[0]) / len(pattern)
    assert bits < 0.6
    noise = np.random.default_rng(1).integers(0, 256, 4_096)
    bits = 8 * len(mixing_coder.encode(noise, np.array([4_096]), mixing_coder.prior_of(noise, 256))[0]) / 4_096
    assert bits < 8.6


@pytest.mark.parametrize(("k", "sizes"), [(3_000, [25_000, 25_000, 10_001]), (3_000, [25_000, 25_000, 3]), (200_000, [30_000, 30_000]), (40, [1_025, 1_024])])
def test_lanes_share_the_model_of_a_block(monkeypatch, k, sizes):
    """A block of many ids takes as many steps as one of its lanes has ids, and is still decoded alone."""
    r = np.random.default_rng(k)
    ids = np.minimum(r.zipf(1.3, sum(sizes)), k) - 1
    ids[::3] = r.integers(0, k, len(ids[::3]))
    asked, own = [], mixing_coder.Model.update
    monkeypatch.setattr(mixing_coder.Model, "update", lambda *x: asked.append(1) or own(*x))
    prior = mixing_coder.prior_of(ids, k)
    blocks = mixing_coder.encode(ids, np.array(sizes), prior)
    assert len(asked) <= 1_024
    assert (mixing_coder.decode(blocks, np.array(sizes), prior) == ids).all()
    ends = np.cumsum(sizes)
    for b, n, end in zip(blocks, sizes, ends, strict=True):
        assert (mixing_coder.decode([b], np.array([n]), prior) == ids[end - n : end]).all()


def test_damaged_lanes_raise():
    """A block that lost or gained bytes, or whose list of lanes is wrong, raises; other damage gives other ids, never another error."""
    ids = np.random.default_rng(3).integers(0, 500, 3_000)
    prior, n = mixing_coder.prior_of(ids, 500), np.array([3_000])
    (raw,) = mixing_coder.encode(ids, n, prior)
    for bad in (raw[:-1], raw + b"x", b"", raw[:9], b"\0\0\0\0" + raw[4:], b"\xff" + raw[1:], raw[:4] + b"\x01" + raw[5:]):
        with pytest.raises(ValueError, match="damaged"):
            mixing_coder.decode([bad], n, prior)
    for at in range(28, len(raw), 97):
        broken = bytearray(raw)
        broken[at] ^= 0x5A
        got = mixing_coder.decode([bytes(broken)], n, prior)
        assert len(got) == 3_000 and 0 <= got.min() and got.max() < 500


def test_segments_are_checked():
    ids = np.array([rng.randrange(60_000) for _ in range(3_000)], np.uint32)
    raw = token_files.pack(ids, [3, None, -5], [1_000, 0, 2_000])
    s = token_files.Segment.parse(raw)
    assert (s.ids() == ids).all() and s.keys == [3, None, -5] and s.sizes.tolist() == [1_000, 0, 2_000]
    assert (s.ids(slice(2, 4)) == ids[1_024:2_048]).all()
    for at in (8, 60, len(raw) - 40):
        broken = bytearray(raw)
        broken[at] ^= 0x40
        with pytest.raises(ValueError, match="damaged|cut short"):
            token_files.Segment.parse(bytes(broken)).ids()
    with pytest.raises(ValueError, match="damaged|cut short"):
        token_files.Segment.parse(raw[:-1])
    empty = token_files.Segment.parse(token_files.pack(np.empty(0, np.uint32), [], []))
    assert len(empty.ids()) == 0


_LIBRARY = Tokenizer.from_file(BYTES)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab'sé漢1. \n\t\x0b\x1c\x85\xa0 <|endoftext|>", max_size=40), max_size=4))
def test_pieces_equal_the_library(texts):
    p = token_files.pieces_of(BYTES)
    ids, sizes = p.encode(pa.array(texts, pa.string()))
    want = [_LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_pieces_forget(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBER", 3)
    p = token_files.Pieces(BYTES)
    for text in ("one two three four", "five  six\nseven", None, "one two <|endoftext|> x", "y" * 5_000):
        ids, _ = p.encode(pa.array([text], pa.string()))
        assert ids.tolist() == _LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_pieces_met_lately_are_kept(monkeypatch):
    """When a worker forgets, what it met since it last did so is not asked of the library again, and gives the same ids."""
    monkeypatch.setattr(token_files, "REMEMBER", 12)
    p, asked = token_files.Pieces(BYTES), []
    own = p.model
    p.model = type("Counted", (), {"tokenize": staticmethod(lambda x: asked.append(x) or own.tokenize(x))})
    new = "walking under trees walking there once more, Straße and déjà"
    for text in ("one two three", new, new, "four five six seven eight nine ten", new, "x", new):
        ids, _ = p.encode(pa.array([text], pa.string()))
        assert ids.tolist() == _LIBRARY.encode(text, add_special_tokens=False).ids
    assert len(asked) == len(set(asked))
    size = sum(map(len, p.known)) + sum(map(len, p.older[0]))
    for i in range(300):
        p.encode(pa.array([f"{'ab' * (i % 7)}{chr(97 + i % 26)} {'cd' * (i % 11)}e"], pa.string()))
        assert sum(map(len, p.known)) + sum(map(len, p.older[0])) < 60 + size


def test_slices_are_bounded(monkeypatch):
    """Rows that are cut into words at once are bounded by their number and their bytes, and no row is left out."""
    monkeypatch.setattr(token_files, "ROWS", 10)
    monkeypatch.setattr(token_files, "BYTES", 1_000)
    for sizes in ([], [0], [5_000], [0] * 95, [30] * 200, [0, None, 4_000, 1, 1, 4_000, 999, None], [rng.randrange(300) for _ in range(500)]):
        got = token_files._slices(pa.array([None if n is None else "x" * n for n in sizes], pa.string()))
        assert [k for i, j in got for k in range(i, j)] == list(range(len(sizes)))
        for i, j in got:
            assert 0 < j - i <= 11 and (j - i == 1 or sum(n or 0 for n in sizes[i + 1 : j]) <= 1_000)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aZßàÿ\u00a1\u00ad\u0100\u024f\xa0\u0301.,!|'#7 \n", max_size=60), max_size=4))
def test_lines_and_marks_equal_the_library(texts):
    """Words are cut before marks and between lines by Arrow; ids stay those of whole texts."""
    ids, sizes = token_files.pieces_of(BYTES).encode(pa.array(texts, pa.string()))
    want = [_LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_letters_need_no_pattern():
    """New words of letters go to the library's model as they are, without its pattern; each once."""
    text = "Walking under déjà trees,\nwalking under walls. Straße"
    p, asked = token_files.Pieces(BYTES), []
    p.encode(pa.array(["x. y,\nz"]))  # marks and ends of lines
    p.library, own = None, p.model
    p.model = type("Counted", (), {"tokenize": staticmethod(lambda x: asked.append(x) or own.tokenize(x))})
    ids, _ = p.encode(pa.array([text, text]))
    assert ids.tolist() == 2 * _LIBRARY.encode(text, add_special_tokens=False).ids
    assert len(asked) == len(set(asked)) == 8  # the first word after a space too


@pytest.mark.parametrize("top", [300, 5_000_000])
def test_frequent_pairs_are_symbols(top):
    """Ids that often follow each other cost one step of the coder; they come back whole, block by block."""
    r = np.random.default_rng(top)
    phrases = [r.integers(0, top, 4) for _ in range(20)]
    ids = np.concatenate([phrases[i] for i in r.integers(0, 20, 4_000)] + [[top - 1] * 501]).astype(np.uint32)
    width, flat, x = token_files.symbols_of(ids)
    starts = np.cumsum(width) - width
    assert [int(v) for k in x for v in flat[starts[k] : starts[k] + width[k]]] == ids.tolist()
    assert len(x) < len(ids) / 3 and width.max() == 4
    s = token_files.Segment.parse(token_files.pack(ids, [1], [len(ids)]))
    assert (s.ids() == ids).all() and np.concatenate([s.ids(slice(i, i + 1)) for i in range(len(s.blocks))]).tolist() == ids.tolist()
    for some in (ids[:0], ids[:1], ids[:2]):
        assert token_files.Segment.parse(token_files.pack(some, [1], [len(some)])).ids().tolist() == some.tolist()


def test_token_files(spark, odd, tmp_path):
    files = token_files.write(odd.repartition(3), BYTES, f"file://{tmp_path}/files", end=7)
    got = token_files.read(token_files.TokenFiles.open(spark, files.folder)).orderBy("start").collect()
    rows = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.id for r in got] == [k for k, _ in rows]
    assert {(r.id, tuple(r.ids)) for r in got} == {(k, (*_LIBRARY.encode(t, add_special_tokens=False).ids, 7)) for k, t in rows}
    start = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4")))
        start += r.n_tokens
    assert token_files.read(token_files.write(odd.limit(0), BYTES), ids=False).count() == 0
    # a damaged file raises instead of giving other ids
    name = next(f for f in os.listdir(tmp_path / "files") if f.endswith(".bin"))
    raw = bytearray((tmp_path / "files" / name).read_bytes())
    raw[-40] ^= 1
    (tmp_path / "files" / name).write_bytes(bytes(raw))
    with pytest.raises(Exception, match="damaged"):
        token_files.read(files).collect()


def test_one_id_over_many_files(spark):
    """An id with most rows is written by several tasks, and its documents still stand together."""
    docs = spark.range(3_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(1_500)).alias("doc_id"), F.concat(F.lit("word "), "id").alias("text")).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = token_files.write(docs, BYTES)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = token_files.read(files, ids=False).orderBy("start").collect()
    ids = [r.id for r in got]
    assert ids == sorted(ids) and len(ids) == 3_000
    assert files.segments.where("docs > 0").select("part").distinct().count() > 2


def test_needs_a_byte_level_file():
    with pytest.raises(ValueError, match="byte-level"):
        token_files.Pieces(public_tokenizers.path("word_bpe_49k.json"))


# --- 12 --------------------------------------------------------------------------------------------------------------


def brute_fim(key: int | None, text: str | None, seed: int = 1) -> tuple:
    text = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, None, text
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    return (len(u), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (len(u), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


def test_fim(spark, odd):
    alphabet = "aZ \n\x01\x02\x0012$\\é漢😀<P>M"
    texts = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for i in range(400)]
    rows = odd.select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id long, text string"))
    got = fim.restore(fim.transform(rows)).collect()
    want = sorted((repr((r.doc_id, *brute_fim(r.doc_id, r.text), r.text or "")) for r in rows.collect()))
    assert sorted(repr((r.id, r.n, r.form, r.prefix, r.middle, r.suffix, r.output, r.restored)) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(odd).count() == odd.count() and fim.transform(odd.limit(0)).count() == 0
    plan = fim.restore(fim.transform(rows))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_fim_parameters(spark):
    docs = spark.createDataFrame([(i, "one two three") for i in range(50)], "doc_id long, text string")
    marks = fim.Sentinels("[pre]", "[suf]", "[mid]")
    got = fim.restore(fim.transform(docs, seed=4, rate=100, spm=100, sentinels=marks), sentinels=marks).collect()
    assert all(r.form == "spm" and r.output.startswith("[suf]") and r.restored == "one two three" for r in got)
    assert all(r.form == "plain" for r in fim.transform(docs, rate=0).collect())
    for bad in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aba", "x", "y"), ("", "x", "y"), ("abc", "b", "y")):
        with pytest.raises(ValueError, match="overlap"):
            fim.Sentinels(*bad)


# --- 13 --------------------------------------------------------------------------------------------------------------


def brute_audit(docs: list, labels: list) -> dict:
    first: dict[str, int] = {}
    for r in docs:
        if r.doc_id is not None:
            first[r.text or ""] = min(first.get(r.text or "", r.doc_id), r.doc_id)
    rows = []
    for r in docs:
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": r.doc_id is not None and r.doc_id > first[t]}
        rows.append((r.lang or "", {k for k, v in fails.items() if v}, any(x.doc_id == r.doc_id is not None and x.quality == 1 for x in labels), any(x.doc_id == r.doc_id is not None and x.toxic == 1 for x in labels)))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        gone: dict[str, int] = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, c in enumerate(order, 1):
                out_now = [r for r in left if c in r[1]]
                left = [r for r in left if c not in r[1]]
                gone[c] += len(out_now)
                out[part, "".join(order), step] = [len(left), len(out_now), sum(c in r[1] for r in own) - len(out_now), sum(r[1] == {c} for r in own), sum(r[2] for r in out_now), sum(r[3] for r in out_now)]
        for (p, o, s), v in out.items():
            if p == part:
                v.append(gone[o[s - 1]])
    return out


def test_audit(spark, odd):
    texts = ["short #", "Short", "plain words here", "w " * 300, " ".join(f"w{i}" for i in range(250)), " ".join(f"W{i}" for i in range(250)), " ".join(f"w{i}|" for i in range(250)), ""]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(120)]
    docs = odd.select("doc_id", "text", "lang", F.lit("x").alias("own"), F.lit("x").alias("mask")).unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"own": F.lit("x"), "mask": F.lit("x")}))
    labels = spark.createDataFrame([(i, rng.randrange(2), rng.choice([0, 1, None])) for i in range(90)] + [(5, 1, 1), (None, 1, 1), (500, 1, 1)], "doc_id long, quality int, toxic int").withColumn("own", F.lit("x"))
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in interactions.audit(docs, labels).collect()}
    assert got == brute_audit(docs.collect(), labels.collect())
    assert len(got) == 600 * len({p for p, _, _ in got})
    assert interactions.audit(docs.limit(0), labels).count() == 0
    none = interactions.audit(docs, labels.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.sum("removed")).first()
    assert none[:2] == (0, 0) and none[2] > 0


def test_matrices():
    m = interactions.matrices("ABCDE")
    assert m.kept.shape == m.removed.shape == (32, 600) and len(m.orders) == 120
    # a document that fails something is removed once in every order, by one filter; Shapley sums say by which how often
    assert (m.removed.reshape(32, 120, 5).sum(axis=2)[1:] == 1).all() and (m.removed[0] == 0).all()
    assert (m.shapley[:, :5].sum(axis=1)[1:] == 120).all()
    assert m.shapley[0b00001, :5].tolist() == [120, 0, 0, 0, 0] and m.shapley[0b00011, :5].tolist() == [60, 60, 0, 0, 0]


def test_audit_parameters(spark):
    two = (interactions.Filter("X", F.col("n_words") < 2), interactions.Filter("R", repeats=True))
    docs = spark.createDataFrame([(1, "a b", "en"), (2, "a b", "en"), (3, "a", "en"), (4, "a", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails) for r in interactions.audit(docs, labels, two).collect()}
    assert got == {("XR", 1): (2, 2, 0, 1), ("XR", 2): (1, 1, 1, 1), ("RX", 1): (2, 2, 0, 1), ("RX", 2): (1, 1, 1, 1)}
    with pytest.raises(ValueError, match="letter"):
        interactions.audit(docs, labels, (two[0], two[0]))
