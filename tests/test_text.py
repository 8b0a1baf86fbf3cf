"""Text functions against worked values."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.functions import scores as S
from lodestack.functions import text as T
from lodestack.functions.similarity import ratio, register, token_sort_ratio
from lodestack.operators.chunks import chunk_text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("ACME Corp.", "acme"), ("U.S.A. Inc", "usa"), ("Smith & Sons", "smith and sons"), ("Universität-Köln GmbH", "universität köln"), ("O'Neil/Co", "oneil"), ("  ", ""), ("Inc.", "")],
)
def test_sender_name(spark, raw, want):
    assert one(spark, T.sender_name(F.lit(raw))) == want


def test_eval_name_keeps_corporation(spark):
    assert one(spark, T.eval_name(F.lit("ACME Corporation PLC"))) == "acme corporation plc"


@pytest.mark.parametrize(("name", "person"), [("john smith", True), ("smith holdings", False), ("acme", False), ("j smith", False), ("a1 bc", False), ("ann b. lee".replace(".", ""), False)])
def test_person_shape(spark, name, person):
    assert one(spark, T.person_shape(F.split(F.lit(name), " "))) is person


def test_shape_conflict_and_keys(spark):
    words = lambda s: F.split(F.lit(s), " ")
    assert one(spark, T.shape_conflict(words("john smith"), words("smith holdings"))) is True
    assert one(spark, T.shape_conflict(words("acme bank"), words("acme insurance"))) is False
    assert set(one(spark, T.blocking_keys(F.lit("acme bank ag"), words("acme bank ag")))) == {"token_sort:acme ag bank", "first:acme", "prefix:acme bank ag", "token:acme", "token:bank"}
    assert one(spark, T.blocking_keys(F.lit(""), F.array().cast("array<string>"))) == ["token_sort:"]


def test_snippet(spark):
    assert one(spark, T.snippet(F.lit(" a\n b\t c "))) == "a b c"
    got = one(spark, T.snippet(F.lit("word " * 100)))
    assert got.endswith("...") and len(got) <= 280
    assert one(spark, T.snippet(F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize(("raw", "want"), [(None, None), ("", None), ("2024-01-02", "2024"), ("2024-01-02T10:00:00", "2024"), ("1999 or so", "1999"), ("abc", None)])
def test_year(spark, raw, want):
    assert one(spark, T.year_of(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(
    ("total", "threshold", "first", "last", "want"),
    [(41, 40, 20, 20, [*range(20), *range(21, 41)]), (11, 10, 4, 1, [0, 1, 2, 3, 10]), (10, 5, 0, 0, []), (3, 40, 20, 20, [0, 1, 2]), (0, 40, 20, 20, []), (12, 10, 8, 8, list(range(12)))],
)
def test_pages(spark, total, threshold, first, last, want):
    assert one(spark, T.page_selection(F.lit(total), threshold, first, last)) == want


def test_webhook(spark):
    n = F.lit(None).cast("string")
    assert one(spark, T.webhook_doc_id(F.lit("http://x/documents/42/details"), n, n, n)) == 42
    assert one(spark, T.webhook_doc_id(F.lit(""), F.lit("/documents/7"), n, n)) == 7
    assert one(spark, T.webhook_doc_id(n, n, F.lit("x"), F.lit("9"))) == 9
    assert one(spark, T.webhook_doc_id(n, F.lit("/documents/7x"), n, n)) is None
    assert sorted(one(spark, T.event_tags(F.lit(" a, b,,a"), F.lit(True), F.lit("c")))) == ["a", "b"]
    assert one(spark, T.event_tags(F.lit(""), F.lit(True), F.lit("c"))) == []
    assert one(spark, T.event_tags(n, F.lit(False), F.lit("c"))) == ["c"]
    assert one(spark, T.route(F.array(F.lit("embed"), F.lit("ocr")))) == "ocr"


def test_tags_fields_thinking(spark):
    ints = lambda *x: F.array(*[F.lit(i) for i in x])
    assert one(spark, T.move_tag(ints(1, 5), F.lit(1), F.lit(2))) == [5, 2]
    assert one(spark, T.move_tag(ints(1, 2), F.lit(1), F.lit(2))) == [2]
    assert one(spark, T.without_thinking(F.lit("<THINK>a\nb</think> c "))) == "c"
    assert one(spark, T.without_thinking(F.lit(" <think>a</think>"), F.lit("r"))) == " <think>a</think>"
    assert one(spark, T.is_ai_note(F.lit('{"OCR_MODEL": null}'))) is True
    assert one(spark, T.is_ai_note(F.lit("ocr_model"))) is False
    assert one(spark, T.plausible_date(F.lit("1899-12-31"), F.lit("2024-01-01").cast("date"))) is None
    assert one(spark, T.iso_date(F.lit("2024-1-2"))) is None
    assert one(spark, T.render_dpi(F.lit(8.5), F.lit(11.0), F.lit(1650))) == 150
    assert [one(spark, T.backoff(F.lit(i))) for i in (1, 2, 7)] == [60, 120, 3600]


def test_ratio(spark):
    assert one(spark, ratio(F.lit("abcd"), F.lit("bcde"))) == pytest.approx(0.75)
    assert one(spark, ratio(F.lit(None).cast("string"), F.lit("x"))) is None
    assert one(spark, token_sort_ratio(F.lit("b a"), F.lit("a b"))) == 1.0
    register(spark)
    assert spark.sql("SELECT similarity_ratio('ab', 'ab')").first()[0] == 1.0


def test_scores(spark):
    s = lambda d, k: one(spark, d[k])
    t = lambda x: F.lit(x).cast("string")
    assert s(S.score_sender(t("U.S.A."), t("USA")), "corr_exact_match") is True
    assert s(S.score_sender(t(None), t(None)), "corr_fuzzy_score") == 1.0
    assert s(S.score_sender(t("x"), t(None)), "corr_exact_match") is False
    d = S.score_date(t("1983-01-13"), t("1984-01-13"))
    assert (s(d, "date_distance_days"), s(d, "date_partial_credit"), s(d, "date_null_correct")) == (365, 0.0, None)
    d = S.score_date(t("bad"), t("1984-01-13"))
    assert (s(d, "date_exact_match"), s(d, "date_distance_days"), s(d, "date_partial_credit")) == (False, None, 0.0)
    assert s(S.score_title(t(None), t("x")), "title_contains_match") is None
    assert s(S.score_title(t(""), t("x")), "title_contains_match") is None and s(S.score_title(t(""), t("x")), "title_keyword_overlap") is None
    none = S.score_date(F.lit(None).cast("string"), F.lit(None).cast("string"))
    assert (s(none, "date_exact_match"), s(none, "date_distance_days"), s(none, "date_partial_credit")) == (True, 0, 1.0)
    assert s(S.score_title(t("invoice"), t("An Invoice")), "title_keyword_overlap") == 0.5


def test_aggregate_and_majority(spark):
    rows = spark.createDataFrame([(True, 1.0, True, True, True, 1.0, True), (False, 0.8, None, True, False, 0.5, None), (True, 0.9, True, False, None, None, False)], "corr_exact_match boolean, corr_fuzzy_score double, corr_expected_null boolean, corr_predicted_null boolean, date_exact_match boolean, date_partial_credit double, title_contains_match boolean")
    got = S.aggregate_scores(rows).first()
    assert got["correspondent_exact_accuracy"] == pytest.approx(2 / 3) and got["null_precision"] == 0.5 and got["null_recall"] == 0.5 and got["title_contains_rate"] == 0.5
    assert S.aggregate_scores(rows.limit(0)).count() == 0
    votes = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "zz")], "k int, v string")
    assert {r["k"]: r["verdict"] for r in S.majority(votes, "k", "v", ("a", "b")).collect()} == {1: "a", 2: "tie"}


def test_bounded_context(spark):
    text = "A" * 3000 + "B" * 3000 + "C" * 3000 + "D" * 3000 + "E" * 3000
    got = one(spark, T.bounded_context(F.lit(text), 1000, 200, 200, 3))
    assert len(got) <= 1020 and got.startswith("A" * 200) and got.endswith("E" * 200) and got.count("\n...\n") == 4
    assert one(spark, T.bounded_context(F.lit("short"))) == "short"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400), st.integers(1, 60), st.integers(0, 80))
def test_chunker_properties(text, size, overlap):
    chunks = chunk_text(text, size, overlap)
    assert all(c and len(c) <= size for c in chunks)
    assert bool(chunks) == bool(text.strip())
    assert set("".join(chunks)) - set(" \n") == set(text) - set(" \n")


def test_chunker():
    assert chunk_text("") == [] and chunk_text("short") == ["short"]
    got = chunk_text("a" * 200, 32, 100)
    assert len(got) > 1 and max(map(len, got)) <= 32
    assert chunk_text("aa bb cc dd", 5, 2) == ["aa bb", "cc", "dd"] and chunk_text("aa bb cc dd", 6, 3) == ["aa bb", "bb cc", "cc dd"]
