"""Field-level scores of extracted metadata, their aggregates, and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .similarity import token_sort_ratio
from .text import eval_name, iso_date, strip, tokens


def _nulls(a: Column, b: Column, both: Column, one: Column, neither: Column) -> Column:
    return F.when(a.isNull() & b.isNull(), both).when(a.isNull() | b.isNull(), one).otherwise(neither)


def score_sender(expected: Column, actual: Column, fuzzy: bool = True) -> dict[str, Column]:
    """Both null is right, one null is wrong; otherwise equality, and similarity, of normalised names."""
    a, b = eval_name(expected), eval_name(actual)
    yes, no = F.lit(True), F.lit(False)
    out = {"corr_exact_match": _nulls(expected, actual, yes, no, a == b)}
    if fuzzy:
        out["corr_fuzzy_score"] = _nulls(expected, actual, F.lit(1.0), F.lit(0.0), token_sort_ratio(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    return out | {"corr_expected_null": expected.isNull(), "corr_predicted_null": actual.isNull()}


def score_date(expected: Column, actual: Column) -> dict[str, Column]:
    """Exact match, distance in days, credit falling to nothing over a year, and whether nulls agree.

    A text that isn't a strict ISO day scores nothing and has no distance.
    """
    a, b = iso_date(expected), iso_date(actual)
    bad = a.isNull() | b.isNull()
    days = F.abs(F.datediff(a, b))
    nothing = F.lit(None)
    return {
        "date_exact_match": _nulls(expected, actual, F.lit(True), F.lit(False), F.when(bad, False).otherwise(days == 0)),
        "date_distance_days": _nulls(expected, actual, F.lit(0), nothing, days).cast("long"),
        "date_partial_credit": _nulls(expected, actual, F.lit(1.0), F.lit(0.0), F.when(bad, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - days / 365.0))),
        "date_null_correct": _nulls(expected, actual, F.lit(True), F.lit(False), nothing.cast("boolean")),
    }


def score_title(contains: Column, actual: Column) -> dict[str, Column]:
    """Whether an expected part occurs, in any case, and the Jaccard similarity of the words; null without expectation, and an empty one is none."""
    a, b = (F.array_distinct(tokens(F.lower(F.coalesce(c, F.lit(""))))) for c in (contains, actual))
    union = F.size(F.array_union(a, b))
    some = contains.isNotNull() & (contains != "")
    return {
        "title_contains_match": F.when(some, F.contains(F.lower(F.coalesce(actual, F.lit(""))), F.lower(contains))),
        "title_keyword_overlap": F.when(some, F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)),
    }


def loose(c: Column) -> Column:
    return F.coalesce(strip(F.lower(c)), F.lit(""))


def aggregate_scores(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Experiment aggregates that skip nulls; precision and recall of nulls are null without a denominator. Without rows and groups, none."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    both = F.count_if(yes("corr_expected_null") & yes("corr_predicted_null")).cast("double")
    out = rows.groupBy(*by).agg(
        share("corr_exact_match").alias("correspondent_exact_accuracy"),
        F.avg("corr_fuzzy_score").alias("correspondent_fuzzy_mean"),
        F.try_divide(both, F.count_if(yes("corr_predicted_null")).cast("double")).alias("null_precision"),
        F.try_divide(both, F.count_if(yes("corr_expected_null")).cast("double")).alias("null_recall"),
        share("date_exact_match").alias("date_exact_accuracy"),
        F.avg("date_partial_credit").alias("date_partial_mean"),
        share("title_contains_match").alias("title_contains_rate"),
        F.count("*").alias("n"),
    )
    return out.where("n > 0")


def majority(votes: DataFrame, key: str, vote: str, valid: tuple[str, ...] | None = None) -> DataFrame:
    """(key, verdict, n_votes): the label with a strict majority over every other, ``tie`` else; keys without a valid vote are left out."""
    rows = votes.where(F.col(vote).isNotNull())
    rows = rows.where(F.col(vote).isin(*valid)) if valid else rows
    counts = rows.groupBy(key, vote).count()
    best = F.max(F.struct(F.col("count"), F.col(vote).alias("label")))
    per = counts.groupBy(key).agg(best.alias("best"), F.sum("count").alias("n_votes"), F.sort_array(F.collect_list("count"), asc=False).alias("counts"))
    tie = F.coalesce(F.get("counts", F.lit(1)) == F.get("counts", F.lit(0)), F.lit(False))
    return per.select(key, F.when(tie, "tie").otherwise(F.col("best.label")).alias("verdict"), "n_votes")


def jury_score(verdict: Column, positive: str = "appropriate") -> Column:
    return F.when(verdict == positive, 1.0).otherwise(0.0)
