"""String similarity as Arrow-batched functions: the standard library's matching-block ratio has no SQL form."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import col, token_sort


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of two texts, in this order; null if either is null."""
    seen: dict[tuple, float | None] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair not in seen:
            seen[pair] = None if None in pair else SequenceMatcher(None, *pair).ratio()
        out.append(seen[pair])
    return pd.Series(out, dtype="float64")


def ratio_bound(a: Column | str, b: Column | str) -> Column:
    """An upper bound of ``ratio`` in built-in functions, for filters in front of it.

    Matched characters are at most those that both texts have, each counted as often as the text has it that has it less.
    """
    a, b = col(a), col(b)
    times = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    chars = F.array_distinct(F.regexp_extract_all(a, F.lit("(?s)(.)"), F.lit(1)))
    shared = F.aggregate(chars, F.lit(0), lambda n, c: n + F.least(times(a, c), times(b, c)))
    both = F.length(a) + F.length(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * shared / both)


def length_bound(a: Column | str, b: Column | str) -> Column:
    """As ``ratio_bound``, by the lengths alone: weaker and cheaper."""
    a, b = F.length(col(a)), F.length(col(b))
    return F.when(a + b == 0, F.lit(1.0)).otherwise(2.0 * F.least(a, b) / (a + b))


def token_sort_ratio(a: Column, b: Column) -> Column:
    return ratio(token_sort(a), token_sort(b))


def register(spark: SparkSession) -> None:
    """Make ``similarity_ratio`` callable from SQL."""
    spark.udf.register("similarity_ratio", ratio)
