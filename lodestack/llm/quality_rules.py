"""Quality rules: a threshold table compiled into one projection of built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import all_of, need

#: Frequent function words of four languages.
STOP_WORDS = (
    "the be to of and that have with is in for on it as was by this are at from or an a "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les des en un du une que est pour qui dans par pas au sur avec "
    "el que y los se del las por con no para su al lo como más"
).split()


@dataclass(frozen=True)
class Rule:
    """A bound on a feature; a null feature passes."""

    feature: str
    low: float | None = None
    high: float | None = None


#: The production thresholds. Ratios are over words unless the name says otherwise.
RULES = (
    Rule("n_words", 20, 10_000_000),
    Rule("mean_word_chars", 2, 20),
    Rule("symbol_ratio", None, 0.3),
    Rule("dup_line_ratio", None, 0.5),
    Rule("stop_words", 1, None),
    Rule("repeat_ratio", None, 0.3),
)

SPACE = r"[\x20\x09-\x0D]"


def features(text: Column) -> dict[str, Column]:
    """Counts of one text as column expressions, to be selected in steps (see ``apply_rules``)."""
    return {
        "words": F.filter(F.split(text, SPACE + "+"), lambda w: w != ""),
        "lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")),
    }


def repeated_words(words: Column, hashes: Column, width: int) -> Column:
    """Words covered by windows that occur twice or more; ``hashes`` has one hash per window.

    Only texts with a repeated window sort their windows, so the usual text costs one distinct count.
    """
    at = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(z: Column, j: Column, s: Column) -> Column:
        before, after = F.get(s, j - 1), F.get(s, j + 1)
        return (F.coalesce(before["h"] == z["h"], F.lit(False))) | (F.coalesce(after["h"] == z["h"], F.lit(False)))

    # the sorted windows are bound once by a one-element transform
    places = F.get(F.transform(F.array(at), lambda s: F.array_sort(F.transform(F.filter(s, lambda z, j: again(z, j, s)), lambda z: z["i"]))), F.lit(0))
    covered = F.get(
        F.transform(F.array(places), lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(p, j + 1) - x, F.lit(width)))), F.lit(0), lambda a, b: a + b)),
        F.lit(0),
    )
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered).cast("long")


def measure(docs: DataFrame, id_col: str, text_col: str, width: int = 8) -> DataFrame:
    """One row per input row with the counts that rules read. Null text counts as empty."""
    need(docs, id_col, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), *[c.alias(k) for k, c in features(text).items()])
    n = F.size("words")
    windows = F.when(n >= width, F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(F.slice(F.col("words"), i, F.lit(width))))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(
        "id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_intersect("words", F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)]))).cast("long").alias("stop_words"),
        F.col("words"),
        windows.alias("windows"),
    )
    return rows.select(*[c for c in rows.columns if c not in ("words", "windows")], repeated_words(F.col("words"), F.col("windows"), width).alias("n_repeat_words"))


RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "word_chars"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
}


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The conjunction of all rules over the columns of ``measure``."""

    def feature(name: str) -> Column:
        return F.try_divide(*(F.col(c).cast("double") for c in RATIOS[name])) if name in RATIOS else F.col(name)

    parts = [feature(r.feature) >= r.low for r in rules if r.low is not None] + [feature(r.feature) <= r.high for r in rules if r.high is not None]
    return all_of([F.coalesce(p, F.lit(True)) for p in parts])


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures and verdict of every row, in one projection without a shuffle or user function.

    Null and empty texts have no words and fail; ids may repeat or be null; other columns are not read.
    """
    rows = measure(docs, id_col, text_col)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    rows = apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stop_words", "n_lines")


def _oracle() -> str:
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return f"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, text,
         list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM t
), win AS (
  SELECT r, i, hash(list_slice(words, i, i + 7)) AS h FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS k FROM win) WHERE k > 1
), cover AS (
  SELECT r, CAST(sum(least(8, coalesce(nxt - i, 8))) AS BIGINT) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM rep) GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words,
         CAST(len(list_intersect(list_distinct(words), [{stops}])) AS BIGINT) AS stop_words, CAST(len(lines) AS BIGINT) AS n_lines
  FROM w LEFT JOIN cover USING (r)
), b AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m
)
SELECT *, NOT base_failed AND n_words <= 10000000 AND word_chars >= 2 * n_words AND word_chars <= 20 * n_words
  AND n_symbols <= 0.3 * word_chars AND 2 * n_dup_lines <= n_lines AND stop_words >= 1 AS kept
FROM b"""


ORACLE = _oracle()
