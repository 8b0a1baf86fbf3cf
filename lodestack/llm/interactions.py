"""How filters overlap: what every order of them keeps, removes and finds removed already, from one table of failure masks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import materialize, need, small

SPACE = r"[\x20\x09-\x0D]+"
#: Rows without an id meet no label; they are dealt over so many keys of their own.
SPREAD = 1_024


@dataclass(frozen=True)
class Filter:
    """A letter and the condition under which a text fails; ``repeats`` marks the one filter that fails later copies of a text."""

    letter: str
    fails: Column | None = None
    repeats: bool = False


def production() -> tuple[Filter, ...]:
    """The five filters, over the columns of ``measure``."""
    words, distinct = F.col("n_words"), F.col("n_distinct")
    return (
        Filter("A", words < 200),
        Filter("B", 100 * distinct < 50 * words),
        Filter("C", 100 * F.col("n_capitals") > 3 * F.col("n_points")),
        Filter("D", F.col("symbols")),
        Filter("E", repeats=True),
    )


def measure(text: Column) -> dict[str, Column]:
    """What filters may ask of a text, by built-in expressions."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    return {
        "n_words": F.size(words),
        "n_distinct": F.size(F.array_distinct(words)),
        "n_capitals": F.length(F.regexp_replace(text, "[^A-Z]+", "")),
        "n_points": F.length(text),
        "symbols": F.rlike(text, F.lit("[#$%&*|]")),
    }


# --- matrices ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Matrices:
    """Integer matrices of 2**k masks by k! * k steps: what a document of a mask counts as at a step of an order."""

    orders: list[str]
    kept: np.ndarray
    removed: np.ndarray
    redundant: np.ndarray
    unique: np.ndarray
    shapley: np.ndarray


def matrices(letters: str) -> Matrices:
    """Bit i of a mask says that a text fails the filter of letter i. Columns run through the orders, and through the steps of each."""
    k = len(letters)
    orders = ["".join(p) for p in permutations(letters)]
    masks = np.arange(1 << k)[:, None]
    at = np.array([[letters.index(c) for c in o] for o in orders])
    own = (1 << at).ravel()[None, :]
    upto = np.cumsum(1 << at, axis=1).ravel()[None, :]  # filters up to the step, as a mask
    fails, before = (masks & own) > 0, (masks & (upto - own)) > 0
    removed = (fails & ~before).astype(np.int64)
    by_filter = np.stack([removed[:, (own == 1 << i)[0]].sum(axis=1) for i in range(k)], axis=1)
    return Matrices(orders, ((masks & upto) == 0).astype(np.int64), removed, (fails & before).astype(np.int64), (masks == own).astype(np.int64), by_filter[:, at.ravel()])


OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def multiply(histograms: DataFrame, letters: str) -> DataFrame:
    """Rows (part, mask, n, good, toxic) stacked into vectors per part and multiplied by the matrices: a row per part, order and step."""
    whole = histograms.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("h"))  # 2**k entries a part at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matrices(letters)
        steps = len(m.orders) * len(letters)
        order = pa.array([o for o in m.orders for _ in letters])
        step = pa.array(np.tile(np.arange(1, len(letters) + 1, dtype=np.int32), len(m.orders)))
        for b in batches:
            for part, entries in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = np.zeros((3, 1 << len(letters)), np.int64)
                for e in entries:
                    rows[:, e["mask"]] += (e["n"], e["good"], e["toxic"])
                lost = rows @ m.removed
                counts = [rows[0] @ m.kept, lost[0], rows[0] @ m.redundant, rows[0] @ m.unique, lost[1], lost[2], rows[0] @ m.shapley]
                yield pa.RecordBatch.from_arrays([pa.array([part] * steps, pa.string()), order, step, *map(pa.array, counts)], [c.split()[0] for c in OUT.split(", ")])

    return whole.mapInArrow(run, OUT)


# --- histograms ----------------------------------------------------------------------------------------------------------


def masks(docs: DataFrame, labels: DataFrame, filters: tuple[Filter, ...], id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail just the filters of a mask, and how many of them are labelled.

    Only a digest, a mask and labels of a text are shuffled. Rows meet the labels by id; equal rows are counted there, and then
    summed by text before the first id of a text is looked for, so a text with a third of all rows, or an id with as many, is reduced where it is read.
    """
    content = [(i, f) for i, f in enumerate(filters) if not f.repeats]
    repeats = sum(1 << i for i, f in enumerate(filters) if f.repeats)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    known = measure(F.col("text"))
    rows = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[c.alias(k) for k, c in known.items()])
    mask = F.lit(0)
    for i, f in content:
        mask = mask + F.when(f.fails, F.lit(1 << i)).otherwise(F.lit(0))
    own = F.when(F.col("id").isNull(), 1 + F.monotonically_increasing_id() % SPREAD).otherwise(F.lit(0))
    rows = rows.select("id", own.alias("own"), "part", "digest", mask.alias("mask"))
    # repeated rows are counted before they move
    rows = rows.groupBy("id", "own", "part", "digest", "mask").agg(F.count("*").alias("n"))
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), F.lit(0).cast("long").alias("own"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    marks = marks.where("id IS NOT NULL").groupBy("id", "own").agg(*[F.coalesce(F.max(c), F.lit(False)).alias(c) for c in ("good", "toxic")])
    # written as a table, so that a hot id is split where the labels are too many to broadcast
    rows = rows.join(small(materialize(marks, "marks")), ["id", "own"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    # by text, part and labels: all, those of the smallest id, and those without an id, which no copy is before
    group = ["digest", "part", "mask", "good", "toxic"]
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    by_text = rows.groupBy(*group).agg(F.sum("n").alias("n"), first.alias("first"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    # a text now has a row per part and labels, so the least id over them and the join by text move few rows
    least = by_text.groupBy("digest").agg(F.min("first.id").alias("least"))
    by_text = by_text.join(least, "digest")
    stay = F.col("unnamed") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0))
    split = F.array(F.struct(F.col("mask").alias("mask"), stay.alias("n")), F.struct((F.col("mask") + repeats).alias("mask"), (F.col("n") - stay).alias("n")))
    each = by_text.select("part", "good", "toxic", F.inline(split))
    count = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(F.lit(0))).alias(c)
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good"), count("toxic"))


def audit(docs: DataFrame, labels: DataFrame, filters: tuple[Filter, ...] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """What every order of the filters does to each part at every step, zeros included.

    Null parts are the empty part, null texts empty texts. A text is a repeat if a smaller id has it anywhere in the table, whatever removes that one; rows
    of one id and text are no repeats of each other, and rows without an id are never repeats nor labelled. An id labelled more than
    once counts as good, or toxic, if any of its rows says so. No documents give no rows. Other columns are not read.
    """
    filters = filters or production()
    need(docs, id_col, text_col, part_col)
    need(labels, "doc_id", "quality", "toxic")
    letters = "".join(f.letter for f in filters)
    if len(set(letters)) != len(filters) or len(letters) > 6 or sum(f.repeats for f in filters) > 1:
        raise ValueError("filters need one letter each, six at most, and one may look for repeats")
    return multiply(masks(docs, labels, filters, id_col, text_col, part_col), letters)


def op13_interactions(spark, sf_dir: str) -> DataFrame:
    """``audit`` of all documents by language; nulls, ties, repeated rows and empty tables as there."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
         {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words), 'C': 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text),
          'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(w.doc_id > first, false)} AS f
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), v AS (
  SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, f
), x AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT o, unnest(range(1, 6)) AS step FROM o
), t AS (
  SELECT part, o, step, o[step] AS letter, n, good, toxic, struct_extract(f, 'A') AS fa, list_filter(['A', 'B', 'C', 'D', 'E'], lambda c: CASE c WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END) AS failed FROM v, s
), u AS (
  SELECT *, list_contains(failed, letter) AS fails, len(list_intersect(failed, list_slice(o, 1, step - 1))) > 0 AS earlier FROM t
), r AS (
  SELECT part, array_to_string(o, '') AS filter_order, step, any_value(letter) AS letter,
         sum(CASE WHEN NOT fails AND NOT earlier THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT earlier THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN fails AND earlier THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails AND len(failed) = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN fails AND NOT earlier THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost
  FROM u GROUP BY part, o, step
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM r"""
