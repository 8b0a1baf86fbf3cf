"""Evaluation runs: an agent's output for golden entries, scored by registered evaluators, experiment by experiment."""

from __future__ import annotations

import importlib
import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..sources.tables import Settings
from ..storage import materialize
from .models import FIELDS, Extractor, extract_with

log = logging.getLogger(__name__)

Agent = Callable[[Settings], Extractor]

#: Evaluators by name: expected and predicted columns to a score from 0 to 1.
EVALUATORS: dict[str, Callable[[dict[str, Column], dict[str, Column]], Column]] = {
    "correspondent_exact": lambda e, p: S.score_sender(e["correspondent"], p["correspondent"], False)["corr_exact_match"].cast("double"),
    "correspondent_fuzzy": lambda e, p: S.score_sender(e["correspondent"], p["correspondent"])["corr_fuzzy_score"],
    "date_exact": lambda e, p: (S.loose(e["date"]) == S.loose(p["date"])).cast("double"),
}


def load_agent(path: str) -> Agent:
    """The object that a dotted path names."""
    module, _, name = path.rpartition(".")
    return getattr(importlib.import_module(module), name)


def predict(entries: DataFrame, agent: Agent, settings: Settings) -> DataFrame:
    """Entries (file_path, text, and expectations) with an agent's fields; a failing example has null fields."""

    @F.pandas_udf(", ".join(f"{f} string" for f in FIELDS))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        extractor = agent(settings)
        for t in texts:
            out = []
            for x in t:
                try:
                    out.append(extract_with(extractor, x or ""))
                except Exception:  # whatever a model raises: the example scores as empty
                    out.append(dict.fromkeys(FIELDS))
            yield pd.DataFrame(out, columns=list(FIELDS))

    return entries.withColumn("p", run("text")).select(*entries.columns, *[F.col(f"p.{f}").alias(f"predicted_{f}") for f in FIELDS])


def score(rows: DataFrame) -> DataFrame:
    """All field scores of predicted entries, one row each."""
    e, p = F.col, lambda f: F.col(f"predicted_{f}")
    parts = S.score_sender(e("expected_correspondent"), p("correspondent")) | S.score_date(e("expected_date"), p("date")) | S.score_title(e("expected_title_contains"), p("title"))
    expected = {"correspondent": e("expected_correspondent"), "date": e("expected_date")}
    more = {k: f(expected, {x: p(x) for x in FIELDS}) for k, f in EVALUATORS.items()}
    return rows.select("file_path", *[c.alias(k) for k, c in (parts | more).items()])


def run_experiments(spark: SparkSession, entries: DataFrame, experiments: list[tuple[str, dict]], agent: Agent, base: Settings, sink: str | None = None) -> DataFrame:
    """(experiment, aggregates) over named settings; one that fails is logged and left out. Row scores go to ``sink`` if given."""
    out: list[DataFrame] = []
    for name, values in experiments:
        try:
            rows = score(predict(entries, agent, base.overlay(values))).withColumn("experiment", F.lit(name))
            if sink:
                rows = materialize(rows, "scores")  # agents run once
                rows.write.mode("append").parquet(sink)
            out.append(spark.createDataFrame(S.aggregate_scores(rows, ("experiment",)).collect(), _schema()))
        except Exception:
            log.exception("experiment %s failed", name)
    got = spark.createDataFrame([], _schema())
    for x in out:
        got = got.unionByName(x)
    return got


def _schema() -> str:
    numbers = ("correspondent_exact_accuracy", "correspondent_fuzzy_mean", "null_precision", "null_recall", "date_exact_accuracy", "date_partial_mean", "title_contains_rate")
    return "experiment string, " + ", ".join(f"{c} double" for c in numbers) + ", n long"


def jury(titles: DataFrame, judges: list[Callable[[str, str], str]]) -> DataFrame:
    """(file_path, score): 1 if a strict majority of valid votes finds a title appropriate; missing titles and no votes are 0.

    Judges read at most 3,000 characters of the transcript; a judge that fails has no vote.
    """

    @F.pandas_udf("array<string>")
    def votes(title: pd.Series, text: pd.Series) -> pd.Series:
        def ask(j: Callable[[str, str], str], t: str, x: str) -> str | None:
            try:
                return j(t, (x or "")[:3000])
            except Exception:  # a failed judge abstains
                return None

        return pd.Series([[ask(j, t, x) for j in judges] if t else [] for t, x in zip(title, text, strict=True)])

    each = titles.select("file_path", F.explode(votes("title", "text")).alias("vote"))
    got = S.majority(each, "file_path", "vote", ("appropriate", "inappropriate"))
    return titles.select("file_path").join(got, "file_path", "left").select("file_path", S.jury_score(F.coalesce("verdict", F.lit("none"))).alias("score"))
