"""Which names of a dimension contain a text: a join over runs of three characters in place of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

#: Bytes of rows that are broadcast to meet the runs; more are joined by a shuffle of both sides.
BROADCAST_BYTES = 8 << 20
#: Characters of a run. Texts of fewer characters are looked up whole.
RUN = 3


def runs(text: Column, n: int = RUN) -> Column:
    """The distinct runs of ``n`` characters of a text, none if it is shorter or null."""
    c = F.split(text, "")
    each = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.array_join(F.slice(c, i, n), ""))
    return F.when(F.length(text) >= n, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def asked_runs(text: Column) -> Column:
    """Runs that every text containing this one has too: its runs of RUN characters, or itself if it is shorter."""
    return F.when(F.length(text) >= RUN, runs(text)).when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))


def held_runs(text: Column) -> Column:
    """All runs that may be asked of a text: those of one to RUN characters."""
    return F.array_distinct(F.flatten(F.array(*[runs(text, n) for n in range(1, RUN + 1)])))


def containing(names: DataFrame, dim: DataFrame, text: str, within: str) -> DataFrame:
    """Pairs of rows of ``names`` and of ``dim`` where the text of the second, ``within``, contains that of the first.

    A text is looked up by the one of its runs that the fewest rows of ``dim`` have, and every pair is verified, so all pairs come out and no other. A text
    with a run that no row has leaves after a count. Null and empty texts contain nothing and are contained in nothing; repeated rows give repeated pairs.
    The two tables must not share names of columns, nor have one that begins with ``_run``. The runs of ``dim`` are many times its size, which Spark's
    estimate for an explode doesn't tell, so they are counted and met where they are made; neither they nor the pairs are ever broadcast.
    """
    held = dim.select("*", F.explode(held_runs(F.col(within))).alias("_run"))
    asked = names.select(F.col(text).alias("_run_text")).distinct().select("_run_text", F.explode(asked_runs(F.col("_run_text"))).alias("_run"))
    wanted = asked.select("_run").distinct()
    sizes = held.groupBy("_run").agg(F.count("*").alias("_run_size")).join(wanted, "_run", "left_semi")
    sized = asked.join(sizes, "_run", "left").withColumn("_run_size", F.coalesce("_run_size", F.lit(0)))
    rarest = sized.groupBy("_run_text").agg(F.min(F.struct("_run_size", "_run")).alias("_run_least")).where("_run_least._run_size > 0")
    rarest = rarest.select("_run_text", F.col("_run_least._run").alias("_run"))
    looked = materialize(names.join(rarest, names[text] == rarest["_run_text"]).drop("_run_text"), "looked")
    size = looked.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]
    met = looked.hint("broadcast" if size <= BROADCAST_BYTES else "merge").join(held, "_run")
    return met.where(F.contains(F.col(within), F.col(text))).drop("_run")
