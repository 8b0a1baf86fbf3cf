"""Lookups of names and ids in dimension tables, and table mutations as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import ratio
from ..functions.text import present, strip, year_of
from .ranking import global_rank
from .substrings import containing


def with_name(rows: DataFrame, dim: DataFrame, fk: str, key: str, name: str, out: str) -> DataFrame:
    """``rows`` with the dimension's name, null if unknown. Spark broadcasts a dimension under its threshold."""
    own = "key"
    while own in rows.columns:
        own += "_"
    d = dim.select(F.col(key).alias(own), F.col(name).alias(out))
    return rows.join(d, rows[fk] == d[own], "left").drop(own)


def tag_names(rows: DataFrame, key: str, tags: str, dim: DataFrame, tag_key: str, tag_name: str) -> DataFrame:
    """(key, names): names of an array of ids in its order; unknown ids are dropped."""
    each = rows.select(key, F.posexplode(tags).alias("_p", "_t"))
    named = each.join(dim.select(F.col(tag_key).alias("_t"), F.col(tag_name).alias("_n")), "_t")
    got = named.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_n"))), lambda x: x["_n"]).alias("names"))
    return rows.select(key).join(got, key, "left").select(key, F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def search_metadata(docs: DataFrame, dims: dict[str, tuple[DataFrame, str, str, str]]) -> DataFrame:
    """Documents with all names looked up and the year of their date; ``dims`` maps an output to (table, fk, key, name)."""
    for out, (dim, fk, key, name) in dims.items():
        docs = with_name(docs, dim, fk, key, name, out)
    return docs.withColumn("year", year_of("date"))


def find_or_create(names: DataFrame, dim: DataFrame, least: float = 0.80, candidates: int = 100) -> DataFrame:
    """(name, id, created): id of the best match of each distinct stripped name in dim (id, name), else a new id.

    An exact match in any case wins; else, of the ``candidates`` smallest ids whose name contains the name in any case, the most similar of at
    least ``least``. Names without a match get ids after the largest, in order. Names meet the dimension by their rarest
    run of characters (``substrings.containing``), and only pairs whose lengths allow the similarity are compared.
    """
    asked = names.select(strip("name").alias("name")).where(F.col("name") != "").distinct().withColumn("l", F.lower("name"))
    have = dim.select(F.col("id").alias("id"), F.col("name").alias("dim_name"), F.lower("name").alias("dim_l"))
    exact = asked.join(have, asked["l"] == have["dim_l"]).groupBy("name").agg(F.min("id").alias("id"))
    rest = asked.join(exact, "name", "left_anti")
    near = containing(rest, have, "l", "dim_l")
    w = Window.partitionBy("name").orderBy("id")
    near = near.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= candidates)
    # no more characters match than the shorter text has
    bound = 2 * F.least(F.length("l"), F.length("dim_l")) / (F.length("l") + F.length("dim_l"))
    near = near.where(bound >= least - 1e-9).withColumn("r", ratio("l", "dim_l")).where(F.col("r") >= least)
    best = near.groupBy("name").agg(F.max(F.struct("r", (-F.col("id")).alias("neg"))).alias("b")).select("name", (-F.col("b.neg")).alias("id"))
    found = exact.unionByName(best).withColumn("created", F.lit(False))
    top = dim.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = global_rank(asked.join(found, "name", "left_anti").select("name"), [F.col("name")], "n")
    return found.unionByName(fresh.select("name", (F.col("n") + top).alias("id"), F.lit(True).alias("created")))


def insert_missing(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with rows whose key it lacks: idempotent create-if-missing."""
    return table.unionByName(rows.dropDuplicates([key]).join(table, key, "left_anti"), allowMissingColumns=True)


def patch(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with nonnull values of ``changes`` (one row per key) in place of its own."""
    new = [c for c in changes.columns if c != key]
    c = changes.select(key, *[F.col(x).alias(f"_new_{x}") for x in new])
    got = table.join(c, key, "left")
    return got.select(*[F.coalesce(f"_new_{x}", x).alias(x) if x in new else F.col(x) for x in table.columns])


def without(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The table without some keys; absent ones don't matter."""
    return table.join(keys.select(key), key, "left_anti")


def available_names(dims: dict[str, DataFrame], spark) -> DataFrame:
    """One row with the sorted labels of each dimension; duplicates stay."""
    parts = [d.agg(F.array_sort(F.collect_list(present(strip("name")))).alias(k)) for k, d in dims.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, F.lit(True))
    return out


