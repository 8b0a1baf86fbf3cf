"""Pairs of sender names that may merge or need a review, by an exact set-similarity join instead of all pairs of a block.

Why it finds all of them: whatever ``entities.decide`` merges or sends to review has equal names, or shares at least REVIEW[1] of the tokens of
the name that has more. Equal names have equal features, so one of them, the one with the smallest id, stands for all.
Of two different names that share ``s`` of the tokens, ``s >= t * max(|x|, |y|)``, both have one of the shared tokens among their rarest
``|x| - ceil(t |x|) + 1``: without it at most ``ceil(t |x|) - 1`` are left to share. So names meet by their rare tokens only, and a token that all
names have is left out as soon as a name has three. Names with the same sorted tokens are pairs in any case; all others
need a similarity of REVIEW[0], which bounds the difference of their lengths and of their characters counted by class,
and these bounds are plain expressions in the join. Only what passes them is compared in Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blocking_keys
from ..storage import materialize
from .entities import REVIEW, decide, pair_features

#: Classes that characters are counted in, by code point.
CLASSES = 16


def representatives(rows: DataFrame) -> DataFrame:
    """One row per normalised name of ``entities.records``: the smallest id, the number of senders, and what the name determines. Empty names are left out: they never merge."""
    same = ["norm", "toks", "sorted"]
    return rows.where("norm <> ''").groupBy(*same).agg(F.min("id").alias("id"), F.min_by("name", "id").alias("name"), F.count("*").alias("n"))


def _classes(name: Column) -> Column:
    code = F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c: F.pmod(F.ascii(c), F.lit(CLASSES)))
    return F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda k: F.size(F.filter(code, lambda c: c == k)))


def reachable(left: str, right: str) -> Column:
    """Whether the matching-block ratio of two names can reach REVIEW[0]: matched characters are at most those that both have, class by class."""
    apart = F.aggregate(F.zip_with(f"{left}.classes", f"{right}.classes", lambda a, b: F.abs(a - b)), F.lit(0), lambda s, x: s + x)
    both = F.col(f"{left}.chars") + F.col(f"{right}.chars")
    return (both - apart) / both >= REVIEW[0]


def near_pairs(names: DataFrame) -> DataFrame:
    """Pairs (left, right), left < right, of representatives that share a blocking key and can get a decision other than reject; each once."""
    sets = names.select("id", F.array_distinct("toks").alias("set"), F.length("norm").alias("chars"), _classes(F.col("norm")).alias("classes"), "sorted", blocking_keys(F.col("norm"), F.col("toks")).alias("blocks"))
    sets = materialize(sets.withColumn("size", F.size("set")), "sets")
    # written, so that the join by token can be split where a token is in a third of all names
    counts = materialize(sets.select(F.explode("set").alias("token")).groupBy("token").agg(F.count("*").alias("df")), "tokens")
    ranked = sets.select("id", "size", F.explode("set").alias("token")).join(counts, "token").groupBy("id", "size").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("by"))
    prefix = F.slice("by", F.lit(1), (F.col("size") - F.ceil(F.col("size") * REVIEW[1]) + 1).cast("int"))
    keyed = ranked.select("id", F.explode(F.transform(prefix, lambda x: x["token"])).alias("key")).join(sets, "id")
    # near names are of like length unless their tokens are the same, so a key is met in bands of lengths
    band = F.floor(F.log(F.col("chars")) / math.log(REVIEW[0] / (2 - REVIEW[0])) * -1).cast("int")
    cols = F.struct("id", "chars", "classes", "sorted", "blocks", "size")
    a = keyed.select("key", band.alias("band"), cols.alias("a"))
    b = keyed.select("key", F.explode(F.array(band - 1, band, band + 1)).alias("band"), cols.alias("b"))
    least, most = F.least("a.size", "b.size"), F.greatest("a.size", "b.size")
    met = a.join(b, ["key", "band"]).where((F.col("a.id") < F.col("b.id")) & (least >= REVIEW[1] * most) & (F.col("a.sorted") != F.col("b.sorted")) & reachable("a", "b") & F.arrays_overlap("a.blocks", "b.blocks"))
    met = met.select(F.col("a.id").alias("left"), F.col("b.id").alias("right"))
    # the same tokens in another order, or repeated: every name of such a group, but only different names
    again = sets.select("sorted", "id")
    turned = again.join(again.withColumnRenamed("id", "other"), "sorted").where("id < other").select(F.col("id").alias("left"), F.col("other").alias("right"))
    return met.unionByName(turned).distinct()


def near_decisions(rows: DataFrame) -> DataFrame:
    """The merge and review decisions of ``entities.decide`` between representatives, with ``weight``, the pairs of senders that each stands for."""
    names = materialize(representatives(rows), "names")
    found = decide(pair_features(near_pairs(names), names)).where("decision <> 'reject'")
    size = lambda side: names.select(F.col("id").alias(side), F.col("n").alias(f"{side}_n"))
    return found.join(size("left"), "left").join(size("right"), "right").withColumn("weight", F.col("left_n") * F.col("right_n")).drop("left_n", "right_n")


def equal_names(rows: DataFrame) -> DataFrame:
    """Merges (left, right) of senders with the same normalised name, each with the one of the smallest id: a star in place of all pairs."""
    names = rows.where("norm <> ''").select("norm", F.col("id").alias("right"))
    first = names.groupBy("norm").agg(F.min("right").alias("left"))
    # adaptive execution can split a name that a third of all senders have, as the first ids are written
    star = names.join(materialize(first, "first"), "norm").where("left <> right")
    return star.select("left", "right", F.lit("merge").alias("decision"), F.lit("high").alias("confidence"), F.array(F.lit("normalized_exact_match")).alias("reasons"))


def edges(rows: DataFrame) -> DataFrame:
    """Decisions for ``entities.clusters``: equal names and near ones. Components are those of all pairs of a block."""
    kept = ["left", "right", "decision", "confidence", "reasons"]
    return equal_names(rows).select(*kept).unionByName(near_decisions(rows).select(*kept))


def every_pair(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(left, right, decision): decisions between representatives, and equal names, given to all pairs of senders. As large as the result that it stands for."""
    of = rows.where("norm <> ''").select("id", F.min("id").over(Window.partitionBy("norm")).alias("rep"))
    a, b = of.select(F.col("rep").alias("left"), F.col("id").alias("x")), of.select(F.col("rep").alias("right"), F.col("id").alias("y"))
    near = found.select("left", "right", "decision").join(a, "left").join(b, "right")
    same = a.join(b, F.col("left") == F.col("right")).where("x < y").withColumn("decision", F.lit("merge"))
    return near.select("x", "y", "decision").unionByName(same.select("x", "y", "decision")).select(F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right"), "decision")

