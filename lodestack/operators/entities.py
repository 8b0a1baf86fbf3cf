"""Entity resolution of sender names: blocking, pairwise decisions, components, reviewable merge plans, application."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import length_bound, ratio, ratio_bound
from ..functions.text import blocking_keys, sender_name, shape_conflict, squeeze, token_overlap, tokens
from ..storage import materialize
from .components import connected_components

# Least similarity and token overlap to merge and to review.
MERGE, REVIEW = (0.93, 0.67), (0.86, 0.50)


def records(senders: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """One row per sender (id, name) with a nonblank name: its normalised forms, sorted document ids and the titles of the first five."""
    rows = senders.select("id", "name").where(squeeze(F.coalesce("name", F.lit(""))) != "")
    rows = rows.withColumn("norm", sender_name("name")).withColumn("toks", tokens("norm")).withColumn("sorted", F.array_join(F.array_sort("toks"), " "))
    if docs is None:
        return rows
    own = docs.where("correspondent IS NOT NULL AND correspondent <> 0").groupBy(F.col("correspondent").alias("id"))
    own = own.agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("doc"), "title"))).alias("d"))
    own = own.select("id", F.transform("d", lambda x: x["doc"]).alias("document_ids"), F.transform(F.slice("d", 1, 5), lambda x: x["title"]).alias("sample_titles"))
    none = lambda c, t: F.coalesce(c, F.array().cast(t))
    return rows.join(own, "id", "left").select(*rows.columns, none("document_ids", "array<bigint>").alias("document_ids"), none("sample_titles", "array<string>").alias("sample_titles"))


def candidate_pairs(rows: DataFrame, most_per_key: int | None = None) -> DataFrame:
    """Pairs (left, right), left < right, of records that share a blocking key, each once.

    ``most_per_key`` leaves out keys of more records than that; it is off unless asked for. The join is on
    the key, so adaptive execution can split a common one.
    """
    keyed = rows.select("id", F.explode(blocking_keys(F.col("norm"), F.col("toks"))).alias("key"))
    if most_per_key:
        keyed = keyed.join(keyed.groupBy("key").count().where(F.col("count") <= most_per_key).select("key"), "key", "left_semi")
    a, b = keyed.withColumnRenamed("id", "left"), keyed.withColumnRenamed("id", "right")
    return a.join(b, "key").where(F.col("left") < F.col("right")).select("left", "right").distinct()


def pair_features(pairs: DataFrame, rows: DataFrame, with_ratio: bool = True) -> DataFrame:
    """Pairs with both names and forms, token overlap, shape conflict and, if asked, similarity of the normalised names."""
    own = lambda side: rows.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("name", "norm", "toks", "sorted")])
    got = pairs.join(own("left"), "left").join(own("right"), "right")
    got = got.withColumn("overlap", token_overlap(F.col("left_toks"), F.col("right_toks"))).withColumn("conflict", shape_conflict(F.col("left_toks"), F.col("right_toks")))
    return got.withColumn("ratio", ratio("left_norm", "right_norm")) if with_ratio else got


def _decision(action: str, confidence: str, *reasons: str) -> Column:
    return F.struct(F.lit(action).alias("decision"), F.lit(confidence).alias("confidence"), F.array(*[F.lit(r) for r in reasons]).alias("reasons"))


def _same() -> tuple[Column, Column]:
    """Whether two names are equal, and whether their tokens are."""
    same = (F.col("left_norm") == F.col("right_norm")) & (F.col("left_norm") != "")
    return same, (F.col("left_sorted") == F.col("right_sorted")) & (F.col("left_sorted") != "") & (F.col("overlap") >= 1)


def decidable(features: DataFrame) -> DataFrame:
    """Features, without a similarity yet, of the pairs that ``decide`` can say something about: of names that only their similarity could bring together,
    those whose overlap, lengths and characters allow it. So only these are compared in Python, and the decisions stay what they were.
    """
    can = (F.col("overlap") >= REVIEW[1]) & (length_bound("left_norm", "right_norm") >= REVIEW[0]) & (ratio_bound("left_norm", "right_norm") >= REVIEW[0])
    same, same_tokens = _same()
    return features.where(F.col("conflict") | same | same_tokens | can)


def decisions_of(rows: DataFrame) -> DataFrame:
    """``decide`` over all pairs of records that share a blocking key."""
    kept = decidable(pair_features(candidate_pairs(rows), rows, with_ratio=False))
    return decide(kept.withColumn("ratio", ratio("left_norm", "right_norm")))


def decide(features: DataFrame) -> DataFrame:
    """Features with ``decision``, ``confidence`` and ``reasons``; the first rule that holds decides, and pairs without one are dropped.

    A conflict of shapes comes first; empty normalised names never merge.
    """
    same, same_tokens = _same()
    near = lambda t: (F.col("ratio") >= t[0]) & (F.col("overlap") >= t[1])
    d = (
        F.when(F.col("conflict"), _decision("reject", "high", "entity_shape_conflict"))
        .when(same, _decision("merge", "high", "normalized_exact_match"))
        .when(same_tokens, _decision("merge", "high", "token_sort_exact_match"))
        .when(near(MERGE), _decision("merge", "medium", "high_similarity_overlap"))
        .when(near(REVIEW), _decision("review", "low", "borderline_similarity"))
    )
    return features.withColumn("d", d).where("d IS NOT NULL").select(*features.columns, "d.*")


def judged(decisions: DataFrame, judge: Callable[[str, str], dict]) -> DataFrame:
    """Review pairs replaced by a judge's word: merge only if it says the same with high confidence, reject otherwise, and reject with a reason if it fails."""

    def run(batches):
        for pdf in batches:
            for i, r in pdf.iterrows():
                if r["decision"] != "review":
                    continue
                try:
                    said = judge(r["left_name"], r["right_name"])
                    yes = bool(said.get("same")) and said.get("confidence") == "high"
                    new = ("merge" if yes else "reject", str(said.get("confidence", "low")), ["judge"])
                except Exception:  # whatever a model's client raises
                    new = ("reject", "low", ["judge_error"])
                for c, v in zip(("decision", "confidence", "reasons"), new, strict=True):
                    pdf.at[i, c] = v
            yield pdf

    return decisions.mapInPandas(run, decisions.schema)


def clusters(decisions: DataFrame, rows: DataFrame) -> DataFrame:
    """Components of merge pairs with their canonical sender, merged ids and names, document ids, reasons and confidence.

    Merging is transitive and rejected pairs veto nothing. The canonical sender has most documents, then the longest name, then
    the smallest id. Confidence is high if every pair's is. Sorted by documents to move, then by name, then id.
    """
    edges = decisions.where("decision = 'merge'").select(F.col("left").alias("a"), F.col("right").alias("b"), "confidence", "reasons")
    roots = connected_components(edges.select("a", "b"))
    members = roots.join(rows.withColumnRenamed("id", "node"), "node").withColumn("n_docs", F.size("document_ids"))
    best = F.max_by(F.struct(F.col("node").alias("id"), "name", "document_ids"), F.struct("n_docs", F.length("name"), -F.col("node")))
    per = members.groupBy("root").agg(best.alias("c"), F.collect_list(F.struct(F.col("node").alias("id"), "name", "document_ids")).alias("m"))
    said = edges.join(roots, edges["a"] == roots["node"]).groupBy("root").agg(F.every(F.col("confidence") == "high").alias("sure"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"))
    gone = F.filter("m", lambda x: x["id"] != F.col("c.id"))
    moved = F.array_sort(F.array_distinct(F.flatten(F.transform(gone, lambda x: x["document_ids"]))))
    out = per.join(said, "root").select(
        F.col("c.id").alias("canonical_id"),
        F.col("c.name").alias("canonical_name"),
        F.array_sort(F.transform(gone, lambda x: x["id"])).alias("merged_ids"),
        F.array_sort(F.transform(gone, lambda x: x["name"])).alias("merged_names"),
        moved.alias("document_ids"),
        F.aggregate(gone, F.lit(0), lambda s, x: s + F.size(x["document_ids"])).alias("source_documents"),
        "reasons",
        F.when(F.col("sure"), "high").otherwise("medium").alias("confidence"),
        F.lit("pending").alias("status"),
    )
    return out.orderBy(F.desc("source_documents"), F.lower("canonical_name"), "canonical_id")


def orphans(senders: DataFrame, docs: DataFrame) -> DataFrame:
    """Senders without a document, by name."""
    return senders.join(docs.where("correspondent <> 0").select(F.col("correspondent").alias("id")), "id", "left_anti").select("id", "name", F.lit("pending").alias("status")).orderBy(F.lower("name"), "id")


def merge_plan(senders: DataFrame, docs: DataFrame, judge: Callable[[str, str], dict] | None = None) -> dict[str, DataFrame]:
    """The parts of a plan: ``pairs`` that got a decision, ``clusters`` and ``orphans``."""
    rows = materialize(records(senders, docs), "records")
    decisions = decisions_of(rows)
    decisions = materialize(judged(decisions, judge) if judge else decisions, "decisions")
    pairs = decisions.select("left", "right", "left_name", "right_name", "decision", "confidence", "reasons", "ratio", "overlap").orderBy(F.lower("left_name"), F.lower("right_name"), "left", "right")
    return {"pairs": pairs, "clusters": clusters(decisions, rows), "orphans": orphans(senders, docs)}


def plan_summary(pairs: DataFrame, found: DataFrame, lone: DataFrame) -> DataFrame:
    """One row of counts by decision, clusters, orphans and planned moves."""
    a = pairs.agg(*[F.count_if(F.col("decision") == d).alias(f"{d}_pairs") for d in ("merge", "review", "reject")])
    b = found.agg(F.count("*").alias("clusters"), F.coalesce(F.sum(F.size("document_ids")), F.lit(0)).alias("planned_moves"))
    c = lone.agg(F.count("*").alias("orphans"))
    return a.join(b, F.lit(True)).join(c, F.lit(True))


PLAN = "version int, generated_at string, clusters array<struct<canonical_id bigint, canonical_name string, merged_ids array<bigint>, merged_names array<string>, document_ids array<bigint>, source_documents int, reasons array<string>, confidence string, status string>>, orphans array<struct<id bigint, name string, status string>>"


def write_plan(plan: dict[str, DataFrame], path: str, generated_at: str, version: int = 1) -> str:
    """The plan as indented JSON, to a file or, for ``-``, returned only. A plan is for people to review, so it is one document."""
    body = {"version": version, "generated_at": generated_at} | {k: [json.loads(r) for r in plan[k].toJSON().collect()] for k in ("clusters", "orphans")}
    text = json.dumps(body, indent=2, ensure_ascii=False)
    if path != "-":
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return text


def read_plan(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Clusters and orphans of a plan file; fields it doesn't have are null."""
    plan = spark.read.schema(PLAN).json(path, multiLine=True)
    return {k: plan.select(F.inline(k)) for k in ("clusters", "orphans")}


def apply_plan(plan: dict[str, DataFrame], senders: DataFrame, docs: DataFrame, dry_run: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(senders, documents, counters) after the approved parts of a plan.

    Documents of merged senders move to the canonical one; merged and orphaned senders go if no document is left
    to them. A dry run counts the moves and changes nothing, so its sources keep documents and count as skipped.
    """
    approved = plan["clusters"].where("status = 'approved'")
    moves = approved.select(F.explode("merged_ids").alias("correspondent"), F.col("canonical_id").alias("_to")).dropDuplicates(["correspondent"])
    target = docs.join(moves, "correspondent", "left")
    counted = target.agg(F.count_if(F.col("_to").isNotNull()).alias("reassigned"))
    after = docs if dry_run else target.withColumn("correspondent", F.coalesce("_to", "correspondent")).select(*docs.columns)
    doomed = moves.select(F.col("correspondent").alias("id")).unionByName(plan["orphans"].where("status = 'approved'").select("id")).distinct()
    doomed = doomed.join(senders.select("id"), "id", "left_semi")
    free = doomed.join(after.select(F.col("correspondent").alias("id")), "id", "left_anti")
    counts = counted.join(free.agg(F.count("*").alias("deleted")), F.lit(True)).join(doomed.agg(F.count("*").alias("_all")), F.lit(True))
    counts = counts.join(plan["clusters"].agg(F.count_if(F.coalesce("status", F.lit("")) != "approved").alias("skipped_clusters")), F.lit(True))
    counts = counts.select("reassigned", F.when(F.lit(dry_run), 0).otherwise(F.col("deleted")).alias("deleted"), (F.col("_all") - F.col("deleted")).alias("skipped_deletes"), "skipped_clusters")
    return (senders if dry_run else senders.join(free, "id", "left_anti")), after, counts


def documents_per_sender(docs: DataFrame) -> DataFrame:
    return docs.where("correspondent IS NOT NULL").groupBy("correspondent").count()


