"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.llm import bpe, mixing, quality_rules, simhash, toxicity
from lodestack.llm.base import arrow_rows, crc_mod, materialize, new_folder, small

#: Scores from here on are toxic.
TOXIC = 0.7
#: Whole texts that a worker gets at once.
BATCH = 1_000


def _whole(docs: DataFrame) -> DataFrame:
    """Rows as one struct beside their text, so that a stage's verdict needs no join to reach them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule. Null and wordless texts go."""
    rows = quality_rules.apply_rules(_whole(docs), "row", "text")
    # a filter would be pushed below the projections and evaluate the measures once per use; a generator is not
    return rows.select(F.explode(F.when(F.col("kept"), F.array("id"))).alias("row")).select("row.*")


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with two hashes, 128 bits in all, that tell rows of different ids or texts apart; rows equal in both are judged alike."""
    return docs.withColumn("_a", F.xxhash64("doc_id", "text")).withColumn("_b", F.xxhash64(F.lit(1), "doc_id", "text"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under TOXIC, by models of the labelled documents among those left; null and empty texts are scored by their end alone, repeated rows alike."""
    learned = toxicity.labelled_texts(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = _keyed(docs)
    with arrow_rows(spark, BATCH):
        got = toxicity.score_toxicity(rows.select(F.struct("_a", "_b").alias("key"), "text"), learned, crc_mod("doc_id", 5) == 0, "key", "text")
        out = materialize(got.where(F.col("score") >= TOXIC).select("id.*").distinct(), "toxic")
    return rows.join(small(out), ["_a", "_b"], "left_anti").drop("_a", "_b")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest id, of several the one whose hashes are least. Rows with a null id stay only in groups without any id; an id that has texts in several groups stays in each."""
    rows = _keyed(docs)
    keyed = rows.select(F.struct("doc_id", "_a", "_b").alias("key"), "text")
    with arrow_rows(spark, BATCH):
        fps = materialize(simhash.fingerprints(keyed, "key").select("id.*", "fp"), "fps")
    groups = simhash.rooted(materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes"))
    least = fps.join(groups.select("fp", "root", "component"), "fp").where(F.col("doc_id").eqNullSafe(F.col("component")))
    first = least.groupBy("root").agg(F.min("_a").alias("_a"), F.min_by("_b", "_a").alias("_b")).select("_a", "_b")
    w = Window.partitionBy("_a", "_b").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    kept = rows.join(first, ["_a", "_b"], "left_semi").withColumn("_n", F.row_number().over(w))
    return kept.where("_n = 1").drop("_a", "_b", "_n")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by rates that bring languages to tempered weights; none is dropped."""
    labelled = mixing.labelled_by_language(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    fitted, _ = mixing.fit(docs, mixing.fit_classifier(labelled), no_loss=True)
    return mixing.repeat_rows(docs, fitted)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, null and empty ones too; repeated rows are encoded alike. Written here, so that the batches of this stage are the pipeline's and not the caller's."""
    got = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=False)
    with arrow_rows(spark, BATCH):
        return materialize(got.select(F.col("id").alias("doc_id"), "n_tokens", "ids"), "tokens")


STAGES = [("quality rules", quality), ("toxicity", toxic), ("near copies", near_copies), ("mixing", mix), ("tokens", tokens)]

#: The toxicity model, fingerprints and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = new_folder(spark, f"stage{i}")
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
