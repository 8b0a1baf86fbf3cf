"""Quality classifier: perplexity under a Kneser-Ney model of trusted text, against quantiles by language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize, need, small
from .kneser_ney import char_model, count_chars, log_likelihoods

ORDER = 5
#: A text is kept up to this quantile of the log-perplexities of trusted texts of its language that the model has not seen.
QUANTILE = 0.995
#: One in so many trusted rows, by a hash of the id, gives quantiles instead of counts.
FOLDS = 5


def perplexities(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(id, log_likelihood, n_chars) of every row under a model of all ``trusted`` texts. Null is the empty text."""
    need(docs, id_col, text_col)
    need(trusted, text_col)
    top = materialize(count_chars(trusted.select(F.col(text_col).cast("string").alias("text")), order), "trusted")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return log_likelihoods(rows, char_model(top, order))


def classify(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """(id, lang, n_chars, perplexity, threshold, kept, fold) for every row of ``docs``.

    ``trusted_ids`` has the ids (column ``id``) of trusted rows of ``docs``. One in FOLDS of them gives the thresholds
    (fold ``threshold``), all others train the model (fold ``model``); null elsewhere. The threshold is the quantile over
    the row's language (null is a language of its own), or over all held-out rows where that language has none. Rows
    without a word have a null perplexity and are not kept; without held-out rows the threshold is null and every
    row with words is kept. Repeated rows are judged alike, rows with a null id are never trusted.
    """
    need(docs, id_col, text_col, lang_col)
    ids = small(trusted_ids.where("id IS NOT NULL").select(F.col("id").alias("_t")).distinct().withColumn("_held", F.pmod(F.xxhash64("_t"), F.lit(FOLDS)) == 0))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    trusted = own.join(ids.where("NOT _held"), own["id"] == ids["_t"], "left_semi")
    # the key carries the language along with the id, so that no text is joined
    keyed = own.select(F.struct("id", "lang", F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)).alias("words")).alias("id"), "text")
    got = perplexities(keyed, trusted.select("text"), "id", "text").select("id.id", "id.lang", "n_chars", F.when(F.col("id.words"), -F.col("log_likelihood") / F.col("n_chars")).alias("h"))
    got = materialize(got.join(ids, got["id"] == ids["_t"], "left").drop("_t"), "perplexity")
    q = F.percentile_approx("h", F.lit(quantile), F.lit(10_000))
    by = got.where("_held").groupBy("lang").agg(q.alias("q")).select(F.col("lang").alias("_lang"), "q")
    overall = got.where("_held").agg(q.alias("q")).first()[0]
    rows = got.join(by, got["lang"].eqNullSafe(by["_lang"]), "left")
    edge = F.coalesce("q", F.lit(overall).cast("double"))
    kept = F.col("h").isNotNull() & F.coalesce(F.col("h") <= edge, F.lit(True))
    fold = F.when(F.col("_held"), "threshold").when(~F.col("_held"), "model")
    return rows.select("id", "lang", "n_chars", F.exp("h").alias("perplexity"), F.exp(edge).alias("threshold"), kept.alias("kept"), fold.alias("fold"))


def op2_quality_lm(spark, sf_dir: str) -> DataFrame:
    """``classify`` over all documents, trusting those with quality 1 in any row of ``labels``; null, empty and repeated rows as there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = classify(docs, labels.where("quality = 1").select(F.col("doc_id").alias("id")))
    return got.withColumnRenamed("id", "doc_id")
