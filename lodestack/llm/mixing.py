"""Mixing to target weights: a labelled-table classifier gives soft memberships, projected gradient fits document rates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import materialize, need, small

#: Labelled rows that the classifier is fitted on, about: a hash of the id picks a share of them.
LABELLED_ROWS = 5_000
#: Words per domain in the classifier; its table has at most WORDS x domains x domains numbers.
WORDS = 48
MAX_DOMAINS = 64
ROUNDS = 20
#: The largest miss of a domain's token total, as a share of all tokens.
TOLERANCE = 1e-6
#: Default targets are the expected shares raised to this power, which lifts the smaller domains.
TEMPER = 0.8

SPACE = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), SPACE), lambda w: w != "")


@dataclass
class Classifier:
    """Bernoulli naive Bayes over the presence of chosen words: log odds by word, and a constant, for each domain."""

    domains: list[str]
    words: list[str]
    weights: np.ndarray  # words x domains
    constant: np.ndarray

    def posterior(self, words: Column) -> Column:
        """Probabilities of the domains, in their order, from an array of words."""
        if len(self.domains) < 2:
            return F.array(*[F.lit(1.0) for _ in self.domains]).cast("array<double>")
        zero = F.array(*[F.lit(float(c)) for c in self.constant])
        if self.words:
            table = F.create_map(*[x for w, row in zip(self.words, self.weights, strict=True) for x in (F.lit(w), F.array(*[F.lit(float(v)) for v in row]))])
            seen = F.array_intersect(words, F.array(*[F.lit(w) for w in self.words]))
            scores = F.aggregate(seen, zero, lambda acc, w: F.zip_with(acc, F.element_at(table, w), lambda a, b: a + b))
        else:
            scores = zero
        grown = F.get(F.transform(F.array(scores), lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s)))), F.lit(0))
        return F.get(F.transform(F.array(grown), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))), F.lit(0))


def fit_classifier(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", rows: int = LABELLED_ROWS, words: int = WORDS) -> Classifier:
    """Fit on about ``rows`` of the labelled rows, picked by a hash of the id; null domains and ids are left out.

    The words are those whose share of texts in a domain is furthest from that in all, ``words`` per domain.
    """
    need(labelled, id_col, text_col, domain_col)
    known = labelled.where(F.col(domain_col).isNotNull() & F.col(id_col).isNotNull())
    total = known.count()
    share = min(1.0, rows / total) if total else 1.0
    picked = known.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(share * 1_000_000)).select(F.col(domain_col).cast("string").alias("domain"), F.array_distinct(_words(F.col(text_col))).alias("w"))
    sizes = {r[0]: r[1] for r in picked.groupBy("domain").count().orderBy("domain").limit(MAX_DOMAINS + 1).collect()}
    if len(sizes) > MAX_DOMAINS:
        raise ValueError(f"over {MAX_DOMAINS} domains")
    domains, n = sorted(sizes), sum(sizes.values())
    if len(domains) < 2:
        return Classifier(domains, [], np.zeros((0, len(domains))), np.zeros(len(domains)))
    by = picked.select("domain", F.explode("w").alias("word")).groupBy("word").pivot("domain", domains).count().na.fill(0)
    cols = [F.col(f"`{d}`") for d in domains]
    alls = sum(cols[1:], cols[0])
    gaps = F.array(*[F.struct(F.abs(c / sizes[d] - alls / n).alias("gap"), F.lit(d).alias("domain")) for c, d in zip(cols, domains, strict=True)])
    # a word is ranked in the domain where it stands out most; rare words are no evidence
    ranked = by.where(alls >= max(2.0, 0.002 * n)).withColumn("top", F.array_max(gaps))
    w = Window.partitionBy("top.domain").orderBy(F.desc("top.gap"), "word")
    chosen = ranked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= words).select("word", *cols).orderBy("word").collect()
    names = [r[0] for r in chosen]
    counts = np.array([list(r)[1:] for r in chosen], float).reshape(len(names), len(domains))
    size = np.array([sizes[d] for d in domains], float)
    p = (counts + 0.5) / (size + 1.0)
    return Classifier(domains, names, np.log(p) - np.log1p(-p), np.log(size / n) + np.log1p(-p).sum(axis=0))


@dataclass
class Mix:
    """A fitted mix: ``rate`` is an expression over any row's posterior, so rates need no join to be applied."""

    classifier: Classifier
    steps: list[np.ndarray]
    targets: np.ndarray
    reached: np.ndarray

    def rate(self, posterior: Column) -> Column:
        return _rate(posterior, self.steps)


def _rate(posterior: Column, steps: list[np.ndarray]) -> Column:
    r = F.lit(1.0)
    for w in steps:
        move = F.lit(0.0)
        for i, x in enumerate(w):
            move = move + F.get(posterior, F.lit(i)) * float(x)
        r = F.greatest(F.lit(0.0), r - move)
    return r


def fit(docs: DataFrame, classifier: Classifier, targets: dict[str, float] | None = None, text_col: str = "text", no_loss: bool = False) -> tuple[Mix, DataFrame]:
    """Nonnegative rates whose expected domain token totals match targets, and the table (tokens, posterior) they were fitted on.

    ``targets`` are weights by domain, normalised; by default expected shares raised to TEMPER. The totals to match add
    up to the tokens there are, or with ``no_loss`` to so many that no domain shrinks. Starting from rate 1, each round
    takes a gradient step of the least-squares miss, measured in the metric of the memberships' second
    moments, and projects onto rates of at least 0. A rate depends on a row's posterior and on the rounds' steps only,
    a number per domain and round, so each round is one aggregation over the table, which lies in the shared folder.
    """
    need(docs, text_col)
    d = len(classifier.domains)
    rows = docs.select(_words(F.col(text_col)).alias("w")).select(F.size("w").cast("double").alias("t"), classifier.posterior(F.col("w")).alias("p"))
    table = materialize(rows, "posteriors")
    if targets is not None and set(targets) - set(classifier.domains):
        raise ValueError(f"no labelled rows of {sorted(set(targets) - set(classifier.domains))}")
    p = [F.get("p", F.lit(i)) for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    row = table.agg(*[F.sum(F.col("t") * p[i]) for i in range(d)], *[F.sum(F.col("t") * p[i] * p[j]) for i, j in pairs], F.sum("t")).first()
    now = np.array([x or 0.0 for x in row[:d]])
    total = row[-1] or 0.0
    if not total or d < 2:
        return Mix(classifier, [], now, now), table
    moment = np.zeros((d, d))
    for (i, j), x in zip(pairs, row[d:-1], strict=True):
        moment[i, j] = moment[j, i] = x
    want = np.array([float(targets.get(x, 0.0)) for x in classifier.domains]) if targets else (now / total) ** TEMPER
    want = want / want.sum()
    want = want * (max([n / w for n, w in zip(now, want, strict=True) if w > 0]) if no_loss else total)
    metric = np.linalg.pinv(moment + np.eye(d) * 1e-12 * np.trace(moment))
    steps: list[np.ndarray] = []
    for _ in range(ROUNDS):
        miss = now - want
        if np.abs(miss).max() <= TOLERANCE * total:
            break
        steps.append(metric @ miss)
        r = _rate(F.col("p"), steps)
        now = np.array(list(table.agg(*[F.sum(r * F.col("t") * x) for x in p]).first()))
    return Mix(classifier, steps, want, now), table


def rates(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, domain, rate) of every row. Null and wordless texts get the rate of the posterior of no words; ids may repeat or be null."""
    need(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), _words(F.col(text_col)).alias("w")).select("id", F.size("w").cast("long").alias("n_tokens"), mix.classifier.posterior(F.col("w")).alias("p"))
    names = F.array(*[F.lit(x) for x in mix.classifier.domains]).cast("array<string>")
    top = F.get(names, (F.array_position("p", F.array_max("p")) - 1).cast("int"))
    return rows.select("id", "n_tokens", top.alias("domain"), mix.rate(F.col("p")).alias("rate"))


def repeat_rows(docs: DataFrame, mix: Mix, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with every row as often as its rate says: the whole part, and once more by a hash of id and text where that falls under the fraction; at least once."""
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(kept, _words(F.col(text_col)).alias("_w"), F.pmod(F.xxhash64(id_col, text_col), F.lit(1_000_000)).alias("_u"))
    rows = rows.select("_row", "_u", mix.classifier.posterior(F.col("_w")).alias("_p")).select("_row", "_u", mix.rate(F.col("_p")).alias("_r"))
    n = F.greatest(F.lit(1), F.floor(F.col("_r") + F.col("_u") / 1_000_000.0).cast("int"))
    return rows.select("_row", F.explode(F.array_repeat(F.lit(0), n)).alias("_copy")).select("_row.*")


def labelled_by_language(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of the labelled table with their language as domain. A share of the ids is taken before the texts are read."""
    own = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct()
    return docs.join(small(own), docs[id_col] == own["_id"], "left_semi").select(id_col, "text", F.col("lang").alias("domain"))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labelled = labelled_by_language(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    mix, _ = fit(docs, fit_classifier(labelled))
    return rates(docs, mix).withColumnRenamed("id", "doc_id")
