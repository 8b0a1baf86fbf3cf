"""Toxicity from class-conditional Kneser-Ney models of characters with shared backoff counts.

A text's score is the difference of its two whole log-likelihoods, divided by its length and mapped to a probability. The
word contrasts further down are a plainer measure of single words, which no score uses.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import crc_mod, materialize, need, small, tidy
from .blocks import blocks, distinct, fold, keys_of, pack_words, pieces, settled, split, strings, unpack_words
from .kneser_ney import block_counts, discounts, sums
from .kneser_ney import _off as discounted

#: Characters of an n-gram, and of the longest that both classes share.
ORDER, SHARED = 4, 2
#: Marks that are no part of a word when they stand around it.
MARKS = ".,;:!?\"'()[]{}<>*#$%&|-_/\\"
#: Kneser-Ney discounts of counts 1, 2 and more, which are texts: a word of two texts of a class tells nothing of it yet.
DISCOUNTS = (1.0, 2.0, 2.0)
#: Words from this log ratio on are strong: below it are the differences between any two samples of one language.
EVIDENCE = 1.5
#: Added to the number of words under the root, so that few words of a short text don't weigh too much.
SHORT = 20
#: Bytes of text that are cut into words at once.
PIECE = 1 << 20
#: Rows at most on which the map to a probability is fitted.
CALIBRATION_ROWS = 20_000


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of each text once: their number in the vocabulary, and how many a text has. Texts are split piece by piece, so that only distinct words of all are held."""
    words, own, sizes, n = [pa.array([], pa.large_string())], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for _, part in pieces(texts, PIECE):
        vocabulary, ids, size = split(part, True, MARKS)
        wide = max(1, len(vocabulary))
        pair = distinct(np.repeat(np.arange(len(size)), size) * wide + ids)
        words.append(vocabulary.cast(pa.large_string()))
        own.append((pair % wide + n).astype(np.int32))
        sizes.append(np.bincount(pair // wide, minlength=len(size)))
        n += len(vocabulary)
    every = pa.concat_arrays(words).dictionary_encode()
    return every.dictionary, every.indices.to_numpy(zero_copy_only=False)[np.concatenate(own).astype(np.int64)], np.concatenate(sizes).astype(np.int64)


def _keys(texts: pa.Array) -> pa.Array:
    vocabulary, ids, _ = _words(texts)
    return vocabulary.take(pa.array(distinct(ids)))


def class_counts(labelled: DataFrame) -> DataFrame:
    """(key, c0, c1): texts of each class that a word occurs in, over all rows (cls, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b in blocks(batches):
            vocabulary, ids, size = _words(b.column(1))
            cls = np.repeat(b.column(0).to_numpy(zero_copy_only=False), size)
            n = [pa.array(np.bincount(ids[cls == k], minlength=len(vocabulary))) for k in (0, 1)]
            rows = pa.Table.from_arrays([vocabulary.cast(pa.string()), *n], ["key", "c0", "c1"])
            yield from rows.filter(pc.greater(pc.add(rows["c0"], rows["c1"]), 0)).to_batches(max_chunksize=50_000)

    got = labelled.select("cls", "text").mapInArrow(run, "key string, c0 long, c1 long")
    return got.groupBy("key").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def _off(c: Column) -> Column:
    return F.when(c >= 3, DISCOUNTS[2]).when(c == 2, DISCOUNTS[1]).when(c == 1, DISCOUNTS[0]).otherwise(0.0)


def contrast(counts: DataFrame) -> DataFrame:
    """(key, value): the log ratio of the toxic and the ordinary probability of every word that has counts.

    p(word | class) = (1 - g) * discounted count / sum of these + g * p(word), where p(word) is the word's share of the counts of both
    classes and g the larger of the two classes' discounted shares. Backoff counts and weight being shared, a
    word that neither class has seen often enough, or at all, has ratio 1. Counts of one class only give no rows.
    """
    c = {k: F.col(f"c{k}").cast("double") for k in (0, 1)}
    row = counts.agg(*[F.sum(c[k]) for k in (0, 1)], *[F.sum(_off(c[k])) for k in (0, 1)]).first()
    total, off = [x or 0.0 for x in row[:2]], [x or 0.0 for x in row[2:]]
    if not all(total):
        return counts.where(F.lit(False)).select("key", F.lit(0.0).alias("value"))
    g = max(o / t for o, t in zip(off, total, strict=True))
    q = (c[0] + c[1]) / sum(total)

    def p(k: int) -> Column:
        own = (c[k] - _off(c[k])) * ((1 - g) / (total[k] - off[k])) if total[k] > off[k] else F.lit(0.0)
        return own + g * q

    return counts.select("key", F.log(p(1) / p(0)).alias("value")) if g > 0 else counts.where(F.lit(False)).select("key", F.lit(0.0).alias("value"))


def ratios(rows: DataFrame, model: DataFrame) -> DataFrame:
    """(id, ratio, n_words) of rows (id, text): the log ratios of a text's different toxic words, over the root of the number of its different words.

    The sum is the gain in log-likelihood if each word comes from the class that explains it better; over the root of
    the length, texts of any length spread alike. Words meet ``model`` (key, value) by joins over the distinct
    words of a block (see ``blocks``).
    """

    def score(b: pa.RecordBatch, key: pa.Array, value: np.ndarray) -> tuple:
        vocabulary, ids, size = unpack_words(b)
        at = pc.index_in(vocabulary.cast(pa.string()), value_set=key.cast(pa.string()))
        gain = np.zeros(len(vocabulary))
        hit = pc.is_valid(at).to_numpy(zero_copy_only=False)
        gain[hit] = value[at.drop_null().to_numpy(zero_copy_only=False)]
        total = np.bincount(np.repeat(np.arange(len(size)), size), gain[ids], len(size)) if len(ids) else np.zeros(len(size))
        return total / np.sqrt(size + SHORT), size.astype(np.int64)

    rows = settled(rows.select("id", "text"))
    values = keys_of(rows, _keys).join(model, "key").select("block", "key", "value")
    return fold(rows, lambda b: pack_words(b, *_words(b.column(b.num_columns - 1))), values, score, "ratio double, n_words long")


def class_grams(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, c0, c1): how often each class has each n-gram of characters, over all rows (cls, text) of every length; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b in blocks(batches):
            for k in (0, 1):
                codes, n = block_counts(b.filter(pc.equal(b.column(0), k)).column(1), order)
                got, none = strings(codes), np.zeros(len(n), np.int64)
                own = [n, none] if k == 0 else [none, n]
                for i in range(0, len(got), 50_000):
                    yield pa.RecordBatch.from_arrays([got.slice(i, 50_000), *[pa.array(x[i : i + 50_000]) for x in own]], ["gram", "c0", "c1"])

    got = labelled.select("cls", "text").mapInArrow(tidy(run), "gram string, c0 long, c1 long")
    return got.groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


@dataclass
class Classes:
    """``levels[n]`` (gram, p0, p1): the probability of a gram's last character in each class; ``weights[n]`` (ctx, g0, g1): the backoff weights of
    contexts of n - 1 characters. Both for n from SHARED + 1 to ``order``: below, the classes have one distribution, so their ratio is 1."""

    order: int
    levels: dict[int, DataFrame]
    weights: dict[int, DataFrame]


def class_models(top: DataFrame, order: int = ORDER, shared: int = SHARED) -> Classes:
    """Interpolated modified Kneser-Ney models of both classes from counts (gram, c0, c1).

    Lower orders count distinct characters to the left: of each class down to ``shared`` + 1 characters, of both classes together from there on.
    Every gram of either class has a probability in both.
    """
    counts = {order: top.select("gram", "c0", "c1")}
    for n in range(order - 1, 0, -1):
        by = counts[n + 1].groupBy(F.substring("gram", 2, n).alias("gram"))
        kinds = ("c0", "c1") if n > shared else ("c",)
        counts[n] = materialize(by.agg(*[(F.count_if(F.col(c) > 0) if n > shared else F.count("*")).alias(c) for c in kinds]), f"tox{n}")
    base = 1.0 / (counts[1].count() + 1)
    levels: dict[int, DataFrame] = {}
    weights: dict[int, DataFrame] = {}
    for n in range(1, order + 1):
        ends = ("0", "1") if n > shared else ("",)
        off = dict(zip(ends, discounts(counts[n], *[f"c{e}" for e in ends]), strict=True))
        less = {e: discounted(F.col(f"c{e}"), off[e]) for e in ends}
        rows = counts[n].withColumn("ctx", F.substring("gram", 1, n - 1))
        by = rows.groupBy("ctx").agg(*[x for e in ends for x in (F.sum(f"c{e}").alias(f"t{e}"), F.sum(less[e]).alias(f"o{e}"))])
        # a context that a class has not seen leaves all to the shorter one
        g = {e: F.when(F.col(f"t{e}") > 0, F.col(f"o{e}") / F.col(f"t{e}")).otherwise(1.0).alias(f"g{e}") for e in ends}
        weights[n] = materialize(by.select("ctx", *[x for e in ends for x in (f"t{e}", g[e])]), f"toxw{n}")
        rows = rows.join(weights[n], "ctx")
        if n == 1:
            rows = rows.withColumn("q", F.lit(base))
        else:
            rest = levels[n - 1].withColumnRenamed("gram", "rest")
            rest = rest.withColumnsRenamed({f"p{e}": f"q{e}" for e in ("", "0", "1")})
            rows = rows.withColumn("rest", F.substring("gram", 2, n - 1)).join(rest, "rest")
        q = {e: f"q{e}" if n > shared + 1 else "q" for e in ends}
        p = {e: F.when(F.col(f"t{e}") > 0, (F.col(f"c{e}") - less[e]) / F.col(f"t{e}")).otherwise(0.0) + F.col(f"g{e}") * F.col(q[e]) for e in ends}
        levels[n] = materialize(rows.select("gram", *[p[e].alias(f"p{e}") for e in ends]), f"toxp{n}")
    own = range(shared + 1, order + 1)
    return Classes(order, {n: levels[n] for n in own}, {n: weights[n].select("ctx", "g0", "g1") for n in own})


def log_ratios(wanted: DataFrame, m: Classes) -> DataFrame:
    """(key, value): log p(last character | the others, toxic) less that of the other class, for every distinct n-gram ``key``."""
    rows, value = wanted, F.lit(0.0)
    for n in m.levels:
        at = m.order - n + 1
        level = m.levels[n].select(F.col("gram").alias(f"_g{n}"), F.log(F.col("p1") / F.col("p0")).alias(f"_v{n}"))
        weight = m.weights[n].select(F.col("ctx").alias(f"_c{n}"), F.log(F.col("g1") / F.col("g0")).alias(f"_b{n}"))
        rows = rows.join(level, F.substring("key", at, n) == F.col(f"_g{n}"), "left").drop(f"_g{n}")
        rows = rows.join(weight, F.substring("key", at, n - 1) == F.col(f"_c{n}"), "left").drop(f"_c{n}")
        value = F.coalesce(F.col(f"_v{n}"), F.coalesce(f"_b{n}", F.lit(0.0)) + value)
    return rows.select(*wanted.columns, value.cast("float").alias("value"))


def length_ratios(rows: DataFrame, m: Classes) -> DataFrame:
    """(id, ratio, n_chars) of rows (id, text): the log-likelihood of the whole text in the toxic class less that in the other, divided by its length.

    Every character counts and the end of the text as one; null is the empty text. The two log-likelihoods are summed as one difference, since both ask for the same n-grams.
    """
    got = sums(rows, m.order, lambda wanted: log_ratios(wanted, m), "ratio")
    return got.select("id", (F.col("ratio") / F.col("n_chars")).alias("ratio"), "n_chars")


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float]]:
    """Ends of the runs of equal probability in the rising step function that fits the labels best, and that probability at each end."""
    at, back = np.unique(x, return_inverse=True)
    runs: list[list[float]] = []
    for v, hits, n in zip(at.tolist(), np.bincount(back, y).tolist(), np.bincount(back).tolist(), strict=True):
        runs.append([v, v, hits, n])
        while len(runs) > 1 and runs[-2][2] * runs[-1][3] >= runs[-1][2] * runs[-2][3]:
            _, end, hits, n = runs.pop()
            runs[-1] = [runs[-1][0], end, runs[-1][2] + hits, runs[-1][3] + n]
    return [e for r in runs for e in r[:2]], [r[2] / r[3] for r in runs for _ in (0, 1)]


def _between(x: Column, at: list[float], p: list[float]) -> Column:
    """Straight lines between the points (at, p), and level beyond them."""
    xs, ps = F.array(*map(F.lit, at)), F.array(*map(F.lit, p))
    i = F.size(F.filter(xs, lambda v: v <= x))
    lo, hi = F.greatest(i, F.lit(1)), F.least(i + 1, F.lit(len(at)))
    x0, x1, p0, p1 = F.element_at(xs, lo), F.element_at(xs, hi), F.element_at(ps, lo), F.element_at(ps, hi)
    return F.when((i > 0) & (x1 > x0), p0 + (p1 - p0) * (x - x0) / (x1 - x0)).otherwise(p0)


def score_toxicity(docs: DataFrame, labelled: DataFrame, calibrate: Column, id_col: str = "doc_id", text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """(id, score, ratio, n_chars) for every row of ``docs``.

    ``labelled`` has (text, toxic 0/1, an id ``key_col``, and what ``calibrate`` reads): rows where ``calibrate`` is false or null
    give the counts, all of them; the others, CALIBRATION_ROWS at most, picked by a hash of id and text, fit the rising map
    from the ratio to a probability. Rows with null labels are ignored; null and empty texts are scored by their end alone; repeated
    rows are scored alike. If the rows for either purpose lack a class, the score is the share of toxic labels, 0 without labels.
    """
    need(docs, id_col, text_col)
    need(labelled, text_col, "toxic", key_col)
    rows = labelled.where("toxic IS NOT NULL").select(F.col(text_col).cast("string").alias("text"), (F.col("toxic") > 0).cast("int").alias("cls"), F.coalesce(calibrate, F.lit(False)).alias("held"), F.xxhash64(key_col, text_col).alias("pick"))
    top = materialize(class_grams(rows.where("NOT held")), "toxic")
    model = class_models(top)
    held = rows.where("held")
    total = held.count()
    if total > CALIBRATION_ROWS:  # a tenth more by their hash, spread over the table, and of these the least hashes
        held = held.where(F.pmod("pick", F.lit(1 << 40)) < int(1.1 * CALIBRATION_ROWS / total * (1 << 40)))
    sample = materialize(held.select(F.struct("cls", "pick").alias("id"), "text").orderBy(F.pmod("pick", F.lit(1 << 40)), "pick").limit(CALIBRATION_ROWS), "calibration")
    made = length_ratios(sample, model).select("id.cls", "ratio").toPandas()
    x, y = made["ratio"].to_numpy(), made["cls"].to_numpy(float)
    seen = top.agg(F.max("c0"), F.max("c1")).first()
    if 0 < y.sum() < len(y) and all(seen):
        at, p = isotonic(x, y)
    else:
        at, p = [0.0], [float(rows.agg(F.avg("cls")).first()[0] or 0.0)]
    got = length_ratios(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), model)
    return got.select("id", _between(F.col("ratio"), at, p).alias("score"), "ratio", "n_chars")


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_col, toxic) of labelled rows; of repeated labels of a document the largest toxic one counts. Null ids have no label."""
    own = small(labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_label_id")).agg(F.max("toxic").alias("toxic")))
    texts = docs.select(F.col(id_col).alias("_label_id"), text_col)
    return texts.join(own, "_label_id").withColumnRenamed("_label_id", id_col)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """``score_toxicity`` over all documents; counts from four fifths of the rows allowed, the map from the rest. Null ids are scored and not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learned = labelled_texts(docs, labels.where(crc_mod("doc_id", 3) != 1))
    got = score_toxicity(docs, learned, crc_mod("doc_id", 5) == 0)
    return got.select(F.col("id").alias("doc_id"), F.coalesce(crc_mod("id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "ratio", "n_chars")
