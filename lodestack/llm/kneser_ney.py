"""Interpolated modified Kneser-Ney models of characters over sharded count tables.

Contexts run over white space, from the last characters of one word into the next. Counts come from whole texts: every
task sums the n-grams of its blocks, Spark sums them by n-gram. Lower orders, discounts and interpolation are joins and
aggregations over these tables, and so is scoring (see ``blocks``): the model is never collected and never broadcast as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import materialize, tidy
from .blocks import blocks, fold, keys_of, pieces, settled, strings

#: Fixed marks before and after a text; in texts they become another control character.
START, END = "\x02", "\x03"
#: Numbers of a table that windows are looked up in; beyond, a hash table is used. Characters that are worked on at once.
DENSE, SLICE = 1 << 27, 1 << 17
#: Bytes of text whose windows are numbered at once: about 8 bytes a character are held for them.
PIECE = 4 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _rows(matrix: np.ndarray) -> np.ndarray:
    """Hashes of the rows of a matrix of code points."""
    h = np.full(len(matrix), matrix.shape[1] + 1, np.uint64)
    for j in range(matrix.shape[1]):
        h = (h ^ matrix[:, j]) * _MUL
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Grams:
    """The n-grams of a block: ``codes`` has a row of code points per different one, ``ids`` the one that begins at each
    place of all texts behind each other, each text between START marks and END, ``first`` the place where each text begins.

    Windows that begin in one text and end in the next are the ones that end in START; nothing is counted or scored for them.
    """

    codes: np.ndarray
    ids: np.ndarray
    first: np.ndarray

    @property
    def real(self) -> np.ndarray:
        return np.flatnonzero(self.codes[:, -1] != ord(START))


def grams(texts: pa.Array, order: int) -> Grams:
    """Windows are numbered by growing them: the numbers of two neighbours make the key of the longer one."""
    back, parts, length = START * (order - 1), [], []
    known = np.zeros(0x110000, bool)
    for at in range(0, len(texts), 256):
        some = [t or "" for t in texts.slice(at, 256).to_pylist()]
        some = [t.replace(START, "\x01").replace(END, "\x01") if START in t or END in t else t for t in some]
        codes = np.frombuffer("".join([back + t + END for t in some]).encode("utf-32-le"), "<u4")
        known[codes] = True
        parts.append(codes)
        length += [len(t) + order for t in some]
    alphabet = np.flatnonzero(known).astype(np.uint32)
    place = np.zeros(0x110000, np.uint16 if len(alphabet) < 65_536 else np.uint32)
    place[alphabet] = np.arange(len(alphabet))
    parts = [place[p] for p in parts]
    c = np.concatenate(parts) if parts else np.zeros(0, np.uint16)
    del parts
    ids, rows, k = c.astype(np.int32), np.arange(len(alphabet))[:, None], 1
    while k < order:
        # twice as long from two neighbours, or one character longer; later places are read before they change
        by, right = (ids, rows) if 2 * k <= order else (c, np.arange(len(alphabet))[:, None])
        m, n = max(0, len(c) - k - right.shape[1] + 1), max(1, len(right))
        if len(rows) * n <= DENSE:
            seen = np.zeros(len(rows) * n, bool)
            for at in range(0, m, SLICE):
                e = min(m, at + SLICE)
                seen[ids[at:e] * n + by[at + k : e + k]] = True
            number = np.cumsum(seen, dtype=np.int32) - 1
            for at in range(0, m, SLICE):
                e = min(m, at + SLICE)
                ids[at:e] = number[ids[at:e] * n + by[at + k : e + k]]
            new = np.flatnonzero(seen)
        else:
            number, new = pd.factorize(ids[:m].astype(np.int64) * n + by[k : m + k])
            ids[:m] = number
        ids = ids[:m]
        rows = np.concatenate([rows[new // n], right[new % n]], axis=1)
        k = rows.shape[1]
    return Grams(alphabet[rows] if len(alphabet) else np.zeros((0, order), np.uint32), ids, np.r_[0, np.cumsum(length)[:-1]].astype(np.int64) if length else np.zeros(0, np.int64))


def block_counts(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points and counts of a block's distinct n-grams, piece by piece."""
    codes, counts = [np.zeros((0, order), np.uint32)], [np.zeros(0, np.int64)]
    for _, part in pieces(texts, PIECE):
        g = grams(part, order)
        codes.append(g.codes[g.real])
        counts.append(np.bincount(g.ids, minlength=len(g.codes))[g.real])
    every, n = np.concatenate(codes), np.concatenate(counts)
    number, known = pd.factorize(_rows(every))
    first = np.zeros(len(known), np.int64)
    first[number[::-1]] = np.arange(len(every))[::-1]
    return every[first], np.bincount(number, n.astype(float), len(known)).astype(np.int64)


def count_chars(texts: DataFrame, order: int) -> DataFrame:
    """(gram, c) over all rows of ``text``, of every length; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b in blocks(batches):
            codes, n = block_counts(b.column(0), order)
            got = strings(codes)
            for i in range(0, len(got), 50_000):
                yield pa.RecordBatch.from_arrays([got.slice(i, 50_000), pa.array(n[i : i + 50_000])], ["gram", "c"])

    return texts.select("text").mapInArrow(tidy(run), "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame, *columns: str) -> list[list[float]]:
    """D1, D2, D3+ of each column of counts, from its counts of counts; a level too small to tell gets 0.5, 1, 1.5."""
    row = counts.agg(*[F.count_if(F.col(c) == i) for c in columns for i in (1, 2, 3, 4)]).first()
    out = []
    for j in range(len(columns)):
        n = [0, *map(int, row[4 * j : 4 * j + 4])]
        if not all(n[1:]):
            out.append([0.5, 1.0, 1.5])
            continue
        y = n[1] / (n[1] + 2 * n[2])
        out.append([min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.1), k - 0.05) for k in (1, 2, 3)])
    return out


def _discount(counts: DataFrame) -> list[float]:
    return discounts(counts, "c")[0]


def _off(c: Column, d: list[float]) -> Column:
    return F.when(c >= 3, d[2]).when(c == 2, d[1]).when(c == 1, d[0]).otherwise(0.0)


@dataclass
class CharModel:
    """Probabilities ``levels[n]`` (gram, p) and backoff weights ``weights[n]`` (ctx, g) of contexts of n - 1 characters, tables all; ``base`` is the probability of a character never seen."""

    order: int
    levels: dict[int, DataFrame]
    weights: dict[int, DataFrame]
    base: float


def char_model(top: DataFrame, order: int) -> CharModel:
    """The model of counts (gram, c) of the highest order; a lower order counts distinct characters to the left."""
    counts = {order: top.select("gram", "c")}
    for n in range(order - 1, 0, -1):
        counts[n] = materialize(counts[n + 1].groupBy(F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("c")), f"kn{n}")
    base = 1.0 / (counts[1].count() + 1)
    levels: dict[int, DataFrame] = {}
    weights: dict[int, DataFrame] = {}
    for n in range(1, order + 1):
        d = _discount(counts[n])
        c, off = F.col("c"), _off(F.col("c"), d)
        rows = counts[n].withColumn("ctx", F.substring("gram", 1, n - 1))
        by = rows.groupBy("ctx").agg(F.sum("c").alias("t"), F.sum(off).alias("o"))
        weights[n] = materialize(by.select("ctx", "t", (F.col("o") / F.col("t")).alias("g")), f"knw{n}")
        rows = rows.join(weights[n], "ctx")
        if n == 1:
            rows = rows.withColumn("q", F.lit(base))
        else:
            rows = rows.withColumn("rest", F.substring("gram", 2, n - 1)).join(levels[n - 1].select(F.col("gram").alias("rest"), F.col("p").alias("q")), "rest")
        levels[n] = materialize(rows.select("gram", ((c - off) / F.col("t") + F.col("g") * F.col("q")).alias("p")), f"knp{n}")
    return CharModel(order, levels, {n: w.select("ctx", "g") for n, w in weights.items()}, base)


def resolve(wanted: DataFrame, m: CharModel) -> DataFrame:
    """(key, value): the log-probability of the last character of every distinct n-gram ``key``, by one join per level and backoff weight."""
    rows = wanted
    for n in range(m.order, 0, -1):
        at = m.order - n + 1
        level = m.levels[n].select(F.col("gram").alias(f"_g{n}"), F.log("p").alias(f"_v{n}"))
        rows = rows.join(level, F.substring("key", at, n) == F.col(f"_g{n}"), "left").drop(f"_g{n}")
        if n > 1:
            weight = m.weights[n].select(F.col("ctx").alias(f"_c{n}"), F.log("g").alias(f"_b{n}"))
            rows = rows.join(weight, F.substring("key", at, n - 1) == F.col(f"_c{n}"), "left").drop(f"_c{n}")
    # nothing was ever seen: all of the lowest order's backoff
    lowest = m.weights[1].select(F.log("g").alias("g")).first()
    value = F.coalesce("_v1", F.lit((lowest[0] if lowest and lowest[0] is not None else 0.0) + math.log(m.base)))
    for n in range(2, m.order + 1):
        value = F.coalesce(F.col(f"_v{n}"), F.coalesce(f"_b{n}", F.lit(0.0)) + value)
    return rows.select(*wanted.columns, value.cast("float").alias("value"))


def log_likelihoods(rows: DataFrame, m: CharModel) -> DataFrame:
    """(id, log_likelihood, n_chars) of rows (id, text); the end of a text counts as a character, and null is the empty text."""
    return sums(rows, m.order, lambda wanted: resolve(wanted, m), "log_likelihood")


def sums(rows: DataFrame, order: int, found: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """(id, ``name``, n_chars) of rows (id, text): the sum of the values of a text's n-grams, one for each of its characters and its end.

    ``found`` gives (key, value) for a table of distinct n-grams ``key``.
    """

    def keys(texts: pa.Array) -> pa.Array:
        return strings(block_counts(texts, order)[0])

    def score(b: pa.RecordBatch, key: pa.Array, value: np.ndarray) -> tuple:
        texts = b.column(b.num_columns - 1)
        known = _rows(np.frombuffer("".join(key.to_pylist()).encode("utf-32-le"), "<u4").reshape(-1, order))
        way = np.argsort(known)
        known, value = known[way], value[way]
        total, length = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for start, part in pieces(texts, PIECE):
            g = grams(part, order)
            real = g.real
            own = _rows(g.codes[real])
            at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
            if len(own) and not (len(known) and (known[at] == own).all()):
                raise ValueError("a block came back without some of its n-grams: write the rows as a table first")
            log_p = np.zeros(len(g.codes), np.float32)
            log_p[real] = value[at]
            ends = np.r_[g.first[1:], len(g.ids)]
            for s in range(0, len(g.ids), SLICE):  # texts may go on from slice to slice
                e = min(len(g.ids), s + SLICE)
                i, j = np.searchsorted(ends, s, "right"), np.searchsorted(g.first, e, "left")
                total[start + i : start + j] += np.add.reduceat(log_p[g.ids[s:e]].astype(np.float64), np.maximum(g.first[i:j] - s, 0))
            length[start : start + len(part)] = np.diff(np.r_[g.first, len(g.ids) + order - 1]) - order + 1
        return total, length

    rows = settled(rows.select("id", "text"))
    dealt = keys_of(rows, keys).repartition("key")
    # both columns are read on both sides of the join, so that one shuffle serves both
    wanted = dealt.groupBy("key").agg(F.min("block").alias("_any"))
    values = dealt.join(found(wanted), "key").select("block", "key", F.when(F.col("_any").isNotNull(), F.col("value")).alias("value"))
    return fold(rows, lambda b: b, values, score, f"{name} double, n_chars long")
