"""Exact top-k by inner product: no-random-access aggregation over one list of values per vector component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import need

QUERY_BLOCK, BLOCK = 8_192, 8_192
#: Bounds are compared after half of the lists and then after every so many.
STEP = 4


def _narrow(m: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them; beyond a long nothing does."""
    top = float(np.abs(m).max(initial=0))
    if not top < 2.0**63:
        raise OverflowError("floor(64 x) of a component is over a long")
    return m.astype(np.int8 if top < 128 else np.int16 if top < 2**15 else np.int64)


def _pack(keyed: bool):
    """Rows (q, id, vector), sorted by q, to rows (q, n, kind, ids, matrix): a block per q, or blocks of BLOCK rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(q: int, ids: list, rows: list) -> pa.RecordBatch:
            wide = max(map(len, rows))
            m = np.zeros((len(rows), wide))
            for i, r in enumerate(rows):  # shorter vectors count as padded with zeros
                m[i, : len(r)] = r
            m = _narrow(np.floor(64.0 * m))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((q, pa.int64()), (len(rows), pa.int64()), (m.dtype.str, pa.string()), (np.array(ids, np.int64).tobytes(), pa.binary()), (m.tobytes(), pa.binary()))], ["q", "n", "kind", "ids", "matrix"])

        last, ids, rows = None, [], []
        for b in batches:
            vectors = b.column(2)
            flat, off = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            for i, (q, key) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if rows and (q != last if keyed else len(rows) >= BLOCK):
                    yield out(last, ids, rows)
                    ids, rows = [], []
                last = q
                ids.append(key)
                rows.append(flat[off[i] : off[i + 1]].astype(np.float64))
        if rows:
            yield out(last, ids, rows)

    return run


def _matrix(kind: str, n: int, raw: bytes, wide: int) -> np.ndarray:
    m = np.frombuffer(raw, kind).reshape(n, -1)
    return np.pad(m, ((0, 0), (0, wide - m.shape[1]))) if m.shape[1] < wide else m


def _exact(x: np.ndarray, q: np.ndarray) -> type:
    """The fastest type in which all scores and bounds are exact."""
    bound = max(1, x.shape[1]) * int(np.abs(x.astype(object)).max(initial=0)) * int(np.abs(q.astype(object)).max(initial=0))
    return np.float32 if bound < 2**22 else np.float64 if bound < 2**51 else object


def no_random_access(x: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, held: list, k: int) -> int:
    """Bring ``held``, the best (scores, ids) of each query so far, up to date with the vectors of one block; returns the values read.

    Every component is a list over the vectors. A query reads lists one after the other, those first in which its
    scores can differ most. A score lies between what is read plus the worst ends of the unread lists and what is read plus
    their best ends. Vectors whose upper bound is under the k-th best lower bound, or under the k-th score of
    earlier blocks, can't qualify and are read no further; what is left at the end has its final scores.
    """
    kind = _exact(x, q)
    lists = np.ascontiguousarray(x.T.astype(kind) if kind is not object else x.T.astype(object))
    q = q.astype(kind)
    d, n = lists.shape
    least, most = (lists.min(axis=1), lists.max(axis=1)) if n else (np.zeros(d, kind), np.zeros(d, kind))
    own = {}
    for i, v in enumerate(ids.tolist()):
        own.setdefault(v, []).append(i)
    checks = {d // 2, d, *range(d // 2, d, STEP)} - {0} or {d}
    steps = sorted(checks)
    read = 0
    for j, w in enumerate(q):
        way = np.argsort(-np.abs(w * (most - least)).astype(float), kind="stable")
        a, b = w[way] * least[way], w[way] * most[way]
        worst, best = (np.append(np.cumsum(np.where(a < b, x, y)[::-1])[::-1], 0) for x, y in ((a, b), (b, a)))
        floor = held[j][0][-1] if len(held[j][0]) >= k else -np.inf
        left, at = None, 0
        score = np.zeros(n, kind)
        score[own.get(int(qids[j]), [])] = -np.inf
        for upto in steps:
            o = way[at:upto]
            score = score + w[o] @ (lists[o] if left is None else lists[np.ix_(o, left)])
            read += len(o) * len(score)
            at = upto
            if len(score) > k:
                floor = max(floor, np.partition(score, len(score) - k)[len(score) - k] + worst[at])
            keep = np.flatnonzero(score + best[at] >= floor)
            if 2 * len(keep) < len(score) or upto == d:
                left, score = (keep if left is None else left[keep]), score[keep]
                if not len(left):
                    break
        if left is None or not len(left):
            continue
        real = score != -np.inf
        s, v = np.concatenate([held[j][0], score[real]]), np.concatenate([held[j][1], ids[left[real]]])
        order = np.lexsort((v, -s)) if s.dtype != object else np.array(sorted(range(len(s)), key=lambda r: (-s[r], v[r])), np.int64)
        held[j] = s[order[:k]], v[order[:k]]
    return read


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["query_id", "vec_id", "score"]
        last, qids, q, held = None, None, None, []

        def out() -> pa.RecordBatch:
            rows = [(i, v, s) for i, (ss, vs) in zip(qids.tolist(), held, strict=True) for s, v in zip(ss.tolist(), vs.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([int(r[c]) for r in rows], pa.int64()) for c in range(3)], names)

        for b in batches:
            for r in b.to_pylist():
                if r["q"] != last:
                    if last is not None:
                        yield out()
                    last, qids = r["q"], np.frombuffer(r["q_ids"], np.int64)
                    q = _matrix(r["q_kind"], r["q_n"], r["q_matrix"], 0)
                    held = [(np.empty(0), np.empty(0, np.int64))] * r["q_n"]
                x = _matrix(r["kind"], r["n"], r["matrix"], q.shape[1])
                wide = max(x.shape[1], q.shape[1])
                no_random_access(x, np.frombuffer(r["ids"], np.int64), np.pad(q, ((0, 0), (0, wide - q.shape[1]))), qids, held, k)
        if last is not None:
            yield out()

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query among all rows of ``vectors``.

    Components become floor(64 x). Rows with a null id, a null vector or a null or non-finite component take no part, empty
    vectors neither; shorter vectors count as padded with zeros. Ties go to the smaller id. Rows that have the
    query's id are its own; of queries with one id the smallest vector is taken. Blocks of queries meet blocks
    of vectors by an equi-join on (query block, salt), so every task holds one block of each and one list of k per query. A
    scaled component or a score over a long raises.
    """
    need(vectors, id_col, vector_col)
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND size(v) > 0")
        return rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))

    asked = clean(queries).groupBy("id").agg(F.min("v").alias("v"))
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    salts = max(1, -(-2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // n_blocks))
    schema = "q long, n long, kind string, ids binary, matrix binary"
    q = asked.select(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("q"), "id", "v").repartition("q").sortWithinPartitions("q").mapInArrow(_pack(True), schema)
    q = q.select("q", *[F.col(c).alias(f"q_{c}") for c in ("n", "kind", "ids", "matrix")], F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    x = clean(vectors).select(F.lit(0).cast("long").alias("q"), "id", "v").mapInArrow(_pack(False), schema).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
    x = x.drop("q").withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<bigint>")))
    met = x.join(q, ["q", "salt"]).sortWithinPartitions("q", "salt")
    found = met.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark, sf_dir: str) -> DataFrame:
    """``top_k`` of the vectors whose id is divisible by 20, against all; nulls, ties and repeated rows as there."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, rows.where("vec_id % 20 = 0"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
