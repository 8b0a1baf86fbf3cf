"""Hybrid retrieval: filtered dense top-k and keyword ranking, fusion, expansion to chunks, reranking, pruning, de-duplication."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine, present, tokens
from ..storage import materialize
from .ranking import global_rank

# Candidates by mode and for plain search, least pool and most candidates to rerank, share kept, fusion constant.
DENSE_K = {"precision": 40, "recall": 100}
SEARCH_K = 25
POOL, MOST = 50, 1000
KEPT = 0.50
RRF_K = 60


@dataclass(frozen=True)
class Filters:
    """Metadata conditions; empty ones don't count. Tags match if any does."""

    correspondent: str | None = None
    document_type: str | None = None
    storage_path: str | None = None
    tags: Sequence[str] = field(default_factory=tuple)
    year: int | str | None = None

    def predicate(self) -> Column | None:
        """The conjunction, or null if nothing is asked for; every part is a plain comparison that scans can push down."""
        named = {"correspondent": self.correspondent, "document_type": self.document_type, "storage_path": self.storage_path, "year": str(self.year) if self.year else None}
        parts = [F.col(c) == v for c, v in named.items() if v]
        if self.tags:
            parts.append(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in self.tags])))
        out = None
        for p in parts:
            out = p if out is None else out & p
        return out


def filtered(rows: DataFrame, filters: Filters | None) -> DataFrame:
    p = filters.predicate() if filters else None
    return rows if p is None else rows.where(p)


def chunks_of(chunks: DataFrame, doc_ids: DataFrame, filters: Filters | None = None) -> DataFrame:
    """Stored chunks of some documents that pass the filters; rows without a document are dropped."""
    return filtered(chunks.where("doc_id IS NOT NULL"), filters).join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")


def resolve_names(dim: DataFrame, id_col: str, name_col: str, names: Sequence[str]) -> list[int] | None:
    """Ids of exact names, in their order; None if any is unknown. Of equal names the smallest id is taken."""
    found = {r[0]: r[1] for r in dim.where(F.col(name_col).isin(*names)).groupBy(name_col).agg(F.min(id_col)).collect()}
    return [found[n] for n in names] if all(n in found for n in names) else None


def dense(chunks: DataFrame, query: Sequence[float], k: int, filters: Filters | None = None, vector: str = "embedding") -> DataFrame:
    """The k chunks most similar to a query, with ``score`` and a 1-based ``pos``; ties by document and chunk. Vectors without a similarity come last."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = filtered(chunks.where("doc_id IS NOT NULL"), filters).withColumn("score", F.nanvl(cosine(F.col(vector), q), F.lit(None).cast("double")))
    order = [F.desc_nulls_last("score"), "doc_id", "chunk_index"]
    # at most k rows are left here, so one task numbers them
    return rows.orderBy(*order).limit(k).withColumn("pos", F.row_number().over(Window.orderBy(*order)))


def terms(c: Column | str) -> Column:
    """Search terms: lower-cased runs of letters, digits and underscores."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def _count(array: str, value: str) -> Column:
    return F.size(F.filter(array, lambda x: x == value))


def keyword(docs: DataFrame, query: Sequence[str], text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 of the documents with a query term: the id and ``bm25``. Statistics cover all documents.

    Term counts are read off each row in one scan of the texts, so no token is shuffled; a narrow table
    of counts then gives the statistics and the scores.
    """
    asked = list(dict.fromkeys(query))
    rows = docs.select("doc_id", terms(text).alias("t")).select("doc_id", F.size("t").alias("dl"), *[_count("t", q).alias(f"tf{i}") for i, q in enumerate(asked)])
    rows = materialize(rows, "terms")
    stats = rows.agg(F.count("*"), F.avg("dl"), *[F.count_if(F.col(f"tf{i}") > 0) for i in range(len(asked))]).first()
    n, mean = stats[0], stats[1] or 1.0
    score = F.lit(0.0)
    for i in range(len(asked)):
        idf = F.log(F.lit(1.0) + (n - stats[2 + i] + 0.5) / (stats[2 + i] + 0.5))
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / mean))
    some = F.lit(False)
    for i in range(len(asked)):
        some = some | (F.col(f"tf{i}") > 0)
    return rows.where(some).select("doc_id", score.alias("bm25"))


def first_by_doc(rows: DataFrame, pos: str = "pos", keep: Sequence[str] = ()) -> DataFrame:
    """The first row of each document by ``pos``: one aggregation, no sort of groups."""
    cols = [pos, *keep]
    return rows.groupBy("doc_id").agg(F.min(F.struct(*cols)).alias("r")).select("doc_id", *[F.col(f"r.{c}") for c in cols])


def dense_doc_ranks(dense_rows: DataFrame) -> DataFrame:
    """(doc_id, dense_rank) of a dense result: a document ranks by its best chunk, among documents."""
    return first_by_doc(dense_rows).withColumn("dense_rank", F.row_number().over(Window.orderBy("pos"))).select("doc_id", "dense_rank")


def keyword_ranks(scored: DataFrame) -> DataFrame:
    return global_rank(scored, [F.desc("bm25"), F.col("doc_id")], "kw_rank").select("doc_id", "kw_rank")


def rrf(dense_ranks: DataFrame, kw_ranks: DataFrame, k: int = RRF_K) -> DataFrame:
    """(doc_id, rrf, dense_rank, kw_rank): reciprocal ranks summed over both lists."""
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return dense_ranks.join(kw_ranks, "doc_id", "full_outer").withColumn("rrf", part("dense_rank") + part("kw_rank"))


#: Order of fused documents: ties keep the dense order, then the keyword order.
FUSED = [F.desc, F.asc_nulls_last, F.asc_nulls_last]


def fused_order() -> list[Column]:
    return [f(c) for f, c in zip(FUSED, ("rrf", "dense_rank", "kw_rank"), strict=True)]


def expand(fused: DataFrame, dense_rows: DataFrame, chunks: DataFrame, filters: Filters | None, most: int) -> DataFrame:
    """Chunks to rerank, numbered by ``pos``: retrieved chunks of dense documents and all stored ones of the others, by rank of the document."""
    only = fused.where("dense_rank IS NULL")
    side = lambda df, i, pos: df.select("doc_id", "chunk_index", "text", F.lit(i).alias("side"), F.col(pos).cast("long").alias("at"))
    rows = side(dense_rows, 0, "pos").unionByName(side(chunks_of(chunks, only, filters), 1, "chunk_index"))
    order = ["doc_rank", "side", "at", "chunk_index"]
    got = rows.join(fused.select("doc_id", "doc_rank"), "doc_id").orderBy(*order).limit(most)
    return got.withColumn("pos", F.row_number().over(Window.orderBy(*order)))


def rerank(candidates: DataFrame, scorer: Column | None) -> DataFrame:
    """Candidates by falling score, ties as before; without a scorer (or where it failed) the order stays."""
    score = F.lit(0.0) if scorer is None else scorer
    rows = candidates.withColumn("rerank_score", score)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("rerank_score"), "pos")))


def prune(ranked: DataFrame, share: float = KEPT) -> DataFrame:
    """The better half of the candidates, at least one."""
    n = F.count("*").over(Window.partitionBy())
    keep = F.greatest(F.lit(1), F.floor(n * share))
    return ranked.withColumn("_keep", keep).where(F.col("place") <= F.col("_keep")).drop("_keep")


def documents_of(ranked: DataFrame) -> DataFrame:
    """(doc_id, text, rank): each document once, where its best chunk stands."""
    first = first_by_doc(ranked, "place", ["text"])
    return first.withColumn("rank", F.row_number().over(Window.orderBy("place"))).select("doc_id", "text", "rank")


def pool_size(limit: int) -> int:
    """Candidates to rerank for a result of ``limit``."""
    return min(MOST, max(1, max(limit, POOL)))


def with_payload(hits: DataFrame, payloads: DataFrame, text: str = "text") -> DataFrame:
    """Hits with the payload that the store returns first for their document; the best chunk stands in where there is none."""
    first = first_by_doc(payloads, "chunk_index", [c for c in payloads.columns if c not in ("doc_id", "chunk_index", "embedding")])
    stored = first.select("doc_id", *[F.col(c).alias(f"p_{c}") for c in first.columns if c not in ("doc_id", "chunk_index")])
    return hits.join(stored, "doc_id", "left").withColumn("shown", F.coalesce(present(F.col(f"p_{text}")), F.col(text)))


@dataclass
class HybridSearch:
    """Search over chunks (doc_id, chunk_index, text, embedding, and what filters read) and documents (doc_id, text).

    With ``vectors`` (a ``vector_index.VectorIndex`` of the chunks) the dense side reads the nearest cells only, and with ``postings`` (a ``postings.Postings``
    of the documents) the keyword side reads the postings of the query's terms in place of all texts: all of them, or with ``pages`` what the best so many demand.
    """

    chunks: DataFrame
    docs: DataFrame
    embed: Callable[[str], Sequence[float]]
    scorer: Callable[[str], Column | None] = lambda query: None
    judge: Callable[[str, list[int]], list[int]] | None = None
    vectors: Any = None
    postings: Any = None
    probes: int | None = None
    pages: int | None = None

    def _keyword(self, asked: list[str], filters: Filters | None) -> DataFrame:
        if self.postings is None:
            return keyword(filtered(self.docs, filters), asked)
        only = filtered(self.docs, filters).select("doc_id") if filters and filters.predicate() is not None else None
        return self.postings.top(asked, self.pages, only) if self.pages else self.postings.scores(asked, only)

    def candidates(self, query: str, filters: Filters | None, k: int, most: int) -> tuple[DataFrame, DataFrame]:
        """Fused documents with ``doc_rank``, and the chunks to rerank."""
        # a bounded result, used three times
        found = dense(self.chunks, self.embed(query), k, filters) if self.vectors is None else self.vectors.dense(self.embed(query), k, filters, self.probes)
        found = self.docs.sparkSession.createDataFrame(found.collect(), found.schema)
        asked = self.docs.sparkSession.range(1).select(terms(F.lit(query)).alias("t")).first()[0]
        scored = self._keyword(asked, filters) if asked else None
        kw = keyword_ranks(scored) if scored is not None else self.docs.select("doc_id", F.lit(0).alias("kw_rank")).limit(0)
        fused = global_rank(rrf(dense_doc_ranks(found), kw), fused_order(), "doc_rank")
        return fused, expand(fused, found, self.chunks, filters, most)

    def search(self, query: str, filters: Filters | None = None, mode: str = "precision", limit: int | None = 20) -> DataFrame:
        """(doc_id, text, rank) of the best documents. Precision prunes, and judges if there is a judge; recall needs a limit."""
        if not query:
            raise ValueError("an empty query")
        if mode not in DENSE_K:
            raise ValueError(f"mode must be one of {sorted(DENSE_K)}")
        if limit is None:
            if mode == "recall":
                raise ValueError("recall needs a limit")
            limit = 20
        if not 1 <= limit <= 100:
            raise ValueError("limit must be from 1 to 100")
        fused, rows = self.candidates(query, filters, DENSE_K[mode], pool_size(limit))
        if rows.isEmpty():  # no document has a chunk: the fused order stands
            return fused.orderBy("doc_rank").limit(limit).select("doc_id", F.lit(None).cast("string").alias("text"), F.col("doc_rank").alias("rank"))
        ranked = rerank(rows, self.scorer(query))
        got = documents_of(prune(ranked) if mode == "precision" else ranked)
        if self.judge and mode == "precision":
            kept = self.judge(query, [r[0] for r in got.orderBy("rank").select("doc_id").collect()])
            order = got.sparkSession.createDataFrame(list(enumerate(kept, 1)), "rank int, doc_id long")
            got = got.drop("rank").join(order, "doc_id")
        return got.orderBy("rank").limit(limit)


def overlap_scorer(query: str) -> Column:
    """Deterministic stand-in for a cross-encoder: share of the query's distinct words in the passage."""
    q = list(dict.fromkeys(query.lower().split()))
    asked = F.array(*[F.lit(w) for w in q]) if q else F.array().cast("array<string>")
    return F.size(F.array_intersect(asked, tokens(F.lower(F.col("text"))))) / F.lit(float(max(1, len(q))))


def batches(ids: Sequence[int], n: int = 5) -> list[list[int]]:
    return [list(ids[i : i + n]) for i in range(0, len(ids), n)]


def judge_in_batches(query: str, ids: Sequence[int], keep: Callable[[str, list[int]], list[int]], n: int = 5) -> list[int]:
    """Ids that a judge keeps, batch by batch, in its order; ids outside a batch are ignored, and a failed batch is kept whole."""
    out: list[int] = []
    for batch in batches(ids, n):
        try:
            answer = [int(i) for i in keep(query, batch)]
        except Exception:  # whatever a model's client raises: the batch stays
            out += batch
        else:
            out += [i for i in answer if i in set(batch)]
    return out
