"""Queries of hybrid retrieval, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators import vector_index as V
from ..operators.postings import Postings
from ..sources.tables import table
from .text_queries import SQL, query

#: Terms of the keyword part and the row whose vector is the dense query.
TERMS = ("the", "and", "entreau", "vermit", "tion")
K = 25


def chunks(spark, d) -> DataFrame:
    """Embeddings as chunks: the vector's id is the document's, so fusion has documents that both sides know."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("chunk_index"), F.col("label").cast("string").alias("correspondent"), F.concat(F.lit("chunk "), F.col("vec_id").cast("string")).alias("text"), "embedding")


def labelled_chunks(spark, d) -> DataFrame:
    """Embeddings as chunks of ten documents, the labels."""
    return table(spark, d, "embeddings").select(F.col("label").cast("long").alias("doc_id"), F.col("vec_id").alias("chunk_index"), F.lit("x").alias("text"), "embedding")


def probe(spark, d) -> list[float]:
    return list(table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"])


_DENSE = """q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0),
  s AS (SELECT vec_id, label, list_dot_product(CAST(embedding AS DOUBLE[]), q.v) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(q.v, q.v))) AS score FROM embeddings, q)"""


@query("q_dense_topk", f"WITH {_DENSE} SELECT vec_id AS doc_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT {K}")
def dense_topk(spark, d) -> DataFrame:
    return R.dense(chunks(spark, d), probe(spark, d), K).select("doc_id", F.round("score", 6).alias("score"))


@query("q_dense_topk_filtered", f"WITH {_DENSE} SELECT vec_id AS doc_id, round(score, 6) AS score FROM s WHERE label = 3 ORDER BY s.score DESC, vec_id LIMIT {K}")
def dense_filtered(spark, d) -> DataFrame:
    return R.dense(chunks(spark, d), probe(spark, d), K, R.Filters(correspondent="3")).select("doc_id", F.round("score", 6).alias("score"))


@query(
    "q_doc_dedup",
    f"""WITH {_DENSE}, t AS (SELECT label, vec_id, score, row_number() OVER (ORDER BY score DESC, label, vec_id) AS pos FROM s ORDER BY pos LIMIT 40),
        m AS (SELECT label, min(pos) AS pos FROM t GROUP BY label)
        SELECT CAST(label AS BIGINT) AS doc_id, CAST(row_number() OVER (ORDER BY pos) AS INTEGER) AS dense_rank FROM m""",
)
def doc_dedup(spark, d) -> DataFrame:
    return R.dense_doc_ranks(R.dense(labelled_chunks(spark, d), probe(spark, d), 40))


_TF = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(TERMS))
_STATS = ", ".join(f"sum(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END) AS df{i}" for i in range(len(TERMS)))
_SCORE = " + ".join(f"ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))" for i in range(len(TERMS)))
_BM25 = rf"""tok AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '') AS t FROM documents),
  tf AS (SELECT doc_id, len(t) AS dl, {_TF} FROM tok), st AS (SELECT count(*) AS n, avg(dl) AS mean, {_STATS} FROM tf),
  kw AS (SELECT doc_id, {_SCORE} AS bm25 FROM tf, st WHERE {' OR '.join(f'tf{i} > 0' for i in range(len(TERMS)))})"""


@query("q_keyword_bm25", f"WITH {_BM25} SELECT doc_id, round(bm25, 6) AS bm25 FROM kw")
def keyword_bm25(spark, d) -> DataFrame:
    return R.keyword(table(spark, d, "documents"), TERMS).select("doc_id", F.round("bm25", 6).alias("bm25"))


_FUSED = f"""{_DENSE}, {_BM25}, dr AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) AS dense_rank FROM s QUALIFY dense_rank <= {K}),
  kr AS (SELECT doc_id, row_number() OVER (ORDER BY round(bm25, 9) DESC, doc_id) AS kw_rank FROM kw),
  f AS (SELECT doc_id, coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + kw_rank), 0) AS rrf, dense_rank, kw_rank FROM dr FULL OUTER JOIN kr USING (doc_id)),
  fr AS (SELECT *, row_number() OVER (ORDER BY rrf DESC, dense_rank NULLS LAST, kw_rank NULLS LAST) AS doc_rank FROM f)"""


def _fused(spark, d) -> tuple[DataFrame, DataFrame]:
    found = R.dense(chunks(spark, d), probe(spark, d), K)
    scored = R.keyword(table(spark, d, "documents"), TERMS).withColumn("bm25", F.round("bm25", 9))
    fused = R.rrf(R.dense_doc_ranks(found), R.keyword_ranks(scored))
    return R.global_rank(fused, R.fused_order(), "doc_rank"), found


@query("q_rrf_fuse", f"WITH {_FUSED} SELECT doc_id, round(rrf, 6) AS rrf, doc_rank FROM fr")
def rrf_fuse(spark, d) -> DataFrame:
    return _fused(spark, d)[0].select("doc_id", F.round("rrf", 6).alias("rrf"), "doc_rank")


_EXPAND = f"""{_FUSED}, c AS (SELECT fr.doc_id, CASE WHEN dense_rank IS NULL THEN 1 ELSE 0 END AS side, doc_rank FROM fr JOIN embeddings e ON fr.doc_id = e.vec_id ORDER BY doc_rank LIMIT 50),
  p AS (SELECT doc_id, side, CAST(row_number() OVER (ORDER BY doc_rank) AS INTEGER) AS pos FROM c)"""


def _expanded(spark, d) -> DataFrame:
    fused, found = _fused(spark, d)
    return R.expand(fused, found, chunks(spark, d), None, R.pool_size(20))


@query("q_hybrid_expand", f"WITH {_EXPAND} SELECT doc_id, side, pos FROM p")
def hybrid_expand(spark, d) -> DataFrame:
    return _expanded(spark, d).select("doc_id", "side", "pos")


_RANKED = f"{_EXPAND}, k AS (SELECT doc_id, pos, CAST(row_number() OVER (ORDER BY (doc_id * 7919) % 101 DESC, pos) AS INTEGER) AS place FROM p), kept AS (SELECT * FROM k WHERE place <= greatest(1, (SELECT count(*) FROM k) // 2))"


def _pruned(spark, d) -> DataFrame:
    # a stand-in for the reranker that any engine computes alike
    return R.prune(R.rerank(_expanded(spark, d), (F.col("doc_id") * 7919 % 101).cast("double")))


@query("q_precision_prune", f"WITH {_RANKED} SELECT doc_id, place FROM kept")
def precision_prune(spark, d) -> DataFrame:
    return _pruned(spark, d).select("doc_id", "place")


@query("q_hybrid_search", f"WITH {_RANKED} SELECT doc_id, CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS rank FROM kept ORDER BY place LIMIT 20")
def hybrid_search(spark, d) -> DataFrame:
    return R.documents_of(_pruned(spark, d)).select("doc_id", "rank").orderBy("rank").limit(20)


@query(
    "q_hit_payload",
    "WITH h AS (SELECT DISTINCT CAST(label AS BIGINT) AS doc_id FROM embeddings), p AS (SELECT CAST(label AS BIGINT) AS doc_id, min(vec_id) AS v FROM embeddings WHERE label % 3 <> 0 GROUP BY label) SELECT doc_id, coalesce('payload ' || v, 'best chunk') AS shown FROM h LEFT JOIN p USING (doc_id)",
)
def hit_payload(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("doc_id"), F.col("vec_id").alias("chunk_index"))
    hits = e.select("doc_id").distinct().withColumn("text", F.lit("best chunk"))
    payloads = e.where("doc_id % 3 <> 0").withColumn("text", F.concat(F.lit("payload "), F.col("chunk_index").cast("string")))
    return R.with_payload(hits, payloads).select("doc_id", "shown")


# --- indexes -----------------------------------------------------------------------------------------------------------


@query("q_ann_exact", SQL["q_dense_topk"])
def ann_exact(spark, d) -> DataFrame:
    """The inverted file with all cells probed is the exact search."""
    index = V.build(chunks(spark, d), probes=1)
    return index.dense(probe(spark, d), K, probes=len(index.cells)).select("doc_id", F.round("score", 6).alias("score"))


@query(
    "q_ann_recall",
    f"SELECT count(*) AS queries, CAST(count(*) * {K} AS BIGINT) AS neighbours, true AS enough FROM embeddings WHERE vec_id % 20 = 0",
)
def ann_recall(spark, d) -> DataFrame:
    """Whether the cells probed by default hold 0.9 of the true neighbours of every twentieth vector, among all others."""
    rows = chunks(spark, d)
    index = V.build(rows)
    asked = rows.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector"))
    exact = V.exact_search(rows, asked, K, index.centroids.shape[1], others=True)
    hit = exact.join(index.search(asked, K, others=True).select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    share = F.count("hit") / F.count("*")
    return hit.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("neighbours"), (share >= 0.9).alias("enough"))


@query("q_keyword_postings", f"WITH {_BM25} SELECT doc_id, round(bm25, 6) AS bm25 FROM kw ORDER BY round(kw.bm25, 9) DESC, doc_id LIMIT 1000")
def keyword_postings(spark, d) -> DataFrame:
    return Postings.build(table(spark, d, "documents")).top(TERMS, 1000).select("doc_id", F.round("bm25", 6).alias("bm25"))


_CHANGED = "(SELECT doc_id, CASE lang WHEN 'de' THEN concat('the entreau vermit ', text) ELSE text END AS text FROM documents WHERE lang <> 'fr')"


@query("q_keyword_updated", f"WITH {_BM25.replace('FROM documents', f'FROM {_CHANGED}', 1)} SELECT doc_id, round(bm25, 6) AS bm25 FROM kw ORDER BY round(kw.bm25, 9) DESC, doc_id LIMIT 1000")
def keyword_updated(spark, d) -> DataFrame:
    """The index after documents of one language were replaced and those of another deleted, against the tables as they are then."""
    docs = table(spark, d, "documents")
    index = Postings.build(docs)
    index.add(docs.where("lang = 'de'").select("doc_id", F.concat(F.lit("the entreau vermit "), "text").alias("text")))
    index.delete(docs.where("lang = 'fr'"))
    return index.top(TERMS, 1000).select("doc_id", F.round("bm25", 6).alias("bm25"))


@query("q_hybrid_indexed", SQL["q_hybrid_search"].replace(f"dense_rank <= {K}", f"dense_rank <= {R.DENSE_K['precision']}"))
def hybrid_indexed(spark, d) -> DataFrame:
    """Search through both indexes; all cells are probed, so that the result is the exact one."""
    rows, docs = chunks(spark, d), table(spark, d, "documents")
    index = V.build(rows, probes=1)
    scorer = lambda q: (F.col("doc_id") * 7919 % 101).cast("double")
    search = R.HybridSearch(rows, docs, lambda q: probe(spark, d), scorer, vectors=index, postings=Postings.build(docs), probes=len(index.cells))
    return search.search(" ".join(TERMS)).select("doc_id", "rank")
