"""The processing stages as micro-batch steps over tables: OCR, metadata, embedding, refresh, and routing between them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bounded_context, clean_title, move_tag, page_selection, plausible_date, strip
from ..storage import materialize
from .chunk_store import ChunkStore
from .chunks import PAYLOAD, Hook, points, refresh_payload, replace_documents, situate_with
from .models import Embedder, Extractor, PageReader, embed_chunks, extract_metadata, read_pages
from .queues import outcomes


@dataclass
class StageResult:
    """Changed tables and, per document of the batch, what happened: ok is true, false or null (skipped).

    A document that fails keeps its row, its tags and its chunks, and has a row in ``errors`` (doc_id, error).
    """

    docs: DataFrame
    results: DataFrame
    index: DataFrame | None = None
    errors: DataFrame | None = None

    def counts(self) -> DataFrame:
        return outcomes(self.results)


def known(batch: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents of a batch of ids, and ids without one, which leave the queue with neither outcome."""
    return docs.join(batch.select("doc_id").distinct(), "doc_id", "left_semi"), batch.join(docs.select("doc_id"), "doc_id", "left_anti")


def blank(c: str) -> Column:
    return strip(F.coalesce(F.col(c), F.lit(""))) == ""


def ocr_stage(batch: DataFrame, docs: DataFrame, pages: DataFrame, reader: Callable[[], PageReader], tag: int, next_tag: int, threshold: int = 40, first: int = 20, last: int = 20) -> StageResult:
    """Texts of the selected pages written together with the tag transition; documents whose pages can't be read fail."""
    mine, gone = known(batch, docs)
    totals = pages.groupBy("doc_id").agg((F.max("page") + 1).alias("total"))
    wanted = totals.select("doc_id", F.explode(page_selection(F.col("total"), threshold, first, last)).alias("page"))
    picked = pages.join(mine.select("doc_id"), "doc_id", "left_semi").join(wanted, ["doc_id", "page"])
    # written, so that documents and outcomes tell of the same run of the model
    texts = materialize(read_pages(picked, reader).withColumnRenamed("text", "_text"), "texts")
    done = mine.select("doc_id").join(texts, "doc_id", "left")
    new = docs.join(done.where("_text IS NOT NULL").select("doc_id", "_text"), "doc_id", "left")
    hit = F.col("_text").isNotNull()
    new = new.select(*[F.coalesce("_text", "text").alias("text") if c == "text" else F.when(hit, move_tag(F.col("tags"), F.lit(tag), F.lit(next_tag))).otherwise(F.col("tags")).alias("tags") if c == "tags" else F.col(c) for c in docs.columns])
    results = done.select("doc_id", F.col("_text").isNotNull().alias("ok")).unionByName(gone.select("doc_id", F.lit(None).cast("boolean").alias("ok")))
    errors = done.where("_text IS NULL").select("doc_id", F.coalesce("error", F.lit("no pages")).alias("error"))
    return StageResult(new, results, errors=errors)


def metadata_stage(batch: DataFrame, docs: DataFrame, extractor: Callable[[], Extractor], today: Column, tag: int, next_tag: int, model: str = "stand-in") -> StageResult:
    """Titles and plausible dates from bounded contexts, written with the tag transition; blank documents are skipped, and those whose extraction raises fail."""
    mine, gone = known(batch, docs)
    readable = mine.where(~blank("text"))
    said = materialize(extract_metadata(readable.select("doc_id", bounded_context("text").alias("text")), extractor, model), "metadata")
    got = said.where("error IS NULL").select("doc_id", clean_title("title").alias("_title"), plausible_date(F.col("date").cast("string"), today).alias("_date"), F.col("correspondent").alias("_sender"), F.col("summary").alias("_summary"), F.lit(True).alias("_hit"))
    new = docs.join(got, "doc_id", "left")
    put = {"title": F.coalesce("_title", "title"), "created": F.coalesce("_date", "created"), "tags": F.when(F.col("_hit"), move_tag(F.col("tags"), F.lit(tag), F.lit(next_tag))).otherwise(F.col("tags"))}
    new = new.select(*[put[c].alias(c) if c in put else F.col(c) for c in docs.columns], F.col("_sender").alias("found_sender"), F.col("_summary").alias("found_summary"))
    skipped = mine.where(blank("text")).select("doc_id").unionByName(gone.select("doc_id")).withColumn("ok", F.lit(None).cast("boolean"))
    return StageResult(new, said.select("doc_id", F.col("error").isNull().alias("ok")).unionByName(skipped), errors=said.where("error IS NOT NULL").select("doc_id", "error"))


def embed_stage(batch: DataFrame, docs: DataFrame, index: DataFrame | ChunkStore, embedder: Callable[[], Embedder], hook: Hook | None = None, tag: int | None = None) -> StageResult:
    """Delete a document's chunks, then insert the new ones; blank documents lose their chunks and still succeed. A store is updated in place.

    A document of which a chunk can't be embedded fails and keeps the chunks it had. ``tag`` is taken off documents that succeed.
    """
    mine, gone = known(batch, docs)
    chunks = situate_with(mine, hook)
    if hook is not None:  # a hook runs once, so that what is stored is what was embedded
        chunks = materialize(chunks, "chunks")
    vectors = materialize(embed_chunks(chunks, embedder), "vectors")
    errors = vectors.where("error IS NOT NULL").groupBy("doc_id").agg(F.min_by("error", "chunk_index").alias("error"))
    good = mine.select("doc_id").join(errors, "doc_id", "left_anti")
    new = points(chunks, vectors.drop("error")).join(errors, "doc_id", "left_anti")
    ok = mine.select("doc_id").join(errors, "doc_id", "left").select("doc_id", F.col("error").isNull().alias("ok"))
    ok = ok.unionByName(gone.select("doc_id", F.lit(None).cast("boolean").alias("ok")))
    if tag is not None:
        marked = docs.join(good.select("doc_id", F.lit(True).alias("_good")), "doc_id", "left")
        docs = marked.select(*[F.when(F.col("_good"), F.array_remove("tags", F.lit(tag))).otherwise(F.col("tags")).alias("tags") if c == "tags" else F.col(c) for c in docs.columns])
    if isinstance(index, ChunkStore):
        index.replace(new, good)
        return StageResult(docs, ok, index.rows(), errors)
    return StageResult(docs, ok, replace_documents(index, new.select(*[c for c in new.columns if c in index.columns]), good), errors)


def refresh_stage(batch: DataFrame, docs: DataFrame, index: DataFrame | ChunkStore) -> StageResult:
    """Payload columns of a document's chunks brought up to date without embedding anything. A store is updated in place."""
    mine, gone = known(batch, docs)
    ok = mine.select("doc_id", F.lit(True).alias("ok")).unionByName(gone.select("doc_id", F.lit(None).cast("boolean").alias("ok")))
    held = index.rows() if isinstance(index, ChunkStore) else index
    columns = tuple(c for c in PAYLOAD if c in docs.columns and c in held.columns)
    if isinstance(index, ChunkStore):
        index.refresh(mine, columns)
        return StageResult(docs, ok, index.rows())
    return StageResult(docs, ok, refresh_payload(index, mine, columns))
