"""Chunking, situating and index maintenance."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk_header, point_id

SIZE, OVERLAP = 512, 50
SEPARATORS = ("\n\n", "\n", " ", "")


def _pieces(text: str, sep: str) -> list[str]:
    """Split with the separator left at the head of what follows it."""
    if not sep:
        return list(text)
    first, *rest = text.split(sep)
    return [p for p in (first, *(sep + r for r in rest)) if p]


def _pack(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Greedy chunks of adjacent pieces; each starts with as many last pieces of the one before as fit the overlap."""
    held: list[str] = []
    total = 0
    for p in pieces:
        if held and total + len(p) > size:
            yield "".join(held)
            while held and (total > overlap or total + len(p) > size):
                total -= len(held.pop(0))
        held.append(p)
        total += len(p)
    if held:
        yield "".join(held)


def _recurse(text: str, size: int, overlap: int, seps: tuple[str, ...]) -> Iterator[str]:
    at = next(i for i, s in enumerate(seps) if not s or s in text)
    short: list[str] = []
    for piece in _pieces(text, seps[at]):
        if len(piece) < size or not seps[at]:
            short.append(piece)
            continue
        yield from _pack(short, size, overlap)
        short = []
        yield from _recurse(piece, size, overlap, seps[at + 1 :])
    yield from _pack(short, size, overlap)


def chunk_text(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Overlapping chunks of at most ``size`` characters, cut at the coarsest separator that works; blank text has none."""
    if size < 1:
        raise ValueError("size must be positive")
    text = (text or "").strip()
    if not text:
        return []
    if len(text) <= size:
        return [text]
    found = (c.strip() for c in _recurse(text, size, max(0, min(overlap, size - 1)), SEPARATORS))
    return [c for c in found if c]


def chunk(docs: DataFrame, text: str = "text", size: int = SIZE, overlap: int = OVERLAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, chunk_index, text, and columns to keep): one row per chunk of every whole text."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunk_text(t, size, overlap))

    return docs.select("doc_id", F.posexplode(cut(F.col(text))).alias("chunk_index", "text"), *keep)


def situate(chunks: DataFrame, meta: DataFrame) -> DataFrame:
    """Chunks with their document's header in front; ``meta`` has doc_id, title, correspondent, document_date, summary."""
    header = chunk_header(*[F.col(c) for c in ("title", "correspondent", "document_date", "summary")])
    heads = meta.select("doc_id", header.alias("_h"))
    unknown = chunk_header(*[F.lit(None).cast("string")] * 4)
    return chunks.join(heads, "doc_id", "left").withColumn("text", F.concat(F.coalesce("_h", unknown), "text")).drop("_h")


Hook = Callable[[list[str], str, dict], list[str]]


def load_hook(path: str | None = None) -> Hook | None:
    """``situate_chunks`` of a Python file, by default the one that EMBED_HOOK_FILE names; None if it can't be loaded."""
    path = path or os.environ.get("EMBED_HOOK_FILE")
    if not path:
        return None
    try:
        spec = importlib.util.spec_from_file_location("lodestack_hook", path)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        return module.situate_chunks
    except Exception:  # a hook that can't be loaded falls back to the built-in header
        return None


def situate_with(docs: DataFrame, hook: Hook | None = None, model: Callable[[str, str], str] | None = None, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of documents (doc_id, text, title, correspondent, document_date, summary), situated by a hook, else by a model per chunk, else by a header.

    A hook that fails or returns another number of chunks leaves the header to the document's chunks.
    """
    if hook is None and model is None:
        return situate(chunk(docs, size=size, overlap=overlap), docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                cut = chunk_text(r["text"], size, overlap)
                try:
                    said = hook(cut, r["text"] or "", r) if hook else [f"{model(c, r['text'] or '')}\n---\n{c}" for c in cut]
                    if len(said) != len(cut):
                        said = None
                except Exception:  # the document keeps its plain chunks with a header
                    said = None
                if said is None:
                    known = [f"{n}: {r[k] or 'Unknown'}" for n, k in (("Title", "title"), ("Sender", "correspondent"), ("Date", "document_date"))]
                    more = [f"Summary: {r['summary']}"] if r.get("summary") else []
                    said = ["\n".join([*known, *more, "---", c]) for c in cut]
                out += [(r["doc_id"], i, s) for i, s in enumerate(said)]
            yield pd.DataFrame(out, columns=["doc_id", "chunk_index", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "title", "correspondent", "document_date", "summary").mapInPandas(run, f"doc_id {kind}, chunk_index int, text string")


def points(chunks: DataFrame, vectors: DataFrame, sparse: DataFrame | None = None) -> DataFrame:
    """Chunks with ids and vectors: joined by document and position; chunks without a vector are left out."""
    got = chunks.join(vectors, ["doc_id", "chunk_index"])
    got = got.join(sparse, ["doc_id", "chunk_index"], "left") if sparse is not None else got
    return got.withColumn("point_id", point_id(F.col("doc_id"), F.col("chunk_index")))


def upsert(index: DataFrame, new: DataFrame, key: str = "point_id") -> DataFrame:
    """The index with ``new`` points in place of those of the same ids."""
    return index.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_documents(index: DataFrame, new: DataFrame, doc_ids: DataFrame | None = None) -> DataFrame:
    """Delete all chunks of the documents, then insert the new ones: a document that got shorter leaves nothing behind."""
    gone = (new if doc_ids is None else doc_ids).select("doc_id").distinct()
    return index.join(gone, "doc_id", "left_anti").unionByName(new, allowMissingColumns=True)


PAYLOAD = ("title", "correspondent", "document_type", "storage_path", "tags", "date", "year")


def refresh_payload(index: DataFrame, meta: DataFrame, columns: tuple[str, ...] = PAYLOAD) -> DataFrame:
    """Payload columns of all chunks of the documents in ``meta`` replaced, nulls included; text and vectors stay."""
    new = meta.select("doc_id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    got = index.join(new, "doc_id", "left")
    return got.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in index.columns])


def ensure_table(spark, name: str, schema: str) -> None:
    """Create an empty Parquet table unless there is one."""
    if not spark.catalog.tableExists(name):
        spark.createDataFrame([], schema).write.saveAsTable(name, format="parquet")


def has_points(index: DataFrame) -> bool:
    return not index.isEmpty()
