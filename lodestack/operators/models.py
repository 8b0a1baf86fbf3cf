"""Model-backed steps behind protocols, with deterministic stand-ins, and the dataflow around them."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import iso_date


class Embedder(Protocol):
    def embed_query(self, text: str) -> Sequence[float]: ...

    def rerank(self, query: str, passages: Sequence[str]) -> Sequence[float]: ...


class PageReader(Protocol):
    def __call__(self, pages: list[bytes]) -> list[str]: ...


class Extractor(Protocol):
    """Text to raw model output, normally a JSON object with title, date, correspondent and summary."""

    def extract(self, text: str, attempt: int) -> str: ...


class HashEmbedder:
    """Stand-in: a sum of unit vectors seeded by the words' hashes, scaled to length 1."""

    def __init__(self, size: int = 64) -> None:
        self.size = size
        self.known: dict[str, np.ndarray] = {}

    def _word(self, w: str) -> np.ndarray:
        if w not in self.known:
            seed = int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "big")
            v = np.random.default_rng(seed).standard_normal(self.size)
            self.known[w] = v / np.linalg.norm(v)
        return self.known[w]

    def embed_query(self, text: str) -> list[float]:
        v = sum((self._word(w) for w in text.lower().split()), np.zeros(self.size))
        n = np.linalg.norm(v)
        return (v / n if n else v).tolist()

    def rerank(self, query: str, passages: Sequence[str]) -> list[float]:
        q = set(query.lower().split())
        return [len(q & set(p.lower().split())) / max(1, len(q)) for p in passages]


def sparse_terms(text: str) -> tuple[list[int], list[float]]:
    """Stand-in for sparse vectors: hashed words and their frequencies."""
    words = text.lower().split()
    ids = {}
    for w in words:
        k = int.from_bytes(hashlib.sha256(w.encode()).digest()[:4], "big") & 0x7FFFFFFF
        ids[k] = ids.get(k, 0.0) + 1.0 / len(words)
    return sorted(ids), [ids[k] for k in sorted(ids)]


def attempted(call: Callable, *args) -> tuple[object, str | None]:
    """What a model's call returns and no error, or nothing and the error: whatever a client raises is the failure of one input, not of the batch around it."""
    try:
        return call(*args), None
    except Exception as e:  # clients of models raise anything
        return None, f"{type(e).__name__}: {e}"


def embed_chunks(chunks: DataFrame, embedder: Callable[[], Embedder]) -> DataFrame:
    """(doc_id, chunk_index, embedding, sparse, error): batches go to a model that each worker makes once.

    A chunk whose embedding raises has the error in place of its vectors; a model that can't be made at all fails the job.
    """

    @F.pandas_udf("embedding array<float>, indices array<int>, values array<float>, error string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = embedder()
        for t in texts:
            sparse = [sparse_terms(x or "") for x in t]
            got = [attempted(model.embed_query, x or "") for x in t]
            yield pd.DataFrame({"embedding": [v for v, _ in got], "indices": [s[0] for s in sparse], "values": [s[1] for s in sparse], "error": [e for _, e in got]}, dtype=object)

    v = F.col("v")
    good = v["error"].isNull()
    sparse = F.when(good, F.struct(v["indices"].alias("indices"), v["values"].alias("values")))
    return chunks.select("doc_id", "chunk_index", run("text").alias("v")).select("doc_id", "chunk_index", v["embedding"].alias("embedding"), sparse.alias("sparse"), v["error"].alias("error"))


def rerank_scores(query: str, embedder: Callable[[], Embedder]):
    """Column function of passages: the cross-encoder's scores, a batch at a time."""

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = embedder()
        for t in texts:
            yield pd.Series(model.rerank(query, [x or "" for x in t]), dtype="float64")

    return run


def read_pages(pages: DataFrame, reader: Callable[[], PageReader], batch: int = 5) -> DataFrame:
    """(doc_id, text, error): pages (doc_id, page, image) read in batches and joined in order by a blank line.

    A batch is a row, so batches of one document are read in parallel. A document of which a batch raises, or gives another
    number of texts than pages, has no text but the error of its first such batch.
    """

    @F.pandas_udf("texts array<string>, error string")
    def run(images: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = reader()

        def read(x) -> list[str]:
            got = list(model(list(x)))
            if len(got) != len(x):
                raise ValueError(f"{len(got)} texts of {len(x)} pages")
            return got

        for s in images:
            yield pd.DataFrame([attempted(read, x) for x in s], columns=["texts", "error"], dtype=object)

    grouped = pages.groupBy("doc_id", F.floor(F.col("page") / batch).alias("b")).agg(F.array_sort(F.collect_list(F.struct("page", "image"))).alias("p"))
    texts = grouped.select("doc_id", "b", run(F.transform("p", lambda x: x["image"])).alias("t")).select("doc_id", "b", "t.*")
    whole = texts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("b", "texts"))).alias("x"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("b"))).alias("error"))
    joined = F.array_join(F.flatten(F.transform("x", lambda x: x["texts"])), "\n\n")
    return whole.select("doc_id", F.when(F.col("error").isNull(), joined).alias("text"), "error")


# --- structured output -----------------------------------------------------------------------------------------------

FIELDS = ("title", "date", "correspondent", "summary")
THINKING = re.compile(r"<(think|thinking)>.*?</\1>", re.DOTALL | re.IGNORECASE)
#: Calls of a template model until its answer is JSON.
TEMPLATE_ATTEMPTS = 5


def loose_json(raw: str | None) -> dict:
    """A JSON object from model output: strict; else the outermost braces with simple faults mended; else empty.

    Mended are trailing commas, commas missing between lines, and single-quoted or bare keys.
    """
    raw = raw or ""
    found = re.search(r"\{.*\}", raw, re.DOTALL)
    tries = [raw]
    if found:
        text = found[0]
        tries.append(text)
        text = re.sub(r",\s*([}\]])", r"\1", text)
        text = re.sub(r'(["\d\]}]|true|false|null)\s*\n\s*(")', r"\1,\n\2", text)
        tries.append(text)
        tries.append(re.sub(r"([{,]\s*)'?([A-Za-z_]\w*)'?\s*:", r'\1"\2":', text))
    for t in tries:
        try:
            got = json.loads(t)
        except ValueError:
            continue
        if isinstance(got, dict):
            return got
    return {}


#: Descriptive keys of the template form and the fields that they stand for.
TEMPLATE_KEYS = {"title_summarizing_subject_clear_concise_descriptive": "title", "document_date": "date", "issuing_organization_or_sender": "correspondent"}


def validated(answer: object) -> dict:
    """FIELDS of a parsed answer: absent and empty ones are null. An answer that is no object, or whose texts are no texts, raises; dates are judged later, since a bad one costs only itself."""
    if not isinstance(answer, dict):
        raise TypeError("the answer is not an object")
    for k in FIELDS:
        if k != "date" and not isinstance(answer.get(k), str | None):
            raise TypeError(f"{k} is not a text")
    return {k: None if answer.get(k) in (None, "") else str(answer[k]) for k in FIELDS}


def extract_with(extractor: Extractor, text: str, attempts: int = 1, keys: dict[str, str] | None = None) -> dict:
    """Fields of a text: output is asked for again, up to ``attempts`` times, until it is JSON; the last one is then parsed loosely.

    Thinking in the output is left out and an empty answer has no field. With ``keys`` only these are taken, under their new names.
    """
    for i in range(max(1, attempts)):
        raw = THINKING.sub("", extractor.extract(text, i) or "").strip() or "{}"
        try:
            got = json.loads(raw)
            break
        except ValueError:
            got = loose_json(raw)
    if keys and isinstance(got, dict):
        got = {new: got.get(old) for old, new in keys.items()}
    return validated(got)


class FirstLineExtractor:
    """Stand-in: the first line is the title, the first ISO day the date, what follows ``From:`` the sender."""

    def extract(self, text: str, attempt: int) -> str:
        day = re.search(r"\d{4}-\d{2}-\d{2}", text)
        sender = re.search(r"From:\s*(.+)", text)
        return json.dumps({"title": text.strip().split("\n")[0][:128], "date": day and day[0], "correspondent": sender and sender[1].strip(), "summary": text.strip()[:80]})


def pick_strategy(model: str) -> dict[str, str] | None:
    """Key names by model: template models answer with descriptive keys."""
    return TEMPLATE_KEYS if "nuextract" in model.lower() else None


def extract_metadata(docs: DataFrame, extractor: Callable[[], Extractor], model: str = "stand-in") -> DataFrame:
    """(doc_id, title, date, correspondent, summary, error): dates that aren't strict ISO days become null.

    Template models are asked up to TEMPLATE_ATTEMPTS times for JSON, others once. A document whose extraction raises, or whose
    answer is not an object of texts, has the error and no field.
    """
    keys = pick_strategy(model)
    attempts = TEMPLATE_ATTEMPTS if keys else 1

    @F.pandas_udf(", ".join(f"{f} string" for f in (*FIELDS, "error")))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e = extractor()
        for t in texts:
            got = [attempted(extract_with, e, x or "", attempts, keys) for x in t]
            yield pd.DataFrame([{**(fields or {}), "error": error} for fields, error in got], columns=[*FIELDS, "error"], dtype=object)

    m = F.col("m")
    return docs.select("doc_id", run("text").alias("m")).select("doc_id", m["title"].alias("title"), iso_date(m["date"]).alias("date"), m["correspondent"].alias("correspondent"), m["summary"].alias("summary"), m["error"].alias("error"))


def instructions(schema: dict[str, str]) -> str:
    """Prompt lines for a schema's fields."""
    return "\n".join(f"- {k}: {v}" for k, v in schema.items())


def response_format(supports_schema: bool, supports_json: bool) -> str:
    """The strictest form of structured output that a model offers."""
    return "json_schema" if supports_schema else "json_object" if supports_json else "text"


# --- chat -----------------------------------------------------------------------------------------------------------


@dataclass
class ToolResult:
    content: str
    summary: str = ""
    preview: str = ""
    sources: list[tuple[int, str]] = field(default_factory=list)


def tool_arguments(raw: str | dict | None) -> dict:
    """Arguments of a tool call: null and blank are none, objects pass, texts must hold an object."""
    if raw is None or (isinstance(raw, str) and not raw.strip()):
        return {}
    got = json.loads(raw) if isinstance(raw, str) else raw
    if not isinstance(got, dict):
        raise TypeError("tool arguments must be an object")
    return got


class Tools:
    """Named functions that a chat model may call."""

    def __init__(self, functions: dict[str, Callable[..., ToolResult]]) -> None:
        self.functions = functions

    def call(self, name: str, raw: str | dict | None) -> ToolResult:
        if name not in self.functions:
            raise ValueError(f"unknown tool {name}")
        return self.functions[name](**tool_arguments(raw))


@dataclass
class Reply:
    """A model's step: a final text, or tool calls (name, raw arguments)."""

    text: str | None = None
    calls: list[tuple[str, str | dict | None]] = field(default_factory=list)
    usage: dict[str, int] = field(default_factory=dict)


def merge_sources(flags: dict[int, dict[str, bool]], result: ToolResult) -> dict[int, dict[str, bool]]:
    """Source flags by document: matched by a search, inspected by a read."""
    for doc, kind in result.sources:
        f = flags.setdefault(doc, {"matched": False, "inspected": False})
        f["inspected" if kind == "read" else "matched"] = True
    return flags


@dataclass
class Turn:
    text: str
    usage: dict[str, int] | None
    sources: dict[int, dict[str, bool]]
    messages: list[dict]
    events: list[tuple[str, dict]]


def chat_turn(model: Callable[[list[dict]], Reply], tools: Tools, message: str, history: Sequence[dict] = (), steps: int = 20) -> Turn:
    """Let a model call tools until it answers. Failed calls are told to the model; usage sums over steps and is null if nothing was counted."""
    messages = [*history, {"role": "user", "content": message}]
    total, sources, events = {"prompt": 0, "completion": 0, "total": 0}, {}, [("turn_started", {})]
    for _ in range(steps):
        reply = model(messages)
        u = reply.usage
        p, c = u.get("prompt", 0) or 0, u.get("completion", 0) or 0
        for k, v in (("prompt", p), ("completion", c), ("total", u.get("total") or p + c)):
            total[k] += v
        events.append(("usage", dict(total)))
        if not reply.calls:
            text = reply.text or ""
            messages.append({"role": "assistant", "content": text})
            events += [("assistant_message", {"text": text}), ("sources", {"ids": sorted(sources)}), ("turn_completed", {})]
            return Turn(text, total if total["total"] else None, sources, messages, events)
        messages.append({"role": "assistant", "tool_calls": [{"name": n, "arguments": a} for n, a in reply.calls]})
        for name, raw in reply.calls:
            events.append(("tool_call_started", {"name": name}))
            try:
                result = tools.call(name, raw)
            except Exception as e:  # the model is told and may try otherwise
                result = ToolResult(f"Tool {name} failed: {e}")
            merge_sources(sources, result)
            events.append(("tool_call_completed", {"name": name, "summary": result.summary}))
            messages.append({"role": "tool", "name": name, "content": result.content})
    raise RuntimeError(f"no answer after {steps} steps")


def conversation_usage(steps: DataFrame, key: str = "conv_id") -> DataFrame:
    """Token sums by conversation from (prompt, completion, total), null where nothing was counted."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    sums = steps.groupBy(key).agg(F.sum(n("prompt")).alias("prompt"), F.sum(n("completion")).alias("completion"), F.sum(F.coalesce("total", n("prompt") + n("completion"))).alias("total"))
    return sums.select(key, *[F.when(F.col("total") > 0, F.col(c)).alias(c) for c in ("prompt", "completion", "total")])


def chat_sources(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, matched, inspected, title) of referenced documents that exist, inspected ones first."""
    flags = refs.groupBy("doc_id").agg(F.bool_or(F.col("kind") != "read").alias("matched"), F.bool_or(F.col("kind") == "read").alias("inspected"))
    return flags.join(docs.select("doc_id", "title"), "doc_id").orderBy(F.desc("inspected"), "doc_id")
