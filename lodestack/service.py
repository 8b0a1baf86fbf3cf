"""The service edge: search, metadata, health and webhook endpoints over the operators, and the command line."""

from __future__ import annotations

import argparse
import hmac
import json
import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import is_ai_note
from .operators import entities
from .operators.lookups import available_names, without
from .operators.models import ToolResult
from .operators.retrieval import Filters, HybridSearch
from .sources.tables import Settings, table


@dataclass
class Service:
    """Answers requests as (status, body); ``events`` takes webhook bodies, normally to a folder that a stream reads."""

    search: HybridSearch
    dims: dict[str, DataFrame]
    events: Callable[[str], None]
    beats: dict[str, float] = field(default_factory=dict)
    pending: Callable[[], dict[str, int]] = dict
    secret: str | None = None
    poll: int = 300

    def get_search(self, q: str, limit: int = 20, **filters) -> tuple[int, list | dict]:
        """Ids of the best documents; 422 for bad arguments, an empty list if the store is empty or the search fails."""
        if not q or not 1 <= limit <= 100:
            return 422, {"detail": "q must not be empty, limit must be from 1 to 100"}
        try:
            if self.search.chunks.isEmpty():
                return 200, []
            return 200, [r["doc_id"] for r in self.search.search(q, Filters(**filters), limit=limit).collect()]
        except Exception:  # the endpoint degrades to no result
            logging.getLogger(__name__).exception("search failed")
            return 200, []

    def get_metadata(self) -> tuple[int, dict]:
        """Sorted names of every dimension; 503 without any."""
        if not self.dims:
            return 503, {"detail": "not configured"}
        return 200, available_names(self.dims, self.search.docs.sparkSession).first().asDict()

    def get_health(self, now: float | None = None) -> tuple[int, dict]:
        now, most = now or time.time(), max(60, 2 * self.poll + 30)
        ages = {k: now - t for k, t in self.beats.items()}
        ok = bool(ages) and all(a <= most for a in ages.values())
        return (200 if ok else 503), {"healthy": ok, "ages": ages, "pending": self.pending()}

    def post_webhook(self, body: bytes, token: str = "") -> tuple[int, dict]:
        """202 for any JSON body, 400 else, 401 for a wrong token."""
        if self.secret is not None and not hmac.compare_digest(token.encode(), self.secret.encode()):
            return 401, {}
        try:
            json.loads(body)
        except ValueError:
            return 400, {}
        self.events(body.decode())
        return 202, {}

    # chat tools
    def tool_search(self, query: str, limit: int = 20, mode: str = "precision", **filters) -> ToolResult:
        rows = self.search.search(query, Filters(**filters), mode, limit).collect()
        text = "\n".join(f"[Doc {r['doc_id']}]: {r['text'] or ''}" for r in rows)
        return ToolResult(text, f"Found {len(rows)} documents.", text[:420], [(r["doc_id"], "search") for r in rows])

    def tool_read(self, doc_id: int, max_chars: int = 8000) -> ToolResult:
        from .functions.text import full_text

        title = F.col("title") if "title" in self.search.docs.columns else F.lit(None).cast("string")
        row = self.search.docs.where(F.col("doc_id") == doc_id).select(full_text(F.col("doc_id"), title, F.col("text"), max_chars).alias("t"), (F.trim("text") != "").alias("some")).first()
        if row is None:
            return ToolResult(f"Document {doc_id} was not found.")
        return ToolResult(row["t"], f"Read document {doc_id}.", row["t"][:420], [(doc_id, "read")] if row["some"] else [])

    def tool_metadata(self) -> ToolResult:
        names = available_names(self.dims, self.search.docs.sparkSession).first().asDict()
        return ToolResult("\n".join(f"Available {k}: {', '.join(v) or '(none)'}" for k, v in names.items()))


def serve(service: Service, port: int = 8000) -> ThreadingHTTPServer:
    """An HTTP server over a service; the caller runs and stops it."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, body) -> None:
            raw = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            at = urlsplit(self.path)
            q = parse_qs(at.query)
            one = lambda k: q.get(k, [None])[0]
            if at.path == "/search":
                limit = one("limit") or "20"
                self.answer(*service.get_search(one("q") or "", int(limit) if limit.isdigit() else 0, correspondent=one("correspondent"), document_type=one("document_type"), storage_path=one("storage_path"), tags=tuple(q.get("tags", ())), year=one("year")))
            elif at.path == "/metadata/available":
                self.answer(*service.get_metadata())
            elif at.path == "/health":
                self.answer(*service.get_health())
            else:
                self.answer(404, {})

        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            if self.path == "/webhook/document":
                self.answer(*service.post_webhook(body, self.headers.get("X-Webhook-Token", "")))
            else:
                self.answer(404, {})

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def purge_notes(notes: DataFrame, dry_run: bool = False) -> tuple[DataFrame, int]:
    """Notes (id, note) without those that the pipeline wrote, and how many those are."""
    mine = notes.where(is_ai_note("note")).select("id")
    return (notes if dry_run else without(notes, mine, "id")), mine.count()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Maintenance over tables in a folder: merge plans, their application, notes."""
    p = argparse.ArgumentParser(prog="lodestack")
    p.add_argument("--tables", required=True, help="folder of senders.parquet, documents.parquet and notes.parquet")
    p.add_argument("--out", help="folder for changed tables")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--purge-notes", action="store_true")
    p.add_argument("--cleanup-plan", metavar="FILE", help="write a merge plan, - for standard output")
    p.add_argument("--cleanup-apply", metavar="FILE")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("lodestack").getOrCreate()
    settings = Settings.from_env()
    dry = a.dry_run or settings.dry_run
    if (a.purge_notes or a.cleanup_apply) and not dry and not a.out:
        p.error("--out is needed unless it is a dry run")
    if a.purge_notes:
        kept, n = purge_notes(table(spark, a.tables, "notes"), dry)
        if not dry:
            kept.write.mode("overwrite").parquet(f"{a.out}/notes.parquet")
        print(f"{n} notes")
    if a.cleanup_plan:
        plan = entities.merge_plan(table(spark, a.tables, "senders"), table(spark, a.tables, "documents"))
        text = entities.write_plan(plan, a.cleanup_plan, time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()))
        if a.cleanup_plan == "-":
            print(text)
    if a.cleanup_apply:
        plan = entities.read_plan(spark, a.cleanup_apply)
        senders, docs, counts = entities.apply_plan(plan, table(spark, a.tables, "senders"), table(spark, a.tables, "documents"), dry)
        if not dry:
            senders.write.mode("overwrite").parquet(f"{a.out}/senders.parquet")
            docs.write.mode("overwrite").parquet(f"{a.out}/documents.parquet")
        print(json.dumps(counts.first().asDict()))
    return 0
