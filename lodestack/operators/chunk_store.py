"""An index of chunks that is maintained by document: updates shuffle the update only and rewrite only the parts that they touch.

The chunks stand in a Parquet table that is partitioned by ranges of document ids and bucketed by document. New documents have
neighbouring ids, so an update touches few parts; the bucketing lets it meet the index without moving the index, be it by a
sort-merge join or, where Spark finds the update small enough, by a broadcast of it. A part is written anew beside the old one
and takes its place when the job has ended (Spark's dynamic partition overwrite), so a lost executor or a failed job leaves
the index as it was. Only the exchange of the parts, at the very end, is not one step: if the driver itself dies there, parts may
be missing, and the index is built anew. There is one writer at a time, and readers ask for ``rows`` again after an update.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, new_folder
from .chunks import PAYLOAD

PART = "_part"
#: Document ids to a part.
SPAN = 100_000
#: Tasks that the new chunks of one bucket are dealt to, so that a document with a third of all chunks is not one task.
SALTS = 4
POINT = ("doc_id", "chunk_index")


@contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session for a while; double underscores in the names stand for dots."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class ChunkStore:
    """Chunks (doc_id, chunk_index and any other columns but ``_part``) by document.

    Rows without a document id or a position have no point id and are left out. Of several new rows of one point the greatest
    by its other columns, in their order, is taken, so repeated rows and replays change nothing; such columns may not be maps.
    Columns that the index has and the update lacks become null, those that only the update has are left out.
    """

    def __init__(self, spark: SparkSession, name: str, span: int, buckets: int) -> None:
        self.spark, self.name, self.span, self.buckets = spark, name, span, buckets

    @classmethod
    def create(cls, chunks: DataFrame, name: str | None = None, span: int = SPAN, buckets: int | None = None, path: str | None = None) -> ChunkStore:
        """A store of ``chunks``; the table's files lie under ``path``, by default in the shared folder."""
        if PART in chunks.columns:
            raise ValueError(f"chunks may not have a column {PART}")
        if span < 1:
            raise ValueError("span must be positive")
        spark = chunks.sparkSession
        name = name or f"chunk_store_{uuid.uuid4().hex}"
        store = cls(spark, name, span, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        rows = store._dealt(chunks)
        rows.write.format("parquet").option("path", path or new_folder(spark, "chunks")).partitionBy(PART).bucketBy(store.buckets, "doc_id").saveAsTable(name)
        return store

    def _part(self, doc_id: str = "doc_id") -> Column:
        return F.expr(f"CAST(`{doc_id}` AS BIGINT) div {self.span}")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """One row per point, with its part, moved so that a bucket is written by SALTS tasks whatever documents it has. The one shuffle serves both."""
        bucket, salt = F.pmod(F.hash("doc_id"), F.lit(self.buckets)), F.pmod(F.hash("chunk_index"), F.lit(SALTS))
        rest = F.struct(F.lit(0).alias(PART), *[F.col(f"`{c}`") for c in rows.columns if c not in POINT])
        packed = rows.where("doc_id IS NOT NULL AND chunk_index IS NOT NULL").select(*POINT, bucket.alias("_bucket"), salt.alias("_salt"), rest.alias("_rest"))
        moved = packed.repartition(self.buckets * SALTS, "_bucket", "_salt")
        best = moved.groupBy("_bucket", "_salt", *POINT).agg(F.max("_rest").alias("_rest"))
        return best.select(*[F.col(c) if c in POINT else F.col(f"_rest.`{c}`").alias(c) for c in rows.columns], self._part().alias(PART))

    def rows(self) -> DataFrame:
        """All chunks."""
        return self.spark.table(self.name).drop(PART)

    def of_documents(self, doc_ids: DataFrame) -> DataFrame:
        """Chunks of the documents in ``doc_ids``, read from their parts only."""
        return self._held(self._parts(doc_ids)).join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi").select(*self.rows().columns)

    def _parts(self, keyed: DataFrame) -> list[int]:
        # as many numbers as parts are touched, not documents
        return sorted(r[0] for r in keyed.where("doc_id IS NOT NULL").select(self._part()).distinct().collect())

    def _held(self, parts: list[int]) -> DataFrame:
        return self.spark.table(self.name).where(F.col(PART).isin(parts) if parts else F.lit(False))

    def _conformed(self, new: DataFrame) -> DataFrame:
        types = {f.name: f.dataType for f in self.rows().schema}
        return new.select(*[(F.col(f"`{c}`") if c in new.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()])

    def upsert(self, new: DataFrame) -> list[int]:
        """New chunks in place of those of the same document and position. Returns the parts written."""
        new = materialize(self._dealt(self._conformed(new)), "upsert")
        return self._write(self._parts(new), lambda held: without_points(held, new).unionByName(new))

    def replace(self, new: DataFrame, doc_ids: DataFrame | None = None) -> list[int]:
        """All chunks of the documents in ``doc_ids``, by default those of ``new``, go; then ``new`` comes. Returns the parts written."""
        new = materialize(self._dealt(self._conformed(new)), "replace")
        gone = new.select("doc_id").distinct() if doc_ids is None else materialize(doc_ids.select("doc_id").distinct(), "gone")
        parts = sorted({*self._parts(gone), *self._parts(new)})
        # a point that is not of the documents to go is replaced all the same: a point is in the index once
        kept = (lambda held: without_documents(held, gone)) if doc_ids is None else (lambda held: without_points(without_documents(held, gone), new))
        return self._write(parts, lambda held: kept(held).unionByName(new))

    def delete(self, doc_ids: DataFrame) -> list[int]:
        """All chunks of the documents go. Returns the parts written or dropped."""
        gone = materialize(doc_ids.select("doc_id").distinct(), "gone")
        return self._write(self._parts(gone), lambda held: without_documents(held, gone))

    def refresh(self, meta: DataFrame, columns: tuple[str, ...] = PAYLOAD) -> list[int]:
        """Payload columns of all chunks of the documents in ``meta`` replaced, nulls included; other columns stay. Of several rows of a document the greatest counts. Returns the parts written."""
        new = meta.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.struct(*columns)).alias("_new"))
        new = materialize(new, "refresh")
        return self._write(self._parts(new), lambda held: refreshed(held, new, columns))

    def _write(self, parts: list[int], change: Callable[[DataFrame], DataFrame]) -> list[int]:
        if not parts:
            return parts
        seen = Observation()
        columns = [*self.rows().columns, PART]
        # joins by document and position may use the bucketing by document
        with _settings(self.spark, spark__sql__sources__partitionOverwriteMode="dynamic", spark__sql__requireAllClusterKeysForCoPartition="false"):
            after = change(self._held(parts)).select(*columns).observe(seen, F.collect_set(PART).alias("parts"))
            after.write.insertInto(self.name, overwrite=True)
        for empty in set(parts) - set(seen.get["parts"] or []):  # a part that nothing is written to isn't overwritten
            self._drop(empty)
        return parts

    def _drop(self, part: int) -> None:
        held = self._held([part])
        if not held.isEmpty():
            folders = {f.rpartition("/")[0] for f in held.inputFiles()}
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION ({PART} = {part})")
            jvm = self.spark.sparkContext._jvm
            for folder in folders:  # the table is an external one, whose files stay when a partition goes
                where = jvm.org.apache.hadoop.fs.Path(folder)
                where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
            self.spark.catalog.refreshTable(self.name)


def without_points(held: DataFrame, new: DataFrame) -> DataFrame:
    return held.join(new.select(*POINT), list(POINT), "left_anti")


def without_documents(held: DataFrame, gone: DataFrame) -> DataFrame:
    return held.join(gone.select("doc_id"), "doc_id", "left_anti")


def refreshed(held: DataFrame, new: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    got = held.join(new, "doc_id", "left")
    hit = F.col("_new").isNotNull()
    types = {f.name: f.dataType for f in held.schema}
    return got.select(*[F.when(hit, F.col(f"_new.`{c}`").cast(types[c])).otherwise(F.col(f"`{c}`")).alias(c) if c in columns else F.col(f"`{c}`") for c in held.columns])
