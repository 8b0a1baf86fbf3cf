"""Keyword search over an inverted file: postings sorted by term, bounds per block, documents added, replaced and deleted."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, new_folder
from .retrieval import terms

#: Documents of a bin at most: a term's postings in a bin are one block with one bound.
BIN = 256
#: Terms that a worker numbers and sorts at once, and of a bin's documents if it has several.
TERMS = 500_000
#: Bytes of a row group, so that a term's blocks can be read without its neighbours'.
ROW_GROUP = 4 << 20
#: Bins that are pushed down as a list; more are joined.
LISTED = 1_000
#: Decimals that scores are rounded to, so that equal ones are ties on any machine.
DIGITS = 9

SEGMENTS = "segment string, n long, total long"
GONE = "segment string, bin long, doc_id long, dl int"
#: Whose block in a bin holds all documents of the bin; no text has it as a term.
ALL = ""
BLOCK = "term string, bin long, n int, max_tf int, min_dl int, docs array<long>, tfs array<int>, dls array<int>"
#: A block on its way: its documents, then tf << 32 | dl of each.
PACKED = "term string, bin long, packed array<long>"


def _bins(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of length, and the bin of each place in that order: BIN rows or TERMS terms, at least one row."""
    order = np.argsort(sizes, kind="stable")
    place, bin_, rows, terms_ = np.empty(len(order), np.int64), -1, BIN, 0
    for i, n in enumerate(sizes[order].tolist()):
        if rows == BIN or terms_ + n > TERMS:
            bin_, rows, terms_ = bin_ + 1, 0, 0
        place[i], rows, terms_ = bin_, rows + 1, terms_ + n
    return order, place


def _packed(ids: np.ndarray, t: pa.ListArray, place: np.ndarray, first: int) -> pa.RecordBatch:
    """Blocks of some whole bins, numbered from ``first``, with the block of ALL of each."""
    sizes = np.diff(t.offsets.to_numpy())
    words = t.flatten().dictionary_encode()
    n = len(words.dictionary)
    row = np.repeat(np.arange(len(ids)), sizes)
    key, tf = np.unique(row * n + words.indices.to_numpy(), return_counts=True)
    # the last term is ALL, with every row
    row, term, tf = np.append(key // max(n, 1), np.arange(len(ids))), np.append(key % max(n, 1), np.full(len(ids), n)), np.append(tf, np.zeros(len(ids), np.int64))
    order = np.lexsort((ids[row], place[row], term))
    row, term = row[order], term[order]
    bin_, counts = place[row], tf[order].astype(np.int64) << 32 | sizes[row]
    starts = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (bin_[1:] != bin_[:-1])))
    ends = np.append(starts[1:], len(term))
    # a posting's place: twice the postings of the blocks before, and its own in its block
    at = np.arange(len(term)) + np.repeat(starts, ends - starts)
    packed = np.empty(2 * len(term), np.int64)
    packed[at], packed[at + np.repeat(ends - starts, ends - starts)] = ids[row], counts
    lists = pa.ListArray.from_arrays(np.append(2 * starts, len(packed)).astype(np.int32), pa.array(packed))
    names = pa.concat_arrays([words.dictionary, pa.array([ALL], words.dictionary.type)])
    cols = [names.take(pa.array(term[starts])), pa.array(first + bin_[starts]), lists]
    return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in PACKED.split(", ")])


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents (doc_id, t): those of a batch are put in order of length and cut into bins, and bins are worked on until they have TERMS terms."""
    part, bins = TaskContext.get().partitionId() << 32, 0
    for b in batches:
        if not b.num_rows:
            continue
        ids, t = b.column(0).to_numpy(), b.column(1)
        sizes = np.diff(t.offsets.to_numpy()).astype(np.int64)
        order, place = _bins(sizes)
        edges = np.append(np.flatnonzero(np.diff(place, prepend=-1)), len(order))
        upto = np.append(0, np.cumsum(sizes[order]))
        i = 0
        while i < len(edges) - 1:
            # whole bins: as many as have TERMS terms, at least one
            j = max(i + 1, int(np.searchsorted(upto[edges], upto[edges[i]] + TERMS, "right")) - 1)
            j = min(j, len(edges) - 1)
            rows = order[edges[i] : edges[j]]
            yield _packed(ids[rows], t.take(pa.array(rows)), place[edges[i] : edges[j]] - place[edges[i]], part + bins + int(place[edges[i]]))
            i = j
        bins += int(place[-1]) + 1


def _unpacked(blocks: DataFrame) -> DataFrame:
    """PACKED as BLOCK: what a block's lists tell is not shuffled beside them."""
    n = (F.size("packed") / 2).cast("int")
    lists = blocks.select("term", "bin", n.alias("n"), F.slice("packed", 1, n).alias("docs"), F.slice("packed", n + 1, n).alias("counts"))
    tfs, dls = F.transform("counts", lambda x: F.shiftright(x, 32).cast("int")), F.transform("counts", lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
    return lists.select("term", "bin", "n", F.shiftright(F.array_max("counts"), 32).cast("int").alias("max_tf"), F.array_min(dls).alias("min_dl"), "docs", tfs.alias("tfs"), dls.alias("dls"))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that has no folder before its first row."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


@dataclass
class Statistics:
    """Documents, their mean length, and in how many of them each asked term occurs."""

    n: int
    mean: float
    df: dict[str, int]


@dataclass
class Postings:
    """An index under ``folder``, in segments: one by ``build``, one more by every ``add``. Deleted documents are listed and left out."""

    spark: SparkSession
    folder: str
    k1: float = 1.2
    b: float = 0.75

    # --- writing -------------------------------------------------------------------------------------------------------

    @classmethod
    def build(cls, docs: DataFrame, folder: str | None = None, text: str = "text") -> Postings:
        """Index documents (doc_id, text). Ids must be unique; rows without one can't be found and don't count."""
        out = cls(docs.sparkSession, folder or new_folder(docs.sparkSession, "postings"))
        out._segment(docs, text)
        return out

    def _segment(self, docs: DataFrame, text: str) -> None:
        """Write a segment: blocks of postings sorted by (term, bin), those of ALL first.

        Bins hold documents of like length that are read together, whose bounds lie close to their scores. So a block is made where its documents are read, in
        one pass without a shuffle; whole blocks then move once, in ranges of (term, bin), so a term of all documents is spread over as many tasks as it needs.
        """
        name = uuid.uuid4().hex
        rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), terms(text).alias("t"))
        blocks = _unpacked(rows.mapInArrow(_blocks_of, PACKED).repartitionByRange("term", "bin").sortWithinPartitions("term", "bin"))
        blocks.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).option("parquet.bloom.filter.enabled#term", "true").parquet(f"{self.folder}/postings/segment={name}")
        own = self.spark.read.schema(BLOCK).parquet(f"{self.folder}/postings/segment={name}").where(F.col("term") == ALL)
        total = F.aggregate("dls", F.lit(0).cast("long"), lambda a, x: a + x)
        kept = own.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(total), F.lit(0))).first()
        # the segment counts from here on
        self.spark.createDataFrame([(name, *kept)], SEGMENTS).coalesce(1).write.mode("append").parquet(f"{self.folder}/segments")

    def add(self, docs: DataFrame, text: str = "text") -> None:
        """Add documents, in place of those of the same ids."""
        docs = materialize(docs.select("doc_id", F.col(text).alias("text")), "added")
        self.delete(docs)
        self._segment(docs, "text")

    def delete(self, ids: DataFrame) -> None:
        """Delete documents by ``doc_id``; unknown ones don't matter. Postings stay until the index is built anew, but nothing counts them any more.

        Only the blocks of ALL are read. What the documents' terms lose is counted when a term is asked for.
        """
        hit = self._documents().join(ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
        hit = materialize(hit.select("segment", "bin", "doc_id", "dl"), "deleted")
        if not hit.isEmpty():
            hit.write.mode("append").parquet(f"{self.folder}/gone")

    # --- reading -------------------------------------------------------------------------------------------------------

    def _segments(self) -> list:
        return _read(self.spark, f"{self.folder}/segments", SEGMENTS).collect()

    def _postings(self) -> DataFrame:
        """Blocks of the segments that were written to their end."""
        done = [r["segment"] for r in self._segments()]
        return _read(self.spark, f"{self.folder}/postings", f"{BLOCK}, segment string").where(F.col("segment").isin(done))

    def _documents(self) -> DataFrame:
        """(segment, bin, term, doc_id, tf, dl) of the live documents."""
        return self._entries(self._blocks([ALL]), None)

    def _gone(self) -> DataFrame:
        return _read(self.spark, f"{self.folder}/gone", GONE)

    def _live(self, rows: DataFrame) -> DataFrame:
        return rows.join(self._gone().select("segment", "doc_id"), ["segment", "doc_id"], "left_anti")

    def _blocks(self, asked: Sequence[str]) -> DataFrame:
        return self._postings().where(F.col("term").isin(list(asked)))

    def statistics(self, asked: Sequence[str], only: DataFrame | None = None) -> Statistics:
        """Of all live documents, or of those whose id is in ``only``. Without ``only``, counts of blocks are read, and postings just in bins that lost documents."""
        if only is None:
            kept = self._segments()
            lost = self._gone().agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
            n, total = sum(r["n"] for r in kept) - lost[0], sum(r["total"] for r in kept) - lost[1]
            blocks, gone = self._blocks(asked), self._gone().select("segment", "bin", "doc_id")
            holed = blocks.join(gone.select("segment", "bin").distinct(), ["segment", "bin"], "left_semi")
            gone = self._exploded(holed).join(gone, ["segment", "bin", "doc_id"], "left_semi").select("term", F.lit(-1).cast("long").alias("n"))
            df = blocks.select("term", F.col("n").cast("long").alias("n")).unionByName(gone).groupBy("term").agg(F.sum("n").alias("n"))
        else:
            of = self._documents().select("doc_id", "dl").join(only.select("doc_id").distinct(), "doc_id", "left_semi")
            n, total = of.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
            df = self._entries(self._blocks(asked), only).groupBy("term").agg(F.count("*").alias("n"))
        return Statistics(n, (total / n if n else 0.0) or 1.0, {r["term"]: r["n"] for r in df.collect()})

    @staticmethod
    def _exploded(blocks: DataFrame) -> DataFrame:
        return blocks.select("segment", "bin", "term", F.inline(F.arrays_zip(F.col("docs").alias("doc_id"), F.col("tfs").alias("tf"), F.col("dls").alias("dl"))))

    def _entries(self, blocks: DataFrame, only: DataFrame | None) -> DataFrame:
        rows = self._live(self._exploded(blocks))
        return rows if only is None else rows.join(only.select("doc_id").distinct(), "doc_id", "left_semi")

    def _part(self, stats: Statistics, term: str, tf: Column, dl: Column) -> Column:
        """What a term adds to a score: it grows with ``tf`` and falls with ``dl``."""
        df = stats.df.get(term, 0)
        idf = F.log(F.lit(1.0) + (stats.n - df + 0.5) / (df + 0.5))
        return idf * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / stats.mean))

    def _scored(self, asked: Sequence[str], stats: Statistics, blocks: DataFrame, only: DataFrame | None) -> DataFrame:
        """(doc_id, bm25), the parts of the terms added in the order they were asked, as ``retrieval.keyword`` does."""
        count = lambda i: F.coalesce(F.max(F.when(F.col("term") == asked[i], F.col("tf"))), F.lit(0)).alias(f"tf{i}")
        rows = self._entries(blocks, only).groupBy("doc_id").agg(F.max("dl").alias("dl"), *[count(i) for i in range(len(asked))])
        score = F.lit(0.0)
        for i, t in enumerate(asked):
            score = score + self._part(stats, t, F.col(f"tf{i}"), F.col("dl"))
        return rows.select("doc_id", F.round(score, DIGITS).alias("bm25"))

    def scores(self, query: Sequence[str], only: DataFrame | None = None) -> DataFrame:
        """(doc_id, bm25) of every document with a query term, from the postings of these terms alone; with ``only``, over these documents, statistics included."""
        asked = [t for t in dict.fromkeys(query) if t != ALL]
        return self._scored(asked, self.statistics(asked, only), self._blocks(asked), only)

    def bounds(self, asked: Sequence[str], stats: Statistics) -> DataFrame:
        """(segment, bin, bound): what no document of a bin can score more than. Only the blocks' own columns are read."""
        part = F.lit(0.0)
        for t in asked:
            part = F.when(F.col("term") == t, self._part(stats, t, F.col("max_tf"), F.col("min_dl"))).otherwise(part)
        return self._blocks(asked).select("segment", "bin", part.alias("part")).groupBy("segment", "bin").agg(F.sum("part").alias("bound"))

    def top(self, query: Sequence[str], k: int, only: DataFrame | None = None, report: dict | None = None) -> DataFrame:
        """The k best documents (doc_id, bm25), ties to the smaller id: just those of ``scores``.

        The bins with the highest bounds are scored first; their k-th score is a threshold, and of the others only bins whose bound reaches it are
        read. ``report`` gets the numbers of bins and of bins read.
        """
        asked = [t for t in dict.fromkeys(query) if t != ALL]
        stats = self.statistics(asked, only)
        bounds = self.bounds(asked, stats)
        best = lambda rows: rows.orderBy(F.desc("bm25"), "doc_id").limit(k)
        # the first bins hold k documents at least, if the terms have as many
        first = bounds.orderBy(F.desc("bound"), "segment", "bin").limit(max(4, -(-2 * k // BIN) + 4))
        seen = best(self._scored(asked, stats, self._of(self._blocks(asked), first.collect()), only)).agg(F.count("*"), F.min("bm25")).first()
        threshold = seen[1] if seen[0] >= k else 0.0
        left = bounds.where(F.col("bound") + 10.0**-DIGITS >= threshold)
        few = left.select("segment", "bin").limit(LISTED + 1).collect()
        blocks = self._blocks(asked)
        blocks = self._of(blocks, few) if len(few) <= LISTED else blocks.join(left.select("segment", "bin"), ["segment", "bin"], "left_semi")
        if report is not None:
            report |= {"bins": bounds.count(), "read": left.count()}
        return best(self._scored(asked, stats, blocks, only))

    @staticmethod
    def _of(blocks: DataFrame, bins: list) -> DataFrame:
        """Blocks of some bins, by a filter that reaches the files."""
        by: dict[str, list[int]] = {}
        for r in bins:
            by.setdefault(r["segment"], []).append(r["bin"])
        hit = F.lit(False)
        for s, own in by.items():
            hit = hit | ((F.col("segment") == s) & F.col("bin").isin(own))
        return blocks.where(hit)
