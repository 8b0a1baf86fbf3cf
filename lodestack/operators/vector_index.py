"""An inverted file of vectors: k-means cells, vectors stored by cell, searches that read the nearest cells only."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..storage import materialize, new_folder
from .retrieval import Filters, dense

#: Rows at most that the cells are fitted on, rows that the number of probed cells is chosen on, and the recall it is chosen for.
SAMPLE, PROBE_QUERIES, TARGET = 200_000, 256, 0.95
#: Cells at most, and steps of k-means.
CELLS, ROUNDS = 65_536, 8
#: Vectors and queries that are multiplied at once.
VECTORS, QUERIES = 4_096, 512
#: Similarities of vectors to centroids that are held at once.
HELD = 1 << 21
#: The column that says a vector's cell; rows without a usable vector are in cell NONE, which only a search of all cells reads.
CELL, NONE = "ivf_cell", -1


def _unit(rows: Sequence, size: int) -> np.ndarray:
    """Rows scaled to length 1; what has no length or not this many finite components is all zeros."""
    fit = [i for i, r in enumerate(rows) if r is not None and len(r) == size]
    out = np.zeros((len(rows), size))
    if fit:
        out[fit] = np.array([rows[i] for i in fit], np.float64)
        out[~np.isfinite(out).all(axis=1)] = 0.0
        n = np.sqrt(np.einsum("ij,ij->i", out, out))
        out /= np.where(n == 0, 1.0, n)[:, None]
    return out


def _to_cells(unit: np.ndarray, centroids: np.ndarray, pick: Callable[[np.ndarray, slice], np.ndarray]) -> list[np.ndarray]:
    """``pick`` of the similarities of some vectors at a time to all centroids, so that memory doesn't grow with the product."""
    step = max(1, HELD // max(1, len(centroids)))
    return [pick(unit[i : i + step] @ centroids.T, slice(i, i + step)) for i in range(0, len(unit), step)]


def _cells_of(unit: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The number of every vector's most similar centroid."""
    return np.concatenate([np.zeros(0, np.int64), *_to_cells(unit, centroids, lambda s, _: np.argmax(s, axis=1))])


@dataclass
class VectorIndex:
    """Chunks stored by cell under ``folder``. ``probes`` cells are read per search unless said otherwise."""

    folder: str
    rows: DataFrame
    cells: list[int]
    centroids: np.ndarray
    probes: int
    vector: str = "embedding"

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> VectorIndex:
        """An index written before. Its cells come to the driver, at most CELLS rows; files are listed once."""
        head, *known = spark.read.parquet(f"{folder}/cells").orderBy("cell").collect()
        rows = spark.read.schema(StructType.fromJson(json.loads(head["layout"]))).parquet(f"{folder}/vectors")
        return cls(folder, rows, [r["cell"] for r in known], np.array([r["centroid"] for r in known]), head["probes"], head["vector"])

    def nearest(self, query: Sequence[float]) -> list[int]:
        """All cells, those of the most similar centroids first."""
        if not self.cells:
            return []
        q = _unit([query], self.centroids.shape[1])[0]
        return [self.cells[i] for i in np.argsort(-(self.centroids @ q), kind="stable")]

    def of_cells(self, cells: Sequence[int]) -> DataFrame:
        """Rows of some cells: a filter on the partition column, so other cells' files aren't read."""
        return self.rows.where(F.col(CELL).isin([int(c) for c in cells])).drop(CELL)

    def dense(self, query: Sequence[float], k: int, filters: Filters | None = None, probes: int | None = None) -> DataFrame:
        """As ``retrieval.dense``, over the nearest cells; twice as many are probed for as long as fewer than k rows pass the filters.

        With all cells probed the result is that of ``retrieval.dense`` over all rows. A result has at most k rows, which come to the driver.
        """
        order, n = self.nearest(query), max(1, probes or self.probes)
        while n < len(order):
            found = dense(self.of_cells(order[:n]), query, k, filters, self.vector)
            got = found.collect()
            if len(got) >= k:
                return self.rows.sparkSession.createDataFrame(got, found.schema)
            n *= 2
        return dense(self.rows.drop(CELL), query, k, filters, self.vector)

    def search(self, queries: DataFrame, k: int, probes: int | None = None, id_col: str = "doc_id", others: bool = False) -> DataFrame:
        """(query_id, id, score, rank) of the k most similar rows of every query (query_id, vector), cell by cell; with ``others`` a row never finds its own id.

        Queries meet the cells they probe in blocks of vectors and of queries; a block pair keeps k rows a query, and then
        a query's best are ranked. Neither side is broadcast, and a large cell is as many blocks as it needs.
        """
        order, size, n = np.array(self.cells, np.int64), self.centroids.shape[1] if self.cells else 0, max(1, probes or self.probes)
        centroids = self.centroids

        @F.pandas_udf("array<long>")
        def probed(v: pd.Series) -> pd.Series:
            best = _to_cells(_unit(list(v), size), centroids, lambda s, _: np.argsort(-s, axis=1, kind="stable")[:, :n].copy())
            return pd.Series([order[x] for part in best for x in part])

        asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
        asked = asked.select("query_id", "vector", F.explode(probed("vector")).alias("key"))
        rows = self.rows.where(F.col(CELL) != NONE).select(F.col(CELL).cast("long").alias("key"), F.col(id_col).alias("id"), F.col(self.vector).cast("array<double>").alias("vector"))
        return block_search(rows, asked, k, size, others)

    def append(self, chunks: DataFrame) -> VectorIndex:
        """The index with more rows in the cells it has; recall falls if they lie elsewhere than the rows it was built on."""
        _store(chunks, self.folder, self.cells, self.centroids, self.vector, "append")
        return VectorIndex.open(chunks.sparkSession, self.folder)


def block_search(rows: DataFrame, queries: DataFrame, k: int, size: int, others: bool = False) -> DataFrame:
    """(query_id, id, score, rank): the k best rows (key, id, vector) of each query (key, query_id, vector) among those of its keys, by cosine, ties by id."""
    # a key has as many blocks as its rows need, so a large one is spread like the others
    packed = []
    for df, name, most in ((rows, "id", VECTORS), (queries, "query_id", QUERIES)):
        n = df.groupBy("key").agg(F.ceil(F.count("*") / most).alias("n"))
        block = F.pmod(F.xxhash64(name), F.col("n")).alias(f"{name}_block")
        packed.append(df.join(n, "key").select("key", block, name, "vector").groupBy("key", f"{name}_block").agg(F.collect_list(F.struct(name, "vector")).alias(f"{name}s")))
    met = packed[0].join(packed[1], "key").select("ids", "query_ids")
    id_kind, query_kind = rows.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, asked in zip(b.column(0), b.column(1), strict=True):
                ids, asked = ids.values, asked.values
                a, q = (_unit(x.field("vector").to_pylist(), size) for x in (ids, asked))
                names, mine = ids.field(0).to_numpy(zero_copy_only=False), asked.field(0).to_numpy(zero_copy_only=False)
                by = np.argsort(names, kind="stable")  # so that a stable sort by score leaves ties to the smaller id
                names, s = names[by], q @ a[by].T
                if others:
                    s[mine[:, None] == names[None, :]] = -np.inf
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                got = np.take_along_axis(s, best, axis=1).ravel()
                keep = np.isfinite(got)
                cols = [np.repeat(mine, best.shape[1])[keep], names[best.ravel()][keep], got[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "id", "score"])

    found = met.mapInArrow(score, f"query_id {query_kind}, id {id_kind}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact_search(chunks: DataFrame, queries: DataFrame, k: int, size: int, vector: str = "embedding", id_col: str = "doc_id", others: bool = False) -> DataFrame:
    """As ``VectorIndex.search`` with all cells probed, without an index: every query meets every block."""
    n = max(1, math.ceil(chunks.count() / VECTORS))
    rows = chunks.where(F.col(vector).isNotNull()).select(F.pmod(F.xxhash64(F.lit(7), id_col), F.lit(n)).alias("key"), F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    asked = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("key"), "query_id", F.col("vector").cast("array<double>").alias("vector"))
    return block_search(rows, asked, k, size, others)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours that were found, over all queries together; 1 if there are none."""
    hit = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return float(hit.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0))).first()[0])


def _store(chunks: DataFrame, folder: str, cells: list[int], centroids: np.ndarray, vector: str, mode: str) -> None:
    if CELL in chunks.columns:
        raise ValueError(f"a column named {CELL}")
    order, size = np.array(cells, np.int32), centroids.shape[1] if cells else 0

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        unit = _unit(list(v), size)
        if not size:
            return pd.Series(np.full(len(v), NONE, np.int32))
        return pd.Series(np.where(unit.any(axis=1), order[_cells_of(unit, centroids)], NONE).astype(np.int32))

    # ranges of (cell, hash): a large cell is written by several tasks, small ones share one
    rows = chunks.withColumn(CELL, cell(vector)).repartitionByRange(CELL, F.xxhash64(vector))
    rows.write.mode(mode).partitionBy(CELL).parquet(f"{folder}/vectors")


def build(chunks: DataFrame, folder: str | None = None, vector: str = "embedding", cells: int | None = None, probes: int | None = None, id_col: str = "doc_id", seed: int = 1) -> VectorIndex:
    """Fit cells on at most about SAMPLE rows, write every row into its cell, and choose how many cells to probe.

    By default there are as many cells as the root of the rows, and the fewest probes that find TARGET of the exact 25 neighbours of
    PROBE_QUERIES rows. Vectors that are null, of another length than most, not finite or zero are kept apart; without any usable vector there is one empty list of cells.
    """
    spark = chunks.sparkSession
    folder = folder or new_folder(spark, "vectors")
    usable = chunks.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(id_col).alias("query_id"), F.col(vector).cast("array<double>").alias("vector"))
    usable = usable.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0))
    stat = usable.agg(F.count("*").alias("n"), F.mode(F.size("vector")).alias("size")).first()
    if not stat["n"]:
        centroids, known = np.empty((0, 0)), []
    else:
        usable = usable.where(F.size("vector") == stat["size"])
        part = materialize(usable.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, SAMPLE / stat["n"]))), "sample")
        k = max(1, min(CELLS, cells or round(math.sqrt(stat["n"]))))
        model = KMeans(k=k, distanceMeasure="cosine", maxIter=ROUNDS, seed=seed, featuresCol="v").fit(part.select(array_to_vector("vector").alias("v"))) if k > 1 else None
        centroids = _unit(model.clusterCenters() if model else [part.select("vector").first()[0]], stat["size"])
        known = list(range(len(centroids)))
    _store(chunks, folder, known, centroids, vector, "overwrite")

    def save(probes: int) -> VectorIndex:
        layout = StructType([*chunks.schema.fields, StructField(CELL, IntegerType())]).json()
        rows = [(NONE, [], probes, vector, layout), *((c, [float(x) for x in v], None, None, None) for c, v in zip(known, centroids, strict=True))]
        spark.createDataFrame(rows, "cell int, centroid array<double>, probes int, vector string, layout string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/cells")
        return VectorIndex.open(spark, folder)

    if probes or not known:
        return save(probes or 1)
    found = VectorIndex(folder, spark.read.parquet(f"{folder}/vectors"), known, centroids, 1, vector)
    asked = materialize(part.where(F.col("query_id").isNotNull()).orderBy(F.xxhash64("query_id")).limit(PROBE_QUERIES), "asked")
    exact = materialize(exact_search(chunks.where(F.size(vector) == stat["size"]), asked, 25, stat["size"], vector, id_col, others=True), "exact")
    # a neighbour is found if its cell is among those probed, so one pass tells the recall of every number of probes
    of = found.rows.where(F.col(CELL) != NONE).select(F.col(id_col).alias("id"), F.col(CELL).alias("cell"))

    @F.pandas_udf("int")
    def place(v: pd.Series, cell: pd.Series) -> pd.Series:
        own = cell.to_numpy()[:, None]
        at = _to_cells(_unit(list(v), centroids.shape[1]), centroids, lambda s, i: np.argmax(np.argsort(-s, axis=1, kind="stable") == own[i], axis=1))
        return pd.Series(np.concatenate([np.zeros(0, np.int64), *at]).astype(np.int32) + 1)

    at = exact.join(of, "id").join(asked, "query_id").select(place("vector", "cell").alias("probes")).groupBy("probes").count().orderBy("probes").collect()
    total, reached = sum(r["count"] for r in at), 0
    for r in at:
        reached += r["count"]
        if reached >= TARGET * total:
            return save(r["probes"])
    return save(len(known))
