"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, verified Hamming distance, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import connected_components, materialize, need, tidy

#: A run of a block key longer than this is split once more by the bits it does not share.
RUN_CAP = 16_384


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """Fingerprint of one UTF-8 text: A-Z lower-cased, words split at ASCII white space, majority of XXH64 bits.

    Null and texts without a word give 0; texts of fewer words than a shingle are one shingle.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h(b" ".join(words), seed)
    join = b" ".join
    hashes = np.array([h(join(s), seed) for s in zip(*(words[i:] for i in range(shingle)), strict=False)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):  # bounds the bits unpacked at once
        part = hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp) for every row; fp is the fingerprint as a signed long."""
    need(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in b.column(1).cast(pa.binary()).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"id {kind}, fp long")


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks of every choice of blocks - distance blocks of a 64-bit word.

    Two words within ``distance`` bits differ in at most that many blocks, so they agree on at least one choice.
    """
    if not distance < blocks <= 64:
        raise ValueError("more blocks than differing bits are needed, and at most 64")
    edge = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << edge[i + 1]) - (1 << edge[i])) for i in range(blocks)]
    return [sum(c) for c in combinations(block, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _linked(fps: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.uint64]]:
    """Components of ``fps`` (distinct) under Hamming distance, each with its first member: breadth-first over what is not yet reached, so a tight group costs one pass."""
    rest = fps
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        front, members = [root], []
        while front and len(rest):
            near = np.bitwise_count(rest ^ front.pop()) <= distance
            if near.any():
                got, rest = rest[near], rest[~near]
                front += list(got)
                members.append(got)
        if members:
            yield np.concatenate(members), root


def _runs(distance: int, cap: int | None):
    """Arrow function over rows (t, key, fp) sorted by them: links each run's components by star edges.

    Holds one run of at most ``cap`` fingerprints (8 bytes each); rows of longer runs come back with hot = true.
    """

    def emit(a: list, b: list) -> pa.RecordBatch:
        x, y = (np.concatenate(c) if c else np.empty(0, np.uint64) for c in (a, b))
        n = len(x)
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, bool)), pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["hot", "a", "b"])

    def hot(fps: np.ndarray) -> pa.RecordBatch:
        x = pa.array(fps.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(fps), bool)), x, x], ["hot", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last, size, over = None, 0, False

        def close(a: list, b: list) -> None:
            if not over and size > 1:
                for members, root in _linked(np.concatenate(held), distance):
                    a.append(members)
                    b.append(np.full(len(members), root))

        for batch in batches:
            if not batch.num_rows:
                continue
            t, key, fp = (batch.column(i).to_numpy() for i in range(3))
            fp = fp.view(np.uint64)
            cut = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(t)]
            a: list[np.ndarray] = []
            b: list[np.ndarray] = []
            # runs of two inside the batch, all at once
            inner = slice(1, -1)
            two = starts[inner][(ends - starts)[inner] == 2]
            near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
            a.append(fp[near + 1])
            b.append(fp[near])
            longer = [i for i in np.flatnonzero(ends - starts > 2) if 0 < i < len(starts) - 1]
            for i in dict.fromkeys([0, *longer, len(starts) - 1]):
                s, e = starts[i], ends[i]
                here = (t[s], key[s])
                if here != last:
                    close(a, b)
                    held, last, size, over = [], here, 0, False
                part = fp[s:e].copy()
                size += len(part)
                if cap and size > cap:
                    for x in [*held, part]:
                        yield hot(x)
                    held, over = [], True
                else:
                    held.append(part)
            yield emit(a, b)
        a, b = [], []
        close(a, b)
        yield emit(a, b)

    return run


def near_links(nodes: DataFrame, distance: int = 4, blocks: int = 7, cap: int = RUN_CAP) -> DataFrame:
    """Star edges (a, b) that join the same distinct fingerprints as all pairs within ``distance`` bits would.

    ``nodes`` has a long column ``fp`` of distinct values. Each is sent to one bucket per block choice, keyed by the
    bits of that choice; buckets are read in sorted runs and every edge is verified by Hamming distance. The members
    of runs over ``cap`` are dealt out again by choices of more and narrower blocks, which share more bits.
    """
    masks = block_masks(distance, blocks)
    schema = "hot boolean, a long, b long"

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition("t", "key").sortWithinPartitions("t", "key", "fp").select("t", "key", "fp")

    keyed = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "key"))
    found = materialize(dealt(keyed.select(F.col("t").cast("long").alias("t"), "key", "fp")).mapInArrow(_runs(distance, cap), schema), "links")
    finer = block_masks(distance, blocks + 2)
    again = found.where("hot").select(F.col("a").alias("fp")).distinct()
    again = again.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in finer])).alias("t", "key"))
    more = dealt(again.select(F.col("t").cast("long").alias("t"), "key", "fp")).mapInArrow(_runs(distance, None), schema)
    return found.where("not hot").select("a", "b").union(more.select("a", "b"))


def rooted(nodes: DataFrame, distance: int = 4) -> DataFrame:
    """``nodes`` (fp, least), fp distinct, with ``root``, the same for all fingerprints of a group, and ``component``, the smallest least of the group."""
    roots = connected_components(near_links(nodes, distance))
    known = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = known.groupBy("root").agg(F.min("least").alias("component"))
    return known.join(least, "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, shingle: int = 4) -> DataFrame:
    """One row per input row: (id, fingerprint as 16 hex digits, component).

    The component is the smallest id reachable over fingerprints that differ in at most ``distance`` bits. Null and
    wordless texts have fingerprint zero and are linked like any other; repeated rows share their component;
    null ids are kept and never name a component unless all its ids are null. Other columns of ``docs`` are not read.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "fps")
    nodes = materialize(fps.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    where = rooted(nodes, distance).select("fp", "component")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(where, "fp").select("id", text.alias("fingerprint"), "component")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    rows = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(F.col("id").alias("doc_id"), "fingerprint", F.col("component").alias("component_id"))
