"""Scores of texts from tables that no task and no driver has to hold whole.

A block is a run of adjacent rows. A first pass over the texts emits each block's distinct keys (n-grams or words),
which meet the sharded model in joins; a second pass packs the block's texts as numbers of words, and the values found
come back to it in a cogroup. So what is shuffled are distinct keys and packed words, and a task holds one block.
Both passes must see the same rows in the same partitions: rows that come out of a shuffle are written as a table first
(``settled``), and a block that comes back without its values raises.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .base import give_back, materialize, tidy

#: Bytes of text in a block, and one text more at most.
BLOCK = 32 << 20


def _raw(texts: pa.Array) -> tuple[np.ndarray, memoryview]:
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return ends, memoryview(data)[ends[0] : ends[-1]] if data is not None and len(ends) else memoryview(b"")


def blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(label, rows) of runs of rows (..., text last); the label is a hash of the texts, the partition and the run's place in it."""
    task = TaskContext.get()
    part, n = task.partitionId() if task else 0, 0
    held: list[pa.RecordBatch] = []
    got, h = 0, xxhash.xxh64()

    def close() -> tuple[int, pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        h.update(f"{part}:{n}".encode())
        return int(np.uint64(h.intdigest()).astype(np.int64)), table.to_batches(max_chunksize=max(1, table.num_rows))[0]

    for b in batches:
        ends, _ = _raw(b.column(b.num_columns - 1))
        at = 0
        while at < b.num_rows:
            upto = int(np.searchsorted(ends, ends[at] + size - got, "left"))
            rows = b.slice(at, max(1, min(upto, b.num_rows) - at))
            sizes, raw = _raw(rows.column(rows.num_columns - 1))
            h.update(raw)
            h.update(np.diff(sizes).tobytes())
            held.append(rows)
            got += len(raw)
            at += rows.num_rows
            if got >= size:
                yield close()
                held, got, h, n = [], 0, xxhash.xxh64(), n + 1
    if held:
        yield close()


def pieces(texts: pa.Array, size: int) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of runs of ``size`` bytes, and one text more at most."""
    wide = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(wide)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at] - wide[at]) + size, "left")) + 1)
        yield at, texts.slice(at, end - at)
        at = end


def split(texts: pa.Array, lower: bool = False, trim: str = "") -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(vocabulary, word numbers, words per text): words between white space, lower-cased and without the marks in ``trim`` around them if asked for. Null texts have none."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    words = lists.flatten().dictionary_encode()
    ids, vocabulary = words.indices.to_numpy(zero_copy_only=False), words.dictionary
    if lower or trim:
        plain = pc.utf8_lower(vocabulary) if lower else vocabulary
        plain = (pc.utf8_trim(plain, trim) if trim else plain).dictionary_encode()
        ids, vocabulary = plain.indices.to_numpy(zero_copy_only=False)[ids] if len(ids) else ids, plain.dictionary
    # white space around a text makes empty words
    empty = pc.index(vocabulary, "").as_py()
    if empty >= 0:
        keep = ids != empty
        size = np.bincount(np.repeat(np.arange(len(size)), size)[keep], minlength=len(size)).astype(np.int64)
        ids = ids[keep]
    return vocabulary, ids.astype(np.int32), size


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def strings(codes: np.ndarray) -> pa.Array:
    """Arrow strings of the rows of a matrix of code points."""
    wide = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    ends = np.r_[0, np.cumsum(wide.sum(axis=1))].astype(np.int64)
    data = codes.astype("<u4").tobytes().decode("utf-32-le").encode()
    return pa.LargeStringArray.from_buffers(len(codes), pa.py_buffer(ends.tobytes()), pa.py_buffer(data)).cast(pa.string())


def to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def pack_words(rows: pa.RecordBatch, vocabulary: pa.Array, ids: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """The rows with numbers of words in place of their text."""
    words = pa.DictionaryArray.from_arrays(pa.array(ids, pa.int32()), vocabulary.cast(pa.large_string()))
    lists = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int64()), words)
    return pa.RecordBatch.from_arrays([*rows.columns[:-1], lists], [*rows.schema.names[:-1], "words"])


def unpack_words(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    lists = batch.column(batch.num_columns - 1)
    return lists.values.dictionary, lists.values.indices.to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())


def settled(rows: DataFrame) -> DataFrame:
    """``rows`` if it is read off its source in place, else a table of it: partitions made by a shuffle differ from job to job."""
    return materialize(rows, "texts") if "Exchange" in rows._jdf.queryExecution().executedPlan().toString() else rows


def keys_of(rows: DataFrame, keys: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """(block, key): the distinct keys of the texts of every block of rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, b in blocks(batches):
            got = keys(b.column(b.num_columns - 1)).cast(pa.string())
            for at in range(0, len(got), 50_000):
                part = got.slice(at, 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), label)), part], ["block", "key"])

    return rows.select("text").mapInArrow(tidy(run), "block long, key string")


def fold(rows: DataFrame, pack: Callable[[pa.RecordBatch], pa.RecordBatch], values: DataFrame, score: Callable, schema: str) -> DataFrame:
    """score(packed block, keys, values) as columns beside the id of every row (id, text).

    ``values`` has (block, key, value) for the blocks of ``keys_of`` over the same rows.
    """
    kind = rows.schema["id"].dataType.simpleString()
    plain = to_arrow_schema(StructType.fromDDL(f"id {kind}")).field(0).type  # a null is allowed anywhere
    names = ["id", *[c.split()[0] for c in schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, b in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([label]), pa.array([to_bytes(pack(b))], pa.binary())], ["block", "packed"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return made(left, right)
        finally:
            give_back()

    def made(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            raise ValueError("the rows were dealt out otherwise in a second reading: write them as a table first")
        key, value = (pa.concat_arrays(right.column(c).chunks) if right.num_rows else pa.array([], t) for c, t in (("key", pa.string()), ("value", pa.float64())))
        parts = []
        for raw in left.column("packed"):
            b = pa.ipc.open_stream(raw.as_buffer()).read_next_batch()
            parts.append(pa.RecordBatch.from_arrays([b.column(0).cast(plain), *map(pa.array, score(b, key, value.to_numpy(zero_copy_only=False)))], names))
        return pa.Table.from_batches(parts)

    packed = rows.select("id", "text").mapInArrow(tidy(run), "block long, packed binary")
    return packed.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(meet, f"id {kind}, {schema}")
