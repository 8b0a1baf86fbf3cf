"""Token ids of whole texts in binary files of independently coded, checksummed blocks, written in order of the ids and read back."""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing_coder
from .base import materialize, need, new_folder, small

#: Blocks of a segment, at most, and symbols of a block, at least; a segment ends with the first document that brings it to SEGMENT ids.
BLOCKS, LEAST = 8, 512
SEGMENT = 1 << 22
#: Bytes after which a task starts a new file, and rows and bytes of text that are cut into words at once (a longer text alone).
ROLL, ROWS, BYTES = 512 << 20, 5_120, 8 << 20
#: Stretches that are copied at once.
COPIED = 1 << 17
#: Pieces of text, and characters in them, that a worker remembers before it forgets those it has not met since this last happened.
REMEMBER, CHARS = 400_000, 16_000_000

# --- ids of texts ------------------------------------------------------------------------------------------------------


class Pieces:
    """Ids of texts by a byte-level tokenizers file, each piece of text through the library once.

    The tokenizer's pattern never joins what stands before a single space between two other characters with what follows, and a space
    goes with the word after it, so texts are cut there; pieces are cut again between lines and before closing marks. What is done
    to every word is done by Arrow and numpy on distinct ones; only parts that are new go to the library.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        spec["truncation"] = spec["padding"] = None
        steps = spec.get("pre_tokenizer") or {}
        if steps.get("type") != "ByteLevel" or not steps.get("use_regex") or steps.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("needs a byte-level file with its own pattern, without prefix space or normalizer")
        if any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("special tokens must not take spaces")
        self.library = Tokenizer.from_str(json.dumps(spec))
        vocabulary = self.library.get_vocab()
        self.spaced = np.zeros(1 + max(vocabulary.values()), bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith(_SPACE)]] = True
        # letters, with a space before them or not, are one match of the pattern, so the library's model takes them as they are
        self.model = self.library.model
        self.lettered = not any(_LETTERS.search(t["content"]) and not _MARK.search(t["content"]) for t in spec["added_tokens"])
        write = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.bytes = {i: write(chr(i))[0][0] for i in range(256) if chr(i) == " " or _LETTERS.fullmatch(chr(i))}
        self.codes = 0
        self.forget()

    def forget(self) -> None:
        """Parts that were met since the last time become the older ones, which last until the next time."""
        self.older = (self.known, self.start, self.size, self.flat[: self.used].copy()) if self.codes else (({}, {}), *(np.zeros(0, np.int64),) * 3)
        # codes of parts as they are, and of parts with a space before them
        self.known: tuple[dict[str, int], dict[str, int]] = ({"": 0}, {})
        self.start, self.size, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)
        self.codes, self.used, self.chars = 1, 0, 0

    def _add(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        """The ids of the next codes, one after the other."""
        while self.codes + len(sizes) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[self.codes : self.codes + len(sizes)] = sizes
        self.start[self.codes : self.codes + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.codes, self.used = self.codes + len(sizes), self.used + len(ids)

    def _learn(self, new: list[str], spaced: bool) -> None:
        """Codes of new parts. Those of letters go to the library's model, the others through the library."""
        known = self.known[spaced]
        plain, run, alone = [], [], []
        letters = pc.match_substring_regex(pa.array(new, pa.large_string()), f"^{_LETTERS.pattern}$").to_pylist()
        for k, lettered in zip(new, letters, strict=True):
            x = " " + k if spaced else k
            if lettered and self.lettered:
                # the letters of ASCII are written as they are
                plain.append((k, (_SPACE + k if spaced else k) if k.isascii() else x.translate(self.bytes)))
            # pieces that begin with their only space are encoded as one text: the tokens that begin with a space tell where they start
            elif x.rfind(" ") == 0 and 1 < len(x) < 100 and not x[1].isspace() and not x[-1].isspace():
                run.append((k, x))
            else:
                alone.append((k, x))
        for group, kind in ((plain, "plain"), (run, "run"), (alone, "alone")):
            for i in range(0, len(group), 4_096):  # the library's results are large
                keys, part = zip(*group[i : i + 4_096], strict=True)
                if kind == "plain":
                    take = self.model.tokenize
                    got = [[t.id for t in take(x)] for x in part]
                else:
                    got = [e.ids for e in self.library.encode_batch_fast(["".join(part)] if kind == "run" else list(part), add_special_tokens=False)]
                ids = np.fromiter(chain.from_iterable(got), np.uint32)
                sizes = np.diff(np.append(np.flatnonzero(self.spaced[ids]), len(ids))) if kind == "run" else np.fromiter(map(len, got), np.int64, len(got))
                if len(sizes) != len(part):
                    raise ValueError("the tokenizer joins pieces across spaces")
                known.update(zip(keys, range(self.codes, self.codes + len(part)), strict=True))
                self._add(sizes, ids)
                self.chars += sum(map(len, part))

    def _codes(self, parts: pa.Array, spaced: bool = False) -> np.ndarray:
        """Codes of parts, with a space before each or as they are."""
        each = parts.dictionary_encode()
        keys, known = each.dictionary.to_numpy(zero_copy_only=False).tolist(), self.known[spaced]
        codes = list(map(known.get, keys))
        if new := [k for k, c in zip(keys, codes, strict=True) if c is None]:
            words, *older = self.older
            if back := [k for k in new if k in words[spaced]]:
                sizes, ids = _gather(*older, np.array([words[spaced][k] for k in back], np.int64))
                known.update(zip(back, range(self.codes, self.codes + len(back)), strict=True))
                self._add(sizes, ids)
                self.chars += sum(map(len, back))
                new = [k for k in new if k not in known]
            self._learn(new, spaced)
            codes = [known[k] if c is None else c for k, c in zip(keys, codes, strict=True)]
        return np.array(codes, np.int64)[each.indices.to_numpy()]

    def _lined(self, words: pa.Array, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the parts of words that are _PLAIN, three for each line, and how many each word has."""
        lines = pc.split_pattern(words, "\n")
        starts, line = lines.offsets.to_numpy().astype(np.int64), lines.flatten()
        starts -= starts[0]
        inner = np.ones(len(line), bool)
        inner[starts[:-1]] = False
        cut = pc.extract_regex(line, _ENDING)
        stem, marks = pc.coalesce(pc.struct_field(cut, "a"), line), pc.fill_null(pc.struct_field(cut, "b"), "")
        codes = np.zeros((len(line), 3), np.int64)
        if inner.any():
            codes[inner, 0] = self._codes(pa.array(["\n"], pa.large_string()))[0]
            codes[inner, 1] = self._codes(stem.filter(pa.array(inner)))
        codes[~inner, 1] = self._codes(stem.filter(pa.array(~inner)), spaced)
        codes[:, 2] = self._codes(marks)
        return codes.ravel(), 3 * np.diff(starts)

    def _cut(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of any pieces."""
        parts = [_parts(x) for x in pieces]
        flat = pa.array([x for xs in parts for x in xs], pa.large_string())
        return self._codes(flat), np.fromiter(map(len, parts), np.int64, len(parts))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and how many each text has. Null is the empty text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        if sum(map(len, self.known)) > REMEMBER or self.chars > CHARS:
            self.forget()
        split = pc.split_pattern(texts, " ")
        words, ends = split.flatten().dictionary_encode(), split.offsets.to_numpy()
        ends = ends - ends[0]
        distinct, at = words.dictionary, words.indices.to_numpy()
        plain = pc.match_substring_regex(distinct, _PLAIN).to_numpy(zero_copy_only=False)
        rare = np.flatnonzero(~plain)
        others = distinct.take(pa.array(rare)).to_pylist()
        # a cut is good if no white space stands beside it; else the text is cut by a pattern instead
        odd = np.zeros(len(distinct), bool)
        odd[rare] = np.fromiter((not w or w[0].isspace() or w[-1].isspace() for w in others), bool, len(others))
        bad = np.flatnonzero(np.logical_or.reduceat(odd[at], ends[:-1]))
        own = [[x if not k else " " + x for k, x in enumerate(_CUTS.split(texts[int(i)].as_py()))] for i in bad]
        firsts, back = np.unique(at[ends[:-1]], return_inverse=True)
        lead = plain[firsts]
        # all different pieces, by kind: words after a space, words that a text begins with, pieces of texts cut by the pattern
        got = [
            self._lined(distinct.filter(pa.array(plain)), True),
            self._cut([" " + w for w in others]),
            self._lined(distinct.take(pa.array(firsts[lead])), False),
            self._cut(distinct.take(pa.array(firsts[~lead])).to_pylist()),
            self._cut([x for xs in own for x in xs]),
        ]
        upto = np.cumsum([len(n) for _, n in got])
        number, first = np.empty(len(distinct), np.int64), np.empty(len(firsts), np.int64)
        number[plain], number[rare] = np.arange(upto[0]), np.arange(upto[0], upto[1])
        first[lead], first[~lead] = np.arange(upto[1], upto[2]), np.arange(upto[2], upto[3])
        parts, n = (np.concatenate(x) for x in zip(*got, strict=True))
        sizes, flat = _gather(self.start, self.size, self.flat, parts)
        sizes = np.add.reduceat(sizes, np.cumsum(n) - n)
        start = np.cumsum(sizes) - sizes
        codes, count = number[at], np.diff(ends)
        codes[ends[:-1]] = first[back]
        if len(bad):
            runs, done, mine = [], 0, int(upto[3])
            for i, xs in zip(bad, own, strict=True):
                runs += [codes[ends[done] : ends[i]], np.arange(mine, mine + len(xs))]
                count[i], done, mine = len(xs), i + 1, mine + len(xs)
            codes = np.concatenate([*runs, codes[ends[done] :]])
        sizes, ids = _gather(start, sizes, flat, codes)
        return ids, np.add.reduceat(sizes, np.cumsum(count) - count)


def _gather(start: np.ndarray, size: np.ndarray, flat: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the codes, and their stretches of ``flat`` one after the other."""
    sizes = size[codes]
    upto = np.cumsum(sizes)
    out = np.empty(int(upto[-1]) if len(upto) else 0, flat.dtype)
    done = 0
    for i in range(0, len(codes), COPIED):
        part = slice(i, i + COPIED)
        ends = upto[part]
        at = np.repeat(start[codes[part]] - (ends - sizes[part]), sizes[part])
        at += np.arange(done, int(ends[-1]))
        out[done : int(ends[-1])] = flat.take(at)
        done = int(ends[-1])
    return sizes, out


def _slices(texts: pa.Array) -> list[tuple[int, int]]:
    """Even stretches of rows, none of more than ROWS rows or, but for a row alone, BYTES bytes."""
    n = len(texts)
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    cost = np.cumsum(size / BYTES + 1 / ROWS)
    parts = int(np.ceil(cost[-1])) if n else 0
    edges = np.unique([0, *np.searchsorted(cost, np.arange(1, parts) * (cost[-1] / parts if n else 0)), n]).tolist()
    return list(zip(edges, edges[1:], strict=False))


def _parts(piece: str) -> list[str]:
    """A piece cut between its lines, a cut that the pattern makes in any case."""
    return [x for i, line in enumerate(_LINES.split(piece)) for x in (("\n", line) if i else (line,))] if "\n" in piece else [piece]


#: How a byte-level vocabulary writes a space.
_SPACE = "\u0120"
#: Words whose lines have no white space but the ends of lines between them.
_PLAIN = "^[!-~\u00a1-\u024f]+(\n[!-~\u00a1-\u024f]+)*$"
#: Letters, and marks behind them that no contraction begins with: the pattern cuts between them in any case.
_LETTERS = re.compile("[A-Za-zß-öø-ÿ]+")
_MARK = re.compile("[^A-Za-zß-öø-ÿ]")
_ENDING = "^(?P<a>[A-Za-zß-öø-ÿ]+)(?P<b>[.,;:!?|]*)$"
_CUTS = re.compile(r"(?<=\S) (?=\S)")
_LINES = re.compile(r"(?<=\S)\n(?=\S)")
_PIECES: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    """One memory of pieces per worker process and file."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


# --- segments ----------------------------------------------------------------------------------------------------------

MAGIC = b"LTOK2\n"
_HEAD = struct.Struct("<6sIIIIIIII")
#: Rounds in which frequent pairs of symbols become symbols, pairs of a round at most, how often one must occur, and symbols that are paired.
ROUNDS, PAIRS, TIMES, NEAR = 2, 6_000, 64, 1_536


def _paired(x: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols with the most frequent pairs of those under NEAR as new ones from ``d`` on, and these pairs. Pairs that overlap are taken from left to right."""
    side = NEAR + 1
    y = np.minimum(x, NEAR)
    key = y[:-1].astype(np.int64) * side
    key += y[1:]
    del y
    count = np.bincount(key, minlength=side * side)
    count.reshape(side, side)[NEAR] = count.reshape(side, side)[:, NEAR] = 0
    picked = np.flatnonzero(count >= TIMES)
    if len(picked) > PAIRS:
        picked = np.sort(picked[np.argsort(-count[picked], kind="stable")[:PAIRS]])
    del count
    number = np.full(side * side, -1, np.int32)
    number[picked] = np.arange(d, d + len(picked))
    new = number.take(key)
    del key, number
    at = np.flatnonzero(new >= 0)
    new = new[at]
    place = np.arange(len(at))
    begin = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, place, 0))
    place -= begin
    take = place % 2 == 0
    del place, begin
    at, new = at[take], new[take]
    x = x.copy()
    x[at] = new
    keep = np.ones(len(x), bool)
    keep[at + 1] = False
    return x[keep], np.stack([picked // side, picked % side], 1)


def symbols_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids as fewer symbols: how many ids each symbol stands for, these one after the other, and the ids in symbols. Symbols are numbered by how often
    they come, so what is frequent lies together in the coder's tables."""
    if len(ids) and int(ids.max()) >= 1 << 22:
        flat, x = np.unique(ids, return_inverse=True)
    else:
        flat, x = np.arange(int(ids.max()) + 1 if len(ids) else 0), ids
    size = np.ones(len(flat), np.int64)
    for i in range(ROUNDS + 1):
        f = np.bincount(x, minlength=len(size))
        order = np.argsort(-f, kind="stable")[: np.count_nonzero(f)]
        rank = np.zeros(len(size), np.int32)
        rank[order] = np.arange(len(order))
        x = rank.take(x)
        size, flat = _gather(np.cumsum(size) - size, size, flat, order)
        if i < ROUNDS and len(x) > 1:
            x, pairs = _paired(x, len(size))
            sizes, more = _gather(np.cumsum(size) - size, size, flat, pairs.ravel())
            size, flat = np.concatenate([size, sizes.reshape(-1, 2).sum(1)]), np.concatenate([flat, more])
    return size, flat, x


def pack(ids: np.ndarray, keys: list[int | None], sizes: list[int]) -> bytes:
    """One segment: a checksummed header with its dictionary of symbols, prior, documents and blocks, then the blocks."""
    size, flat, x = symbols_of(ids)
    prior = mixing_coder.prior_of(x, len(size))
    block = max(LEAST, -(-len(x) // BLOCKS))
    lengths = np.full(-(-len(x) // block), block, np.int64)
    lengths[-1:] = len(x) - block * (len(lengths) - 1)
    blocks = mixing_coder.encode(x, lengths, prior)
    raw = np.ascontiguousarray(ids, "<u4")
    ends = np.cumsum(np.add.reduceat(size[x], np.cumsum(lengths) - lengths) if len(x) else size[:0]).tolist()
    table = np.array([[len(b), zlib.crc32(raw[i:j])] for b, i, j in zip(blocks, [0, *ends], ends, strict=False)], "<u4")
    docs = np.array([[0 if k is None else k, k is None, n] for k, n in zip(keys, sizes, strict=True)], "<i8")
    parts = [zlib.compress(x.tobytes(), 4) for x in (size.astype("<u4"), flat.astype("<u4"), prior.astype("<u4"), docs, table)]
    head = _HEAD.pack(MAGIC, block, len(blocks), len(x), *map(len, parts)) + b"".join(parts)
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(blocks)


@dataclass
class Segment:
    """A segment whose header has been read and found whole. Any block can be decoded without the others."""

    keys: list[int | None]
    sizes: np.ndarray
    widths: np.ndarray
    values: np.ndarray
    prior: np.ndarray
    lengths: np.ndarray
    checks: np.ndarray
    blocks: list[bytes]

    @classmethod
    def parse(cls, raw: bytes) -> Segment:
        if len(raw) < _HEAD.size or raw[:6] != MAGIC:
            raise ValueError("not a segment of token ids")
        _, block, n_blocks, n, *lens = _HEAD.unpack_from(raw)
        at = _HEAD.size + sum(lens)
        if at + 4 > len(raw) or struct.unpack_from("<I", raw, at)[0] != zlib.crc32(raw[:at]):
            raise ValueError("a damaged segment header")
        ends = _HEAD.size + np.cumsum([0, *lens])
        widths, values, prior, docs, table = (np.frombuffer(zlib.decompress(raw[i:j]), t) for i, j, t in zip(ends, ends[1:], ("<u4", "<u4", "<u4", "<i8", "<u4"), strict=False))
        docs, table = docs.reshape(-1, 3), table.reshape(-1, 2)
        starts = at + 4 + np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
        if starts[-1] != len(raw):
            raise ValueError("a segment cut short")
        lengths = np.full(n_blocks, block, np.int64)
        lengths[-1:] = n - block * (n_blocks - 1)
        keys = [None if absent else k for k, absent in docs[:, :2].tolist()]
        return cls(keys, docs[:, 2], widths.astype(np.int64), values, prior.astype(np.int64), lengths, table[:, 1], [raw[i:j] for i, j in zip(starts, starts[1:], strict=False)])

    def ids(self, only: slice = slice(None)) -> np.ndarray:
        """Ids of the blocks, or of some of them, each held against its checksum."""
        lengths = self.lengths[only]
        dense = mixing_coder.decode(self.blocks[only], lengths, self.prior)
        widths = self.widths
        sizes, out = _gather(np.cumsum(widths) - widths, widths, self.values, np.minimum(dense, max(0, len(widths) - 1)))
        out = np.ascontiguousarray(out, "<u4")
        upto = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(lengths)])].tolist()
        for i, (start, end) in enumerate(zip(upto, upto[1:], strict=False)):
            if zlib.crc32(out[start:end]) != self.checks[only][i]:
                raise ValueError(f"a damaged block of token ids: {i}")
        return out


# --- files ---------------------------------------------------------------------------------------------------------------

SEGMENTS = "part int, seq int, file string, offset long, length long, docs long, tokens long"


@dataclass
class TokenFiles:
    """A folder of files and the list of their segments, in the order of the ids: by part, then by seq."""

    folder: str
    segments: DataFrame

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> TokenFiles:
        return cls(folder, spark.read.schema(SEGMENTS).parquet(f"{folder}/segments"))


def write(docs: DataFrame, path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end: int = 0) -> TokenFiles:
    """Encode every whole text by the tokenizers file ``path``, append ``end`` to each, and write the ids in ascending order of the documents' ids.

    Null texts are empty, null ids come first, rows of one id stand next to each other in no order that is promised. Rows are dealt out in
    ranges of (id, a number of the row), so an id with a third of all rows is split too. Every task attempt writes files of its own
    name, and only segments that a finished attempt returned are listed, so lost executors leave at most unread files.
    """
    need(docs, id_col, text_col)
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base)
        pieces, part = pieces_of(path), TaskContext.get().partitionId()
        out, name, at, seq = None, None, 0, 0
        held: list[np.ndarray] = []
        keys: list[int | None] = []
        sizes: list[int] = []
        n = 0

        def flush() -> tuple:
            nonlocal out, name, at, seq, n
            if out is None or at > ROLL:
                if out is not None:
                    out.close()
                name, at = f"tokens-{part:06d}-{uuid.uuid4().hex}.bin", 0
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            ids = np.concatenate(held)
            held.clear()
            raw = pack(ids, keys, sizes)
            out.write(raw)
            row = (part, seq, name, at, len(raw), len(keys), n)
            at, seq, n = at + len(raw), seq + 1, 0
            keys.clear(), sizes.clear()
            return row

        rows = []
        for batch in batches:
            for i, j in _slices(batch.column(1)):
                b = batch.slice(i, j - i)
                ids, counts = pieces.encode(b.column(1))
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end)
                ends += np.arange(1, len(ends) + 1)
                done = 0
                for key, stop, size in zip(b.column(0).to_pylist(), ends.tolist(), (counts + 1).tolist(), strict=True):
                    keys.append(key)
                    sizes.append(size)
                    n += size
                    if n >= SEGMENT:
                        held.append(ids[done:stop])
                        done = stop
                        rows.append(flush())
                if done < len(ids):
                    held.append(ids[done:])
        if keys:
            rows.append(flush())
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_KINDS)], [c.split()[0] for c in SEGMENTS.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("id", "row").sortWithinPartitions("id", "row").select("id", "text")
    rows.mapInArrow(run, SEGMENTS).write.parquet(f"{folder}/segments")
    return TokenFiles.open(spark, folder)


_KINDS = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())


def read(files: TokenFiles, ids: bool = True) -> DataFrame:
    """(id, start, n_tokens, ids_crc32 and, if asked for, ids) of every document, from the files.

    ``start`` counts the ids of all documents before. Segments are dealt out one to a task or a few; what comes to the driver is a number per written partition.
    Damaged headers and blocks raise.
    """
    spark, folder = files.segments.sparkSession, files.folder
    total, starts = 0, []
    for part, tokens in files.segments.groupBy("part").agg(F.sum("tokens")).orderBy("part").collect():
        starts.append((part, total))
        total += tokens
    before = spark.createDataFrame(starts, "part int, first long")
    w = "sum(tokens) OVER (PARTITION BY part ORDER BY seq) - tokens"
    listed = files.segments.join(small(before), "part").select("file", "offset", "length", (F.col("first") + F.expr(w)).alias("start"))
    listed = materialize(listed, "segments")
    n = listed.count()
    names = ["id", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for file, offset, length, start in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                with fs.open_input_file(f"{base}/{file}") as f:
                    f.seek(offset)
                    s = Segment.parse(f.read(length))
                got, ends = s.ids(), np.cumsum(s.sizes)
                crc = [zlib.crc32(got[j - k : j]) for j, k in zip(ends.tolist(), s.sizes.tolist(), strict=True)]
                cols = [pa.array(s.keys, pa.int64()), pa.array(start + ends - s.sizes, pa.int64()), pa.array(s.sizes, pa.int64()), pa.array(crc, pa.int64())]
                if ids:
                    cols.append(pa.LargeListArray.from_arrays(np.concatenate([[0], ends]), pa.array(got.astype(np.int64))).cast(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")
    return listed.repartition(max(1, n)).mapInArrow(run, schema)


def op11_token_files(spark, sf_dir: str) -> DataFrame:
    """``write`` and ``read`` of all documents; nulls, empty texts and repeated rows as there, an empty table gives no rows."""
    import public_tokenizers

    files = write(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return read(files, ids=False).withColumnRenamed("id", "doc_id")
