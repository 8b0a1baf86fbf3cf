"""Language identification by unigram piece models summed over all segmentations of a text.

Pieces are those of a fixed public vocabulary; only their probabilities are learned, per language, by expectation
maximisation over all segmentations. Pieces of that vocabulary never cross white space, so a text's likelihood is the
product over its words and each distinct word needs the forward algorithm once per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import crc_mod, materialize, need
from .blocks import blocks, split

ROUNDS = 2
#: Languages that one model may have: its table has vocabulary x languages numbers, which bounds what is broadcast.
MAX_LANGS = 400
#: Distinct words that a task holds.
HOLD = 400_000
#: Probability of a character that no piece covers, in every language.
UNKNOWN = 1e-9
BLANK = "▁"
#: Longer words are learned from by logarithms of states: up to here UNKNOWN per character stays within floating point.
PLAIN = 32
#: Characters of long words whose pieces are held at once.
CELLS = 100_000
_MUL = np.uint64(0x9E3779B97F4A7C15)


_ABSENT = -2


def _matrix(words: list[str], width: int) -> np.ndarray:
    """Code points of words, from 1 on, and 0 past their end."""
    text = "".join([w.ljust(width, "\0") for w in words])
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").reshape(len(words), width) + np.uint32(1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    codes[np.arange(width) >= size[:, None]] = 0
    return codes


def _slots(h: np.ndarray, ids: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Hash tables of hashes and their numbers: what finds its slot taken goes to the next table."""
    tables = []
    while len(h):
        bits = max(2, int(4 * len(h)).bit_length())
        keys, values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, _ABSENT, np.int32)
        slot = (h * (_MUL + np.uint64(2 * len(tables)))) >> np.uint64(64 - bits)
        keys[slot], values[slot] = h, ids
        tables.append((bits, keys, values))
        out = keys[slot] != h
        h, ids = h[out], ids[out]
    return tables


def _find(tables: list[tuple[int, np.ndarray, np.ndarray]], h: np.ndarray) -> np.ndarray:
    """The number of every hash, or _ABSENT."""
    out = np.full(len(h), _ABSENT, np.int32)
    rest = np.arange(len(h))
    for i, (bits, keys, values) in enumerate(tables):
        mine = h[rest] if i else h
        slot = (mine * (_MUL + np.uint64(2 * i))) >> np.uint64(64 - bits)
        hit = (keys[slot] == mine) & (values[slot] > _ABSENT)
        out[rest[hit]] = values[slot[hit]]
        # an empty slot ends the search: nothing with this hash was ever turned away from it
        rest = rest[~hit & (values[slot] > _ABSENT)]
        if not len(rest):
            break
    return out


class Pieces:
    """The vocabulary as a trie by length: hashes of all prefixes, with the piece that a prefix is, or -1."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        names = sorted({p for p in names if p and BLANK not in p[1:]})
        self.names = names
        self.size = len(names)
        self.longest = max(map(len, names))
        place = {p: i for i, p in enumerate(names)}
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        for n in range(1, self.longest + 1):
            prefixes = sorted({p[:n] for p in names if len(p) >= n})
            codes = _matrix(prefixes, n)
            h = np.zeros(len(prefixes), np.uint64)
            for j in range(n):
                h = self.mix(h, codes[:, j])
            self.levels.append(_slots(h, np.array([place.get(p, -1) for p in prefixes], np.int32)))

    @staticmethod
    def mix(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
        h = (h ^ codes.astype(np.uint64)) * _MUL
        return h ^ (h >> np.uint64(29))

    def walk(self, columns: np.ndarray, start: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, rows, piece) of the pieces that begin at ``start``; ``columns`` is positions x rows, 0 past the end."""
        rows = np.flatnonzero(columns[start])
        h = np.zeros(len(rows), np.uint64)
        for n in range(1, min(self.longest, len(columns) - start) + 1):
            h = self.mix(h, columns[start + n - 1][rows])
            piece = _find(self.levels[n - 1], h)
            on = piece > _ABSENT
            rows, h, piece = rows[on], h[on], piece[on]
            if not len(rows):
                return
            is_piece = piece >= 0
            if is_piece.any():
                yield n, rows[is_piece], piece[is_piece]
            if start + n < len(columns):
                more = columns[start + n][rows] != 0
                rows, h = rows[more], h[more]
                if not len(rows):
                    return

    def found(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(end, length, rows, piece) of every piece in the rows of a matrix (see ``_matrix``)."""
        columns = np.ascontiguousarray(codes.T)
        for start in range(len(columns)):
            for n, rows, ids in self.walk(columns, start):
                yield start + n, n, rows, ids


def _grouped(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, code points) of words of about the same length, with the blank that starts a word in front."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    way = np.argsort(size, kind="stable")
    at = 0
    while at < len(way):
        upto = at
        # a matrix of bounded size whose rows differ little in length
        while upto < len(way) and upto - at < 20_000 and (upto - at + 1) * size[way[upto]] < 400_000 and size[way[upto]] <= size[way[at]] + 2:
            upto += 1
        upto = max(upto, at + 1)
        rows = way[at:upto]
        width = size[rows[-1]]
        yield rows, _matrix([BLANK + words[r] for r in rows], width)
        at = upto


def forward(pieces: Pieces, table: np.ndarray, words: list[str]) -> np.ndarray:
    """log P(word | language): the sum over all segmentations. ``table`` is pieces x languages probabilities."""
    out = np.empty((len(words), table.shape[1]))
    for rows, codes in _grouped(words):
        if codes.shape[1] > 400:
            out[rows] = [_forward_long(pieces, table, c) for c in codes]
            continue
        alpha, scale = _alpha(pieces, table, codes)
        ends = (codes != 0).sum(axis=1)
        out[rows] = np.log(np.maximum(alpha[ends, np.arange(len(rows))], 1e-300)) + scale[:, None]
    return out


def _alpha(pieces: Pieces, table: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    alpha = np.zeros((codes.shape[1] + 1, len(codes), table.shape[1]))
    alpha[0] = 1.0
    steps: dict[int, list] = {}
    for end, n, rows, ids in pieces.found(codes):
        steps.setdefault(end, []).append((n, rows, ids))
    scale = np.zeros(len(codes))
    for end in range(1, codes.shape[1] + 1):
        now = alpha[end]
        now += alpha[end - 1] * UNKNOWN
        for n, rows, ids in steps.get(end, ()):
            now[rows] += alpha[end - n, rows] * table[ids]
        if end % 24 == 0:  # keeps long words within floating point: rescale all states that later ones read
            top = now.max(axis=1)
            back = alpha[max(0, end - pieces.longest) : end + 1]
            back /= top[None, :, None]
            for k in range(len(codes)):
                if not codes[k, end - 1]:  # ended before: its own last state must not change
                    back[:, k] *= top[k]
                else:
                    scale[k] += np.log(top[k])
    return alpha, scale


def _forward_long(pieces: Pieces, table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """One very long word, in blocks of states, so that memory is linear in its length."""
    codes = codes[codes != 0]
    width = len(codes)
    ids = np.full((pieces.longest + 1, width + 1), -1, np.int32)
    # every suffix is a row of its own, cut to the longest piece
    padded = np.r_[codes, np.zeros(pieces.longest, codes.dtype)]
    columns = np.stack([padded[j : j + width] for j in range(pieces.longest)])
    for n, rows, own in pieces.walk(columns, 0):
        ids[n, rows + n] = own
    recent = np.zeros((pieces.longest + 1, table.shape[1]))  # recent[n]: the state n characters back
    recent[1] = 1.0
    total = 0.0
    for end in range(1, width + 1):
        n = np.flatnonzero(ids[:, end] >= 0)
        now = recent[1] * UNKNOWN
        if len(n):
            now = now + (recent[n] * table[ids[n, end]]).sum(axis=0)
        recent[2:] = recent[1:-1]
        recent[1] = now
        top = now.max()
        recent[1:] /= top
        total += np.log(top)
    return np.log(np.maximum(recent[1], 1e-300)) + total


def _pieces_at(pieces: Pieces, columns: np.ndarray, start: int, end: int) -> np.ndarray:
    """(start, length - 1, row) of the piece that begins there, or -1; ``columns`` is positions x rows, 0 past the end."""
    rows = columns.shape[1]
    ids = np.full((end - start, pieces.longest, rows), -1, np.int32)
    ahead = np.stack([columns[start + j : end + j].ravel() for j in range(pieces.longest)])
    for n, at, own in pieces.walk(ahead, 0):
        ids[at // rows, n - 1, at % rows] = own
    return ids


def _count_long(pieces: Pieces, table: np.ndarray, words: list[str], weights: np.ndarray, total: np.ndarray) -> None:
    """Add the expected uses of pieces in words of any length of about the same size, shortest first, to ``total``.

    States are held as logarithms; what a step reads is relative to the last state. Pieces are held for blocks of
    CELLS characters, so beyond them memory is 16 bytes a character.
    """
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    width, n_words, longest = int(size[-1]), len(words), pieces.longest
    codes = _matrix([BLANK + w for w in words], width)
    columns = np.zeros((width + longest, n_words), codes.dtype)
    columns[:width] = codes.T
    step = max(1, CELLS // n_words)
    blocks = [(s, min(width, s + step)) for s in range(0, width, step)]
    first = np.searchsorted(size, np.arange(width), "right")  # words that go on after each position
    for k in range(table.shape[1]):
        chance = np.append(table[:, k], 0.0)
        # forward: ahead[n - 1] is the state n characters on, as far as it is known, over the state here
        before, ahead = np.zeros((width + 1, n_words)), np.zeros((longest, n_words))
        for s, e in blocks:
            p = chance[_pieces_at(pieces, columns, s, e)]
            for at in range(s, e):
                f = first[at]
                own = ahead[:, f:]
                own += p[at - s, :, f:]
                own[0] += UNKNOWN
                now = own[0].copy()
                before[at + 1, f:] = before[at, f:] + np.log(now)
                own[:-1] = own[1:] / now
                own[-1] = 0.0
        all_ways = before[size, np.arange(n_words)]
        # backward: ahead[n - 1] is the state n characters on over the next one
        after, ahead = np.zeros((width + 1, n_words)), np.zeros((longest, n_words))
        ahead[0] = 1.0
        for s, e in reversed(blocks):
            ids = _pieces_at(pieces, columns, s, e)
            use = chance[ids]
            for at in range(e - 1, s - 1, -1):
                f = first[at]
                own, part = ahead[:, f:], use[at - s, :, f:]
                part *= own
                now = part.sum(axis=0) + UNKNOWN
                after[at, f:] = after[at + 1, f:] + np.log(now)
                own[1:] = own[:-1] / now
                own[0] = 1.0
            where = np.nonzero(ids >= 0)
            share = np.exp(before[s:e] + after[s + 1 : e + 1] - all_ways) * weights[:, k]
            total[:, k] += np.bincount(ids[where], use[where] * share[where[0], where[2]], pieces.size)


def expected_counts(pieces: Pieces, table: np.ndarray, words: list[str], weights: np.ndarray) -> np.ndarray:
    """Expected uses of each piece by language, over words of any length; weights is words x languages counts."""
    total = np.zeros_like(table)
    size = np.fromiter(map(len, words), np.int64, len(words))
    way = np.argsort(size, kind="stable")
    at = int(np.searchsorted(size[way], PLAIN, "right"))
    short, long = way[:at], way[at:]
    at = 0
    while at < len(long):
        upto = at + 1
        while upto < len(long) and (upto - at + 1) * size[long[upto]] <= CELLS and size[long[upto]] <= 1.25 * size[long[at]]:
            upto += 1
        _count_long(pieces, table, [words[i] for i in long[at:upto]], weights[long[at:upto]], total)
        at = upto
    words, weights = [words[i] for i in short], weights[short]
    for rows, codes in _grouped(words):
        steps = list(pieces.found(codes))
        width, langs = codes.shape[1], table.shape[1]
        alpha = np.zeros((width + 1, len(rows), langs))
        alpha[0] = 1.0
        by_end: dict[int, list] = {}
        by_start: dict[int, list] = {}
        for end, n, r, ids in steps:
            by_end.setdefault(end, []).append((n, r, ids))
            by_start.setdefault(end - n, []).append((n, r, ids))
        for end in range(1, width + 1):
            alpha[end] += alpha[end - 1] * UNKNOWN
            for n, r, ids in by_end.get(end, ()):
                alpha[end, r] += alpha[end - n, r] * table[ids]
        ends = (codes != 0).sum(axis=1)
        beta = np.zeros_like(alpha)
        beta[ends, np.arange(len(rows))] = 1.0
        for start in range(width - 1, -1, -1):
            live = start < ends
            beta[start, live] += beta[start + 1, live] * UNKNOWN
            for n, r, ids in by_start.get(start, ()):
                beta[start, r] += beta[start + n, r] * table[ids]
        z = np.maximum(alpha[ends, np.arange(len(rows))], 1e-300)
        w = weights[rows] / z
        for end, n, r, ids in steps:
            use = alpha[end - n, r] * table[ids] * beta[end, r] * w[r]
            for k in range(langs):
                total[:, k] += np.bincount(ids, use[:, k], pieces.size)
    return total


_PIECES: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) over whole texts of rows (text, lang): summed by block first, then by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b in blocks(batches):
            words, ids, size = split(b.column(1), lower=True)
            langs = b.column(0).dictionary_encode()
            own = np.repeat(langs.indices.to_numpy(zero_copy_only=False), size)
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                n = np.bincount(ids[own == k], minlength=len(words))
                at = np.flatnonzero(n)
                for i in range(0, len(at), 50_000):
                    part = at[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), words.take(pa.array(part)).cast(pa.string()), pa.array(n[part])], ["lang", "word", "n"])

    return texts.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learn(texts: DataFrame, path: str, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their piece probabilities, from all rows (text, lang) with a language; null texts have no words, repeated rows count each time, without rows there is no language."""
    counts = materialize(word_counts(texts.where("lang IS NOT NULL")), "words")
    langs = sorted(r[0] for r in counts.select("lang").distinct().limit(MAX_LANGS + 1).collect())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} languages")
    pieces = pieces_of(path)
    table = np.full((pieces.size, len(langs)), 1.0 / pieces.size)
    spark = texts.sparkSession
    for _ in range(rounds if langs else 0):
        shared = spark.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p, total = pieces_of(path), np.zeros(shared.value.shape)
            place = {x: i for i, x in enumerate(langs)}
            for b in batches:
                for at in range(0, b.num_rows, 100_000):
                    part = b.slice(at, 100_000)
                    words, own, n = np.array(part.column(1).to_pylist(), object), np.array([place[x] for x in part.column(0).to_pylist()]), part.column(2).to_numpy()
                    for k in np.unique(own):  # a word is counted in its own language only
                        total[:, [k]] += expected_counts(p, shared.value[:, [k]], words[own == k].tolist(), n[own == k][:, None])
            i, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(total[i, k])], ["i", "k", "x"])

        sums = counts.mapInArrow(run, "i int, k int, x double").groupBy("i", "k").agg(F.sum("x").alias("x")).toArrow()
        table = np.zeros_like(table)  # at most vocabulary x languages numbers come to the driver
        table[sums["i"].to_numpy(), sums["k"].to_numpy()] = sums["x"].to_numpy()
        # a piece that a language never uses keeps a share of what all languages make of it
        pooled = (table.sum(axis=1) + 0.1) / (table.sum() + 0.1 * pieces.size)
        table = (table + 50.0 * pooled[:, None]) / (table.sum(axis=0) + 50.0)
        shared.unpersist()
    return langs, table


def identify(docs: DataFrame, langs: list[str], table: np.ndarray, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang, score) for every row: the likeliest language of the whole text and its posterior under equal priors.

    Null texts and texts without a letter are ``und`` with score 0, as is every text if no language was learned. Ties
    go to the first language in sorted order. Words of any length are summed over all their segmentations.
    """
    need(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(table.astype(np.float64))
    state: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}")
        p, t = pieces_of(path), shared.value
        known, rows = state.setdefault("known", {}), state.setdefault("rows", [np.zeros((0, len(langs)))])
        for batch in batches:
            for at in range(0, batch.num_rows, 1_024):
                b = batch.slice(at, 1_024)
                some = [bool(langs and x and letter.search(x)) for x in b.column(1).to_pylist()]
                vocabulary, ids, size = split(b.column(1), lower=True)
                words = vocabulary.to_pylist()
                if len(known) > HOLD:
                    known.clear()
                    rows[0] = rows[0][:0]
                new = [w for w in words if w not in known] if langs else []
                if new:
                    known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                    rows[0] = np.concatenate([rows[0], forward(p, t, new)])
                own = rows[0][[known[w] for w in words]][ids] if langs else np.zeros((len(ids), 0))
                doc = np.repeat(np.arange(len(size)), size)
                ll = np.stack([np.bincount(doc, own[:, k], len(size)) for k in range(len(langs))], axis=1) if langs else np.zeros((len(size), 1))
                best = ll.argmax(axis=1)
                near = 1.0 / np.exp(np.maximum(ll - ll[np.arange(len(ll)), best][:, None], -700)).sum(axis=1)
                pred = [langs[k] if x else "und" for k, x in zip(best, some, strict=True)]
                score = np.where(some, near, 0.0)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["id", "lang", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, lang string, score double")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """``learn`` and ``identify`` over all documents; nulls, ties and repeated rows as there, null ids are not held out and not learned from."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = crc_mod("doc_id", 5) == 0
    langs, table = learn(docs.where(~held).select("text", "lang"), path)
    got = identify(docs, langs, table, path)
    return got.select(F.col("id").alias("doc_id"), F.coalesce(crc_mod("id", 5) == 0, F.lit(False)).alias("held_out"), F.col("lang").alias("lang_pred"), "score")
