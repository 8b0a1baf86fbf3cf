"""BPE encoding and decoding of whole texts; long unsplit text is encoded in pieces that are joined exactly."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import need, tidy

#: White space for every step of the tokenizer: a text may be cut there without changing any token.
CUT = re.compile("[ \t\n\r]+")
#: A word whose marks the tokenizer's pattern splits off, whatever else it does.
ENDING = re.compile(r"([a-zß-öø-ÿ]{1,512})([.,;:!?]{1,8})")
#: Words over this many characters are taken apart into pretokens; pretokens over LEAF are encoded in pieces.
LONG = 4_096
LEAF = 1_024
#: Remembered words, and those of a task that is to leave nothing behind; the memory is dropped whole when full, so it stays bounded.
REMEMBER, FEW = 500_000, 100_000


class Codec:
    """Encoder and decoder over a tokenizers file.

    Short words go to the library once and are remembered. A pretoken longer than ``leaf`` symbols is
    encoded as a tree: halves down to leaves, which are encoded as a batch, then pairs are joined by re-encoding
    growing windows around the joint until both sides agree. Inner pieces use the same merges without the
    end-of-word mark, which only the last piece may carry.
    """

    def __init__(self, path: str, leaf: int = LEAF, long: int = LONG, texts: bool = True) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        for k in ("truncation", "padding"):
            spec[k] = None
        self.full = Tokenizer.from_str(json.dumps(spec))
        self.leaf, self.long = leaf, long
        self.mark = spec["model"].get("end_of_word_suffix") or ""
        bare = {**spec, "added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None}
        self.last = Tokenizer.from_str(json.dumps(bare))
        self._inner = lambda: Tokenizer.from_str(json.dumps({**bare, "model": {**spec["model"], "end_of_word_suffix": None}}))
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.lowers = "Lowercase" in json.dumps(spec["normalizer"])
        self.texts = texts
        self.words_end = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in self._pattern(spec)
        self.known: dict[str, tuple] = {}
        self.piece = self.full.id_to_token

    @cached_property
    def inner(self):
        """The model without end-of-word marks, made when the first long pretoken comes."""
        return self._inner()

    @staticmethod
    def _pattern(spec: dict) -> str:
        """The pattern that the file splits pretokens by, if it does nothing else first."""
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        pattern = steps[0].get("pattern") or {}
        return pattern.get("Regex", "") if isinstance(pattern, dict) else ""

    # --- long unsplit text -------------------------------------------------------------------------------------

    def _ids(self, texts: list[str], last: bool) -> list[list[int]]:
        model = self.last if last else self.inner
        return [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]

    def _symbols(self, ids: list[int]) -> list[str]:
        return [self.piece(i) for i in ids]

    def tree(self, text: str) -> list[int]:
        """Ids of one pretoken, as the library gives them for the whole."""
        cuts = [text]
        while max(map(len, cuts)) > self.leaf:
            cuts = [h for c in cuts for h in ((c[: len(c) // 2], c[len(c) // 2 :]) if len(c) > 1 else (c,))]
        parts = [*self._ids(cuts[:-1], False), *self._ids(cuts[-1:], True)]
        while len(parts) > 1:
            ends = range(0, len(parts) - 1, 2)
            joined = [self._join(parts[i], parts[i + 1], i + 2 == len(parts)) for i in ends]
            parts = joined + parts[2 * len(joined) :]
        return parts[0]

    def _join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """Re-encode a window around the joint, doubled until its first token is left's and its last token is right's."""
        k = 4
        while True:
            a, b = min(k, len(left)), min(k, len(right))
            whole_right = b == len(right)
            window = left[len(left) - a :] + right[:b]
            text = "".join(self._symbols(window))
            ends = last and whole_right
            if ends and self.mark and text.endswith(self.mark):
                text = text[: -len(self.mark)]
            new = self._ids([text], ends)[0]
            agree_left = a == len(left) or new[:2] == window[:2]
            agree_right = whole_right or new[-2:] == window[-2:]
            if agree_left and agree_right:
                return left[: len(left) - a] + new + right[b:]
            k *= 2

    def _long(self, word: str) -> list[int]:
        out: list[int] = []
        for part in self.special.split(word) if self.special else [word]:
            if self.special and self.special.fullmatch(part):
                out.append(self.full.token_to_id(part))
                continue
            if self.full.normalizer:
                part = self.full.normalizer.normalize_str(part)
            for pretoken, _ in self.full.pre_tokenizer.pre_tokenize_str(part) if part else []:
                out += self.tree(pretoken) if len(pretoken) > self.leaf else self._ids([pretoken], True)[0]
        return out

    # --- texts ---------------------------------------------------------------------------------------------------

    def _learn(self, words: set[str]) -> None:
        # letters and the marks after them are different pretokens: learned apart, a word needs the library once
        apart = {w: m.groups() for w in words if (m := ENDING.fullmatch(w))} if self.words_end else {}
        parts = {p for pair in apart.values() for p in pair if p not in self.known}
        short = [w for w in {*words, *parts} if len(w) <= self.long and w not in apart]
        # a run of plain letters is one pretoken as it stands, so the model alone can encode it
        plain = lambda w: self.words_end and w.isascii() and w.isalpha() and w.islower()
        for model, group in ((self.last, [w for w in short if plain(w)]), (self.full, [w for w in short if not plain(w)])):
            for i in range(0, len(group), 4_096):  # the library's results are large
                part = group[i : i + 4_096]
                for w, e in zip(part, model.encode_batch_fast(part, add_special_tokens=False), strict=True):
                    self._put(w, e.ids)
        for w in words:
            if len(w) > self.long and w not in apart:
                self._put(w, self._long(w))
        for w, pair in apart.items():
            a, b = (self.known[p] for p in pair)
            self.known[w] = (a[0] + b[0], f"{a[1]} {b[1]}", f"{a[2]} {b[2]}") if self.texts else (a[0] + b[0], a[1] + b[1])

    def _plain(self, text: str) -> str:
        """Lower case ahead of the tokenizer where that is the same, so fewer words differ: Latin-1 without special tokens."""
        if not self.lowers or "<|" in text:
            return text
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        return text.lower()

    def _put(self, word: str, ids: list[int]) -> None:
        self.known[word] = (len(ids), " ".join(map(str, ids)), " ".join(map(self.piece, ids))) if self.texts else (len(ids), np.array(ids, np.int32).tobytes())

    def encode(self, texts: list[str | None], most: int | None = None) -> Iterator[list[tuple]]:
        """The words of each text, each with its number of tokens and, with ``texts``, ids in decimal and the decoded text, else ids as 32-bit numbers."""
        split = [[w for w in CUT.split(self._plain(t)) if w] if t else [] for t in texts]
        most = most or REMEMBER
        if len(self.known) > most:
            self.known.clear()
        at = 0
        while at < len(split):
            # learn the new words of as many texts as fit the memory
            upto, new = at, set()
            while upto < len(split) and len(new) < most:
                new.update(w for w in split[upto] if w not in self.known)
                upto += 1
            self._learn(new)
            get = self.known.__getitem__
            for words in split[at:upto]:
                yield [x for x in map(get, words) if x[0]]
            at = upto
            if at < len(split) and len(self.known) > most:
                self.known.clear()


_CODECS: dict[tuple, Codec] = {}


def codec(path: str, leaf: int = LEAF, long: int = LONG, texts: bool = True) -> Codec:
    """One codec per worker process and file."""
    key = (path, leaf, long, texts)
    if key not in _CODECS:
        _CODECS[key] = Codec(*key)
    return _CODECS[key]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, keep: bool = True) -> DataFrame:
    """Encode every whole text: (id, n_tokens, ids), or with ``digests`` SHA-256 digests of the ids' text and of the decoded text.

    ``path`` is a tokenizers file that each worker can open. Null is the empty text: no tokens, empty texts.
    Decoding gives what the file's decoder gives; without one, tokens joined by a space. Ids may be null or repeat.
    With ``keep`` a worker remembers words from task to task, some 400 bytes each; without, each task learns its own, FEW at a time, which
    leaves that memory to the stages around it. Results are the same.
    """
    need(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["id", "n_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, texts=digests)
        sha = lambda words, i: hashlib.sha256(" ".join([w[i] for w in words]).encode()).hexdigest()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # bounds what is held decoded
                b = batch.slice(at, 512)
                n, out = [], [[], []]
                for words in c.encode(b.column(1).to_pylist(), None if keep else FEW):
                    n.append(sum([w[0] for w in words]))
                    if digests:
                        out[0].append(sha(words, 1))
                        out[1].append(sha(words, 2))
                    else:
                        out[0].append(b"".join([w[1] for w in words]))
                if digests:
                    made = [pa.array(x, pa.string()) for x in out]
                else:
                    made = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(np.frombuffer(b"".join(out[0]), np.int32)))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *made], names)
        if not keep:
            c.known.clear()

    out = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), f"id {kind}, n_tokens long, {out}")


def decode(df: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded) from arrays of ids; null and empty arrays give the empty text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = [" ".join(map(c.piece, x)) if x else "" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "decoded"])

    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, decoded string")


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), digests=True)
    return rows.withColumnRenamed("id", "doc_id")
