"""Fill-in-middle: texts cut after units by injected markers, their parts put in another order, and put back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import all_of, need

#: A unit: a run of letters, or any other code point.
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: The marker that is put after every unit, the escape character, and what follows it for either of them in a text. None is a letter.
MARK, ESCAPE, FOR_MARK, FOR_ESCAPE = "\x01", "\x02", "1", "2"


@dataclass(frozen=True)
class Sentinels:
    """Strings before the parts. None may overlap another or itself, so that a text without them can be cut at them again."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        for i, a in enumerate(self):
            for j, b in enumerate(self):
                meets = any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (i != j)))
                if not a or meets or (i != j and a in b):
                    raise ValueError(f"sentinels {a!r} and {b!r} overlap")

    def __iter__(self):
        return iter((self.prefix, self.suffix, self.middle))


def escaped(text: Column) -> Column:
    """The text without the marker, reversibly: the escape character is escaped first."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + FOR_ESCAPE)), F.lit(MARK), F.lit(ESCAPE + FOR_MARK))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE + FOR_MARK), F.lit(MARK)), F.lit(ESCAPE + FOR_ESCAPE), F.lit(ESCAPE))


def marked(text: Column) -> Column:
    """The escaped text with a marker after each unit; an escaped pair stands for one code point, so it is one unit."""
    return F.regexp_replace(escaped(text), f"{ESCAPE}[{FOR_MARK}{FOR_ESCAPE}]|{UNIT}", f"$0{MARK}")


def units(rows: Column) -> Column:
    """Units of a marked text: its markers."""
    return (F.length(rows) - F.length(F.replace(rows, F.lit(MARK), F.lit("")))).cast("long")


def _ranked(rows: str, count: Column) -> Column:
    """SUBSTRING_INDEX with a computed count: up to the count-th marker, or after it from the end if negative."""
    return F.call_function("substring_index", F.col(rows), F.lit(MARK), count.cast("int"))


def _plain(rows: Column) -> Column:
    return unescaped(F.replace(rows, F.lit(MARK), F.lit("")))


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers under 2**32 from a key: groups of the SHA-256 digest of ``seed:key``; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rate: int = 90, spm: int = 20, sentinels: Sentinels = Sentinels()) -> DataFrame:
    """(id, text, n, form, prefix, middle, suffix, output) of every row, in one pass without a shuffle.

    ``rate`` of a hundred texts are cut, ``spm`` of a hundred of these with the suffix first; cuts fall after any number of
    units, drawn from the id, so repeated ids are cut alike at equal lengths and a null id draws as an empty one does. Texts that
    are empty or null (read as empty) or hold a sentinel stay plain, with null parts. Other columns are not read.
    """
    need(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    h = draws(F.col("id"), seed)
    rows = rows.select("*", marked(F.col("text")).alias("marked"), *[x.alias(f"h{i}") for i, x in enumerate(h, 1)]).withColumn("n", units(F.col("marked")))
    free = all_of([~F.contains("text", F.lit(s)) for s in sentinels])
    cut = (F.col("text") != "") & free & (F.col("h3") % 100 < rate)
    rows = rows.withColumn("form", F.when(~cut, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm"))
    ends = [F.col(f"h{i}") % (F.col("n") + 1) for i in (1, 2)]
    rows = rows.select("id", "text", "n", "form", "marked", F.least(*ends).alias("a"), F.greatest(*ends).alias("b"))
    # of n units, each before its marker: those up to a, the last b - a of those up to b, and what follows the (n - b + 1)-th marker from the end
    rows = rows.withColumn("head", _ranked("marked", F.col("b")))
    parts = {"prefix": _ranked("marked", F.col("a")), "middle": _ranked("head", F.col("a") - F.col("b")), "suffix": _ranked("marked", F.col("b") - F.col("n") - 1)}
    rows = rows.select("id", "text", "n", "form", *[F.when(F.col("form") != "plain", _plain(p)).alias(c) for c, p in parts.items()])
    p, s, m = (F.lit(x) for x in sentinels)
    made = F.when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).when(F.col("form") == "spm", F.concat(s, "suffix", p, "prefix", m, "middle"))
    return rows.withColumn("output", F.coalesce(made, F.col("text")))


def restore(rows: DataFrame, output: str = "output", form: str = "form", name: str = "restored", sentinels: Sentinels = Sentinels()) -> DataFrame:
    """``rows`` with the exact text that ``output`` was made from; null for a null output or an unknown form."""
    p, s, m = sentinels
    out = F.col(output)
    after = lambda x: F.substring_index(out, x, -1)
    between = lambda a, b: F.substring_index(F.substring_index(out, b, 1), a, -1)
    parts = {"psm": F.concat(between(p, s), after(m), between(s, m)), "spm": F.concat(between(p, m), after(m), between(s, p))}
    back = F.when(F.col(form) == "plain", out)
    for k, v in parts.items():
        back = back.when(F.col(form) == k, v)
    return rows.withColumn(name, back)


def op12_fim(spark, sf_dir: str) -> DataFrame:
    """``transform`` and ``restore`` of all documents; nulls, empty texts and repeated rows as there, an empty table gives no rows."""
    rows = restore(transform(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    sizes = [F.length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    return rows.select(F.col("id").alias("doc_id"), "n", "form", *sizes, F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT doc_id, text, regexp_extract_all(text, '{UNIT}') AS u, list_transform(range(0, 4), lambda i: CAST('0x' || substr(h, CAST(i * 8 + 1 AS INTEGER), 8) AS BIGINT)) AS h FROM d
), c AS (
  SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (
  SELECT doc_id, text, n, form, array_to_string(list_slice(u, 1, a), '') AS p, array_to_string(list_slice(u, a + 1, b), '') AS m, array_to_string(list_slice(u, b + 1, n), '') AS s FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM p"""
