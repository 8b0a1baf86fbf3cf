"""Scans of the domain's tables and files."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_key

BRIEF = ("id", "title", "correspondent")
WITH_CONTENT = ("id", "title", "content")
FOR_CHAT = ("id", "title", "correspondent", "document_type", "storage_path", "created", "tags")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def brief(docs: DataFrame, columns: tuple[str, ...] = BRIEF) -> DataFrame:
    """Only the columns asked for, so a columnar scan reads no others."""
    return docs.select(*columns)


def by_id(docs: DataFrame, doc_id: int, columns: tuple[str, ...] = WITH_CONTENT) -> DataFrame:
    """One document or no row."""
    return docs.where(F.col("id") == doc_id).select(*columns)


def originals(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Original files as (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def notes_of(notes: DataFrame, docs: DataFrame) -> DataFrame:
    return notes.join(docs.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")


GOLDEN = "entries array<struct<file_path string, expected_correspondent string, expected_date string, expected_title_contains string, original_key string, split string, tags array<string>>>"


def golden(spark: SparkSession, path: str) -> DataFrame:
    """One row per golden entry; a missing split is ``test``."""
    rows = spark.read.schema(GOLDEN).json(path, multiLine=True).select(F.inline("entries"))
    return rows.withColumn("split", F.coalesce("split", F.lit("test"))).withColumn("key", split_key(F.col("original_key"), F.col("file_path")))


def of_split(entries: DataFrame, split: str) -> DataFrame:
    """Entries of a split; ``all`` is every one, ``code-test`` goes by the tag and not by the split."""
    if split == "all":
        return entries
    if split == "code-test":
        return entries.where(F.array_contains("tags", "code-test"))
    return entries.where(F.coalesce("split", F.lit("test")) == split)


def existing(entries: DataFrame, files: DataFrame, column: str = "file_path") -> DataFrame:
    """Entries whose file is in a listing with a column ``path``; schemes don't matter."""
    bare = F.regexp_replace(F.col("path"), r"^file:/*", "/")
    return entries.join(files.select(bare.alias(column)).distinct(), column, "left_semi")


def assign_splits(entries: DataFrame, validation: list[str]) -> tuple[DataFrame, DataFrame]:
    """Entries with their split by key, and validation keys that no entry has."""
    key = split_key(F.col("original_key"), F.col("file_path"))
    keys = entries.sparkSession.createDataFrame([(k,) for k in validation], "key string")
    out = entries.withColumn("key", key).withColumn("split", F.when(F.col("key").isin(*validation), "validation").otherwise("test") if validation else F.lit("test"))
    return out, keys.join(out.select("key"), "key", "left_anti")


def external_documents(rows: DataFrame, kept: int = 50, seen: int = 1000, pages: tuple[int, int] = (1, 5)) -> DataFrame:
    """The first ``kept`` documents of 1 to 5 pages among the first ``seen``, with their preferred file (pdf, tif, jpg, png)."""
    order = ["pdf", "tif", "jpg", "png"]

    def first_of(kind: str) -> Column:
        return F.get(F.filter("files", lambda f: F.lower(f).endswith(f".{kind}")), F.lit(0))

    best = F.coalesce(*map(first_of, order))
    return rows.orderBy("id").limit(seen).where(F.col("n_pages").between(*pages)).withColumn("file", best).where("file IS NOT NULL").limit(kept)


@dataclass
class Settings:
    """Settings of a run; unknown ones go to ``extra``. Blank addresses are none, and trailing slashes go."""

    ocr_model: str = "stand-in"
    metadata_model: str = "stand-in"
    metadata_api_base: str | None = None
    embed_api_base: str | None = None
    chunk_size: int = 512
    chunk_overlap: int = 50
    page_threshold: int = 40
    first_pages: int = 20
    last_pages: int = 20
    page_batch: int = 5
    attempts: int = 3
    base_delay: int = 60
    most_delay: int = 3600
    concurrency: int = 4
    poll_interval: int = 300
    chat_model: str = "stand-in"
    jury_models: tuple[str, ...] = ()
    dry_run: bool = False
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        for k in ("metadata_api_base", "embed_api_base"):
            v = (getattr(self, k) or "").strip().rstrip("/")
            setattr(self, k, v or None)

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        """Settings from upper-cased names; NAME_FILE points to a file that holds a secret's value."""
        env = dict(os.environ if env is None else env)
        for k in [k for k in env if k.endswith("_FILE") and k[:-5] not in env]:
            if os.path.exists(env[k]):
                with open(env[k], encoding="utf-8") as f:
                    env[k[:-5]] = f.read().strip()
        return cls().overlay({f.name: env[f.name.upper()] for f in fields(cls) if f.name.upper() in env})

    def overlay(self, values: dict) -> Settings:
        """A copy with other values, converted to the fields' types."""
        known = {f.name: getattr(self, f.name) for f in fields(self) if f.name != "extra"}
        new = {}
        for k, v in values.items():
            if k in known and isinstance(known[k], bool):
                new[k] = v if isinstance(v, bool) else str(v).lower() in ("1", "true", "yes")
            elif k in known and isinstance(known[k], int):
                new[k] = int(v)
            elif k in known:
                new[k] = tuple(v.split(",")) if isinstance(known[k], tuple) and isinstance(v, str) else v
        return replace(self, **new, extra=self.extra | {k: v for k, v in values.items() if k not in known})


def experiments(spark: SparkSession, path: str) -> DataFrame:
    """(name, settings map) of a YAML or JSON file of experiments; YAML needs its library."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        body = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs the yaml library") from e
        body = yaml.safe_load(text)
    rows = [(x["name"], {k: str(v) for k, v in x.get("config", {}).items()}) for x in body["experiments"]]
    return spark.createDataFrame(rows, "name string, settings map<string,string>")


def overlaid(base: Settings, experiment: dict) -> Settings:
    """Environment settings with an experiment's values over them."""
    return base.overlay(experiment)


def write_golden(entries: DataFrame, path: str) -> None:
    """Golden entries as one reviewed document; it is small by nature."""
    body = {"entries": [json.loads(r) for r in entries.toJSON().collect()]}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(body, f, indent=2, ensure_ascii=False)
