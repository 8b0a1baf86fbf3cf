"""Queries over text, names and lookups, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tables
from ..functions import text as T
from ..operators import chunks as C
from ..operators import lookups as L
from ..operators import retrieval as R
from ..operators import substrings as S
from ..operators.chunk_store import ChunkStore
from ..operators.telemetry import Distinct, observed, sketch
from ..sources.tables import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@query("q_doc_scan_brief", "SELECT doc_id, lang, source FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def doc_scan_brief(spark, d) -> DataFrame:
    return table(spark, d, "documents").where(T.strip("text") != "").select("doc_id", "lang", "source")


@query("q_point_lookup", "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 7")
def point_lookup(spark, d) -> DataFrame:
    return table(spark, d, "documents").where("doc_id = 7").select("doc_id", "lang", "source", "n_chars")


@query(
    "q_filter_metadata",
    """SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id)
       WHERE d.source = 'src3' AND d.lang = 'en' AND (l.quality = 1 OR l.toxic = 1)""",
)
def filter_metadata(spark, d) -> DataFrame:
    labels = table(spark, d, "labels")
    tags = F.array_compact(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"), F.lit("labelled")))
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("correspondent"), F.col("lang").alias("document_type")).join(labels, "doc_id").withColumn("tags", tags)
    return R.filtered(rows, R.Filters(correspondent="src3", document_type="en", tags=("good", "toxic"))).select("doc_id")


@query(
    "q_dim_lookup",
    """SELECT c_custkey, n_name AS nation, r_name AS region FROM customer
       LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def dim_lookup(spark, d) -> DataFrame:
    rows = L.with_name(table(spark, d, "customer"), table(spark, d, "nation"), "c_nationkey", "n_nationkey", "n_name", "nation")
    rows = L.with_name(rows, table(spark, d, "nation"), "c_nationkey", "n_nationkey", "n_regionkey", "rk")
    return L.with_name(rows, table(spark, d, "region"), "rk", "r_regionkey", "r_name", "region").select("c_custkey", "nation", "region")


@query(
    "q_search_metadata",
    """SELECT o_orderkey, c_name AS correspondent, strftime(o_orderdate, '%Y') AS year
       FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
)
def search_metadata(spark, d) -> DataFrame:
    docs = table(spark, d, "orders").withColumn("date", F.date_format("o_orderdate", "yyyy-MM-dd"))
    got = L.search_metadata(docs, {"correspondent": (table(spark, d, "customer"), "o_custkey", "c_custkey", "c_name")})
    return got.select("o_orderkey", "correspondent", "year")


@query(
    "q_tag_names",
    """WITH t AS (SELECT doc_id, [CASE WHEN quality = 1 THEN 3 ELSE 99 END, CASE WHEN toxic = 1 THEN 5 ELSE 7 END, 1] AS tags FROM labels),
       e AS (SELECT doc_id, unnest(tags) AS t, unnest(range(len(tags))) AS p FROM t)
       SELECT t.doc_id, coalesce(list(n_name ORDER BY p) FILTER (WHERE n_name IS NOT NULL), []) AS names
       FROM t LEFT JOIN e USING (doc_id) LEFT JOIN nation ON e.t = n_nationkey GROUP BY t.doc_id""",
)
def tag_names(spark, d) -> DataFrame:
    tags = F.array(F.when(F.col("quality") == 1, 3).otherwise(99), F.when(F.col("toxic") == 1, 5).otherwise(7), F.lit(1))
    return L.tag_names(table(spark, d, "labels").withColumn("tags", tags), "doc_id", "tags", table(spark, d, "nation"), "n_nationkey", "n_name")


@query(
    "q_name_resolve",
    "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name IN (SELECT min(n_name) FROM nation))",
)
def name_resolve(spark, d) -> DataFrame:
    nation, customers = table(spark, d, "nation"), table(spark, d, "customer")
    ids = _nation_ids(nation, [nation.agg(F.min("n_name")).first()[0]])
    mine = customers.limit(0) if ids is None else customers.where(F.col("c_nationkey").isin(*ids))
    return table(spark, d, "orders").join(mine, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


def _nation_ids(nation: DataFrame, names: list[str]) -> list[int] | None:
    return R.resolve_names(nation, "n_nationkey", "n_name", names)


@query("q_name_resolve_missing", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE (SELECT count(*) FROM nation WHERE n_name IN ('GERMANY', 'NOWHERE')) = 2)")
def name_resolve_missing(spark, d) -> DataFrame:
    ids = _nation_ids(table(spark, d, "nation"), ["GERMANY", "NOWHERE"])
    orders = table(spark, d, "orders").select("o_orderkey")
    return orders.limit(0) if ids is None else orders


@query("q_year_extract", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN 'abc' END IS NULL AND o_orderkey % 5 <> 0 AS dated, CASE WHEN o_orderkey % 5 IN (0, 1) THEN NULL ELSE strftime(o_orderdate, '%Y') END AS year FROM orders")
def year_extract(spark, d) -> DataFrame:
    k = F.col("o_orderkey") % 5
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = F.when(k == 0, None).when(k == 1, "abc").when(k == 2, iso).when(k == 3, F.concat(iso, F.lit("T10:00:00"))).otherwise(F.concat(F.substring(iso, 1, 4), F.lit(" or so")))
    return table(spark, d, "orders").select("o_orderkey", (k > 1).alias("dated"), T.year_of(raw).alias("year"))


@query(
    "q_bounded_context",
    """WITH d AS (SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n FROM documents),
       g AS (SELECT doc_id, text, n, least(2500, n) AS lo, greatest(least(2500, n), n - 2000) AS hi FROM d),
       w AS (SELECT *, list_transform([1, 2, 3], lambda i: lo + CAST(round_even(i * (hi - lo) / 4.0, 0) AS BIGINT)) AS c FROM g),
       s AS (SELECT *, list_transform(c, lambda x: least(hi, greatest(lo, x - 250) + 500)) AS e FROM w),
       r AS (SELECT doc_id, text, n, unnest(list_concat([{'a': CAST(0 AS BIGINT), 'b': CAST(lo AS BIGINT)}], list_transform(e, lambda x: {'a': CAST(greatest(lo, x - 500) AS BIGINT), 'b': CAST(x AS BIGINT)}), [{'a': CAST(greatest(0, n - 2000) AS BIGINT), 'b': n}]), recursive := true) FROM s WHERE n > 6000),
       o AS (SELECT *, coalesce(max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM r),
       t AS (SELECT doc_id, string_agg(CASE WHEN a > seen THEN chr(10) || '...' || chr(10) ELSE '' END || CASE WHEN b > greatest(a, seen) THEN substr(text, greatest(a, seen) + 1, b - greatest(a, seen)) ELSE '' END, '' ORDER BY a, b) AS context FROM o GROUP BY doc_id)
       SELECT d.doc_id, coalesce(t.context, d.text) AS context FROM d LEFT JOIN t USING (doc_id)""",
)
def bounded(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.bounded_context("text").alias("context"))


_SQUEEZE = r"trim(regexp_replace({}, '[\s]+', ' ', 'g'))"


@query(
    "q_snippet",
    f"WITH c AS (SELECT doc_id, {_SQUEEZE.format('text')} AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 280 THEN t ELSE rtrim(substr(t, 1, 277)) || '...' END AS snippet FROM c",
)
def snippet(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.snippet("text").alias("snippet"))


@query(
    "q_format_hit",
    f"""WITH c AS (SELECT *, {_SQUEEZE.format('text')} AS t FROM documents LEFT JOIN labels USING (doc_id))
        SELECT doc_id, '[Doc ' || doc_id || ' | ' || source || CASE WHEN lang <> '' THEN ' | Type: ' || lang ELSE '' END
          || CASE WHEN toxic = 1 THEN ' | Tags: toxic, labelled' WHEN toxic = 0 THEN ' | Tags: labelled' ELSE '' END || ']: '
          || CASE WHEN length(t) <= 280 THEN t ELSE rtrim(substr(t, 1, 277)) || '...' END AS hit FROM c""",
)
def format_hit(spark, d) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    none = F.lit(None).cast("string")
    tags = F.when(F.col("toxic").isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(F.when(F.col("toxic") == 1, "toxic"), F.lit("labelled"))))
    return rows.select("doc_id", T.hit_line(F.col("doc_id"), none, F.col("source"), none, F.col("lang"), F.lit(""), tags, F.col("text")).alias("hit"))


@query(
    "q_chunk_header",
    """SELECT doc_id, 'Title: ' || coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END, ''), 'Unknown') || chr(10) || 'Sender: ' || source || chr(10)
       || 'Date: Unknown' || chr(10) || CASE WHEN lang = 'en' THEN 'Summary: english' || chr(10) ELSE '' END || '---' || chr(10) AS header FROM documents""",
)
def header(spark, d) -> DataFrame:
    title = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source"))
    summary = F.when(F.col("lang") == "en", "english")
    return table(spark, d, "documents").select("doc_id", T.chunk_header(title, F.col("source"), F.lit(None).cast("string"), summary).alias("header"))


@query(
    "q_chunk_table",
    r"SELECT doc_id, true AS counted, true AS short, true AS covered, true AS begins, true AS ends FROM documents WHERE regexp_matches(text, '\S')",
)
def chunk_table(spark, d) -> DataFrame:
    """What must hold of the chunks of every text, by the table function: positions without a gap, the size kept, no character lost, first and last at the text's ends."""
    tables.register(spark)
    solid = lambda c: F.length(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", ""))
    docs = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "").alias("whole"))
    rows = spark.sql("SELECT d.*, c.* FROM {docs} d, LATERAL chunks_of(d.whole) c", docs=docs.withColumn("solid", solid("whole")))
    # the text itself stays behind, so what is shuffled doesn't grow with chunks times text
    rows = rows.select("doc_id", "chunk_index", "solid", F.length("text").alias("size"), solid("text").alias("own"), F.startswith("whole", "text").alias("begins"), F.endswith("whole", "text").alias("ends"))
    return rows.groupBy("doc_id").agg(
        ((F.min("chunk_index") == 0) & (F.max("chunk_index") + 1 == F.count("*"))).alias("counted"),
        (F.max("size") <= C.SIZE).alias("short"),
        (F.sum("own") >= F.max("solid")).alias("covered"),
        F.min_by("begins", "chunk_index").alias("begins"),
        F.max_by("ends", "chunk_index").alias("ends"),
    )


@query("q_chunk_count_rows")
def chunk_rows(spark, d) -> DataFrame:
    return C.chunk(table(spark, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.length("text")).alias("longest"))


@query("q_point_ids", "SELECT vec_id, CAST(label AS BIGINT) * 10000 + row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS point_id FROM embeddings")
def point_ids(spark, d) -> DataFrame:
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return table(spark, d, "embeddings").select("vec_id", T.point_id(F.col("label"), n).alias("point_id"))


def _norm_sql(c: str, suffixes: list[str]) -> str:
    s = f"replace(replace(replace(replace(replace(replace(trim(lower({c})), '&', ' and '), '.', ''), '/', ' '), '-', ' '), '''', ''), chr(9), ' ')"
    s = rf"regexp_replace({s}, '\b({'|'.join(suffixes)})\b', '', 'g')"
    s = rf"regexp_replace({s}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')"
    return rf"trim(regexp_replace({s}, '\s+', ' ', 'g'))"


@query(
    "q_norm_names",
    f"""WITH n AS (SELECT c_name || ' Inc. & Co' AS name FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT DISTINCT p_name FROM part), m AS (SELECT name, {_norm_sql('name', T.SENDER_SUFFIXES)} AS norm FROM n)
        SELECT name, norm, array_to_string(list_sort(string_split(norm, ' ')), ' ') AS sorted FROM m""",
)
def norm_names(spark, d) -> DataFrame:
    a = table(spark, d, "customer").select(F.concat("c_name", F.lit(" Inc. & Co")).alias("name"))
    rows = a.union(table(spark, d, "supplier").select("s_name")).union(table(spark, d, "part").select("p_name").distinct())
    return rows.withColumn("norm", T.sender_name("name")).withColumn("sorted", T.token_sort("norm"))


@query("q_available_names", "SELECT (SELECT list(n_name ORDER BY n_name) FROM nation) AS nations, (SELECT list(r_name ORDER BY r_name) FROM region) AS regions")
def available(spark, d) -> DataFrame:
    return L.available_names({"nations": table(spark, d, "nation").withColumnRenamed("n_name", "name"), "regions": table(spark, d, "region").withColumnRenamed("r_name", "name")}, spark)


@query(
    "q_page_selection",
    """WITH p AS (SELECT doc_id, CAST(n_chars // 100 AS INTEGER) AS total FROM documents)
       SELECT doc_id, CAST(CASE WHEN total > 40 THEN len(list_distinct(list_concat(range(0, 20), range(total - 20, total)))) ELSE total END AS BIGINT) AS pages,
              CASE WHEN total > 0 THEN CAST(total - 1 AS INTEGER) END AS last_page FROM p""",
)
def pages(spark, d) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", T.page_selection(F.floor(F.col("n_chars") / 100)).alias("p"))
    return rows.select("doc_id", F.size("p").cast("long").alias("pages"), F.array_max("p").alias("last_page"))


@query(
    "q_webhook_ids",
    """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN page_id WHEN page_id % 4 = 1 THEN page_id + 1 WHEN page_id % 4 = 2 THEN page_id + 2 END AS doc_id FROM pages""",
)
def webhook_ids(spark, d) -> DataFrame:
    i, none = F.col("page_id"), F.lit(None).cast("string")
    k = i % 4
    url = F.when(k == 0, F.concat(F.col("url"), F.lit("/documents/"), i.cast("string"), F.lit("/edit"))).when(k == 3, F.lit("http://x/documents/none"))
    got = T.webhook_doc_id(none, url, F.when(k == 1, (i + 1).cast("string")), F.when(k == 2, (i + 2).cast("string")))
    return table(spark, d, "pages").select("page_id", got.alias("doc_id"))


@query(
    "q_notes_detector",
    "SELECT event_id FROM events WHERE CASE WHEN event_id % 3 = 0 THEN true ELSE false END",
)
def notes(spark, d) -> DataFrame:
    k = F.col("event_id") % 3
    note = F.when(k == 0, F.concat(F.lit('{"ocr_model": "m", "n": '), F.col("event_id").cast("string"), F.lit("}"))).when(k == 1, F.concat(F.col("props"), F.lit(" ocr_model"))).otherwise(F.col("props"))
    return table(spark, d, "events").where(T.is_ai_note(note)).select("event_id")


@query(
    "q_tag_transition",
    "SELECT doc_id, CASE WHEN quality = 1 THEN [9, 3, 2] ELSE [2, 9] END AS tags FROM labels",
)
def transition(spark, d) -> DataFrame:
    tags = F.when(F.col("quality") == 1, F.array(F.lit(1), F.lit(9), F.lit(3))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(9)))
    return table(spark, d, "labels").select("doc_id", T.move_tag(tags, F.lit(1), F.lit(2)).alias("tags"))


@query(
    "q_custom_fields_merge",
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '5=' || source || ',' ELSE '' END || '1=2024-01-01,2=' || lang AS fields, 'x' AS old FROM documents""",
)
def custom_fields(spark, d) -> DataFrame:
    f = lambda i, v: F.struct(F.lit(i).cast("long").alias("field"), v.alias("value"))
    have = F.when(F.col("doc_id") % 2 == 0, F.array(f(1, F.lit("x")), f(5, F.col("source")))).otherwise(F.array(f(1, F.lit("x"))))
    got = T.merge_fields(have, {1: F.lit("2024-01-01"), 2: F.col("lang")})
    text = F.array_join(F.transform(got, lambda x: F.concat(x["field"].cast("string"), F.lit("="), x["value"])), ",")
    return table(spark, d, "documents").select("doc_id", text.alias("fields"), T.field_value(have, 1).alias("old"))


@query(
    "q_full_text",
    r"""WITH c AS (SELECT doc_id, source, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)
        SELECT doc_id, CASE WHEN t = '' THEN 'Document ' || doc_id || ' has no OCR content.' ELSE '[Doc ' || doc_id || ' | ' || source || ']' || chr(10)
          || CASE WHEN length(t) > 8000 THEN regexp_replace(substr(t, 1, 8000), '\s+$', '') || chr(10) || chr(10) || '[truncated]' ELSE t END END AS shown FROM c""",
)
def full_text(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.full_text(F.col("doc_id"), F.col("source"), F.col("text")).alias("shown"))


@query(
    "q_judge_excerpt",
    r"SELECT doc_id, substr(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 2000) AS excerpt FROM documents",
)
def excerpt(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.judge_excerpt("text").alias("excerpt"))


@query(
    "q_without_thinking",
    r"SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS answer FROM documents",
)
def thinking(spark, d) -> DataFrame:
    said = F.concat(F.lit("<Think>no\n"), F.col("source"), F.lit("</think> "), F.col("text"), F.lit("<thinking>x</thinking>"))
    return table(spark, d, "documents").select("doc_id", T.without_thinking(said).alias("answer"))


@query(
    "q_payload_refresh",
    "SELECT vec_id AS chunk_index, CAST(label AS BIGINT) AS doc_id, CASE WHEN label % 2 = 0 THEN 'new ' || label ELSE 'old' END AS title FROM embeddings",
)
def payload_refresh(spark, d) -> DataFrame:
    index = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_index"), F.col("label").cast("long").alias("doc_id"), F.lit("old").alias("title"))
    meta = index.select("doc_id").distinct().where("doc_id % 2 = 0").withColumn("title", F.concat(F.lit("new "), F.col("doc_id").cast("string")))
    return C.refresh_payload(index, meta, ("title",))


@query(
    "q_index_upsert",
    """SELECT vec_id AS point_id, 'old' AS text FROM embeddings WHERE vec_id % 3 <> 0
       UNION ALL SELECT vec_id, 'new' FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT -1 - vec_id, 'new' FROM embeddings WHERE vec_id % 3 = 0""",
)
def index_upsert(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    index = e.select(F.col("vec_id").alias("point_id"), F.lit("old").alias("text"))
    some = e.where("vec_id % 3 = 0").select(F.explode(F.array("vec_id", -1 - F.col("vec_id"))).alias("point_id"), F.lit("new").alias("text"))
    return C.upsert(index, some)


@query(
    "q_delete_document",
    "SELECT vec_id, CAST(label AS BIGINT) AS doc_id FROM embeddings WHERE label NOT IN (1, 4)",
)
def delete_document(spark, d) -> DataFrame:
    index = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("doc_id"))
    return L.without(index, spark.createDataFrame([(1,), (4,)], "doc_id long"), "doc_id")


@query(
    "q_patch_documents",
    "SELECT doc_id, CASE WHEN toxic = 1 THEN 'flagged' ELSE source END AS source, lang FROM documents LEFT JOIN labels USING (doc_id)",
)
def patch_documents(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    changes = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "flagged").alias("source"))
    return L.patch(docs, changes, "doc_id")


@query(
    "q_find_or_create",
    """WITH n AS (SELECT DISTINCT n_name FROM nation), a AS (SELECT upper(substr(n_name, 1, length(n_name))) AS name FROM n UNION SELECT 'Zz ' || n_name FROM n),
       f AS (SELECT name, (SELECT min(n_nationkey) FROM nation WHERE lower(n_name) = lower(name)) AS id FROM a)
       SELECT name, CAST(coalesce(id, (SELECT max(n_nationkey) FROM nation) + sum(CASE WHEN id IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY name)) AS BIGINT) AS id, id IS NULL AS created FROM f""",
)
def find_or_create(spark, d) -> DataFrame:
    dim = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    asked = dim.select(F.upper("name").alias("name")).union(dim.select(F.concat(F.lit("Zz "), F.col("name"))))
    return L.find_or_create(asked, dim)


@query(
    "q_names_containing",
    """WITH a AS (SELECT DISTINCT lower(t) AS asked FROM (SELECT unnest(string_split(p_name, ' ')) AS t FROM part UNION ALL SELECT substr(p_name, 2, 2) FROM part) WHERE t <> '')
       SELECT asked, count(*) AS parts, min(p_partkey) AS first FROM a JOIN part ON contains(lower(p_name), asked) GROUP BY asked""",
)
def names_containing(spark, d) -> DataFrame:
    """Parts by the words and by two characters of their names, anywhere in a name."""
    parts = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("within"))
    words = table(spark, d, "part").select(F.explode(F.concat(F.split("p_name", " "), F.array(F.substring("p_name", 2, 2)))).alias("t")).where("t <> ''")
    return S.containing(words.select(F.lower("t").alias("asked")).distinct(), parts, "asked", "within").groupBy("asked").agg(F.count("*").alias("parts"), F.min("p_partkey").alias("first"))


@query(
    "q_stage_distinct",
    """WITH r AS (SELECT 'keyword' AS stage, doc_id FROM documents UNION ALL SELECT 'dense', vec_id FROM embeddings), f AS (SELECT * FROM r UNION ALL SELECT 'fused', doc_id FROM r)
       SELECT stage, CAST(CASE WHEN stage = 'fused' THEN 2 ELSE 1 END AS BIGINT) AS queries, count(DISTINCT doc_id) AS exact, true AS close FROM f GROUP BY stage""",
)
def stage_distinct(spark, d) -> DataFrame:
    """Distinct documents that the sides of a search read and both together, and whether sketches taken while reading come within 3 %."""
    sides = {"keyword": table(spark, d, "documents").select("doc_id"), "dense": table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))}
    kept, exact = Distinct(spark), []
    for stage, rows in sides.items():
        found, seen = observed(rows, f"{stage}-{uuid.uuid4().hex}", docs=sketch("doc_id"))
        found.write.format("noop").mode("overwrite").save()
        for s in (stage, "fused"):
            kept.add(s, seen.get["docs"])
            exact.append(rows.select(F.lit(s).alias("stage"), "doc_id"))
    first, *rest = exact
    for more in rest:
        first = first.union(more)
    counts = first.groupBy("stage").agg(F.countDistinct("doc_id").alias("exact"))
    return kept.counts().join(counts, "stage").select("stage", "queries", "exact", (F.abs(F.col("documents") - F.col("exact")) <= 0.03 * F.col("exact")).alias("close"))


def _lines(spark, d) -> DataFrame:
    """Documents' lines as chunks."""
    docs = table(spark, d, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"), "lang", F.col("source").alias("title"))


_LINES = "l AS (SELECT doc_id, unnest(range(len(s))) AS chunk_index, unnest(s) AS text, lang, source AS title FROM (SELECT *, string_split(text, chr(10)) AS s FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL))"


@query(
    "q_store_upsert",
    f"""WITH {_LINES},
      n AS (SELECT DISTINCT doc_id, unnest([0, 1]) AS chunk_index FROM l WHERE lang = 'de')
      SELECT l.doc_id, l.chunk_index, md5(CASE WHEN n.doc_id IS NULL THEN l.text ELSE 'new' END) AS digest,
             CASE WHEN n.doc_id IS NOT NULL THEN NULL WHEN l.lang = 'en' THEN 'refreshed ' || l.doc_id ELSE l.title END AS title FROM l LEFT JOIN n USING (doc_id, chunk_index)
      UNION ALL SELECT doc_id, chunk_index, md5('new'), NULL FROM n ANTI JOIN l USING (doc_id, chunk_index)""",
)
def store_upsert(spark, d) -> DataFrame:
    """A store of all lines; the first two of German documents replaced or added, then the titles of English ones brought up to date."""
    lines = _lines(spark, d)
    store = ChunkStore.create(lines)
    german = table(spark, d, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL AND lang = 'de'")
    store.upsert(german.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_index"), F.lit("new").alias("text"), "lang"))
    english = table(spark, d, "documents").where("lang = 'en'")
    store.refresh(english.select("doc_id", F.concat(F.lit("refreshed "), F.col("doc_id").cast("string")).alias("title")), ("title",))
    return store.rows().select("doc_id", "chunk_index", F.md5("text").alias("digest"), "title")


@query(
    "q_store_replace",
    f"""WITH {_LINES} SELECT doc_id, chunk_index, md5(text) AS digest FROM l WHERE lang NOT IN ('de', 'fr') OR lang IS NULL
      UNION ALL SELECT DISTINCT doc_id, 0, md5('one') FROM l WHERE lang = 'de'""",
)
def store_replace(spark, d) -> DataFrame:
    """A store of all lines; German documents become one chunk, French ones go."""
    store = ChunkStore.create(_lines(spark, d))
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    store.replace(docs.where("lang = 'de'").select("doc_id", F.lit(0).alias("chunk_index"), F.lit("one").alias("text"), "lang"))
    store.delete(docs.where("lang = 'fr'"))
    return store.rows().select("doc_id", "chunk_index", F.md5("text").alias("digest"))
