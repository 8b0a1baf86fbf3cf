"""Queries of entity resolution, evaluation, queues and chat, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..operators import entities as E
from ..operators import similar_names as SN
from ..operators import models as M
from ..operators import queues as K
from ..sources.tables import assign_splits, of_split, table
from ..storage import new_folder
from .text_queries import _norm_sql, query

# --- entities --------------------------------------------------------------------------------------------------------


def part_records(spark, d) -> DataFrame:
    names = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    return E.records(names)


_REC = f"""n AS (SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY p_name),
  r AS (SELECT id, name, {_norm_sql('name', T.SENDER_SUFFIXES)} AS norm FROM n), rt AS (SELECT *, list_filter(string_split(norm, ' '), lambda x: x <> '') AS toks FROM r)"""
_KEYS = f"""{_REC}, k AS (SELECT DISTINCT id, unnest(list_concat(['token_sort:' || array_to_string(list_sort(toks), ' ')],
  CASE WHEN len(toks) > 0 THEN list_concat(['first:' || toks[1], 'prefix:' || substr(norm, 1, 12)], list_transform(list_filter(toks, lambda x: length(x) >= 4), lambda x: 'token:' || x)) ELSE [] END)) AS key FROM rt)"""
_PAIRS = f"{_KEYS}, p AS (SELECT DISTINCT a.id AS l, b.id AS r FROM k a JOIN k b ON a.key = b.key AND a.id < b.id)"


@query("q_blocking_keys", f"WITH {_KEYS} SELECT id, key FROM k")
def blocking_keys(spark, d) -> DataFrame:
    return part_records(spark, d).select("id", F.explode(T.blocking_keys(F.col("norm"), F.col("toks"))).alias("key"))


@query("q_block_pairs", f'WITH {_PAIRS} SELECT l AS "left", r AS "right" FROM p')
def block_pairs(spark, d) -> DataFrame:
    return E.candidate_pairs(part_records(spark, d))


_HINTS = ", ".join(f"'{w}'" for w in T.HINT_TOKENS)
_GENERIC = ", ".join(f"'{w}'" for w in T.GENERIC_TOKENS)
_PERSON = f"(len({{0}}) BETWEEN 2 AND 4 AND NOT list_has_any({{0}}, [{_HINTS}]) AND len(list_filter({{0}}, lambda x: NOT regexp_full_match(x, '\\p{{{{L}}}}{{{{2,}}}}'))) = 0)"
_LEFT = f"list_filter({{0}}, lambda x: NOT list_contains([{_GENERIC}], x))"


@query(
    "q_pair_features",
    f"""WITH {_PAIRS}, f AS (SELECT l, r, a.toks AS x, b.toks AS y, list_distinct(a.toks) AS dx, list_distinct(b.toks) AS dy FROM p JOIN rt a ON p.l = a.id JOIN rt b ON p.r = b.id)
        SELECT l AS "left", r AS "right", round(CASE WHEN len(dx) = 0 OR len(dy) = 0 THEN 0 ELSE len(list_intersect(dx, dy)) / CAST(greatest(len(dx), len(dy)) AS DOUBLE) END, 6) AS overlap,
               ({_PERSON.format('x')} <> {_PERSON.format('y')}) OR (len({_LEFT.format('x')}) > 0 AND len({_LEFT.format('y')}) > 0 AND NOT list_has_any({_LEFT.format('x')}, {_LEFT.format('y')})) AS conflict FROM f""",
)
def pair_features(spark, d) -> DataFrame:
    rows = part_records(spark, d)
    return E.pair_features(E.candidate_pairs(rows), rows, with_ratio=False).select("left", "right", F.round("overlap", 6).alias("overlap"), "conflict")


@query("q_pair_decisions")
def pair_decisions(spark, d) -> DataFrame:
    return E.decisions_of(part_records(spark, d)).select("left", "right", "decision", "confidence", F.round("ratio", 6).alias("ratio"))


@query("q_near_decisions")
def near_decisions(spark, d) -> DataFrame:
    """The merges and reviews of ``q_pair_decisions`` between different names, from the set-similarity join."""
    return SN.near_decisions(part_records(spark, d)).select("left", "right", "decision", "confidence", F.round("ratio", 6).alias("ratio"), "weight")


#: Added to a supplier's key for its twin.
TWIN = 10_000_000_000


def _twins(spark, d) -> tuple[DataFrame, DataFrame]:
    """Suppliers, and the same names written otherwise, as senders with customers' orders as documents."""
    s = table(spark, d, "supplier")
    senders = s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Bank "), F.col("s_name")).alias("name"))
    senders = senders.union(s.select(F.col("s_suppkey") + TWIN, F.concat(F.lit("BANK "), F.upper("s_name"), F.lit(" Inc."))))
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("t").alias("title"), (F.col("o_custkey") + F.when(F.col("o_orderkey") % 3 == 0, TWIN).otherwise(0)).alias("correspondent"))
    return senders, docs


_TWINS = f"""s AS (SELECT s_suppkey AS id, 'Bank ' || s_name AS name FROM supplier UNION ALL SELECT s_suppkey + {TWIN}, 'BANK ' || upper(s_name) || ' Inc.' FROM supplier),
  docs AS (SELECT o_orderkey AS id, o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN {TWIN} ELSE 0 END AS c FROM orders),
  m AS (SELECT s.id, name, {_norm_sql('name', T.SENDER_SUFFIXES)} AS norm, count(docs.id) AS n, list(docs.id ORDER BY docs.id) FILTER (WHERE docs.id IS NOT NULL) AS ids FROM s LEFT JOIN docs ON docs.c = s.id AND docs.c <> 0 GROUP BY s.id, name),
  g AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY n DESC, length(name) DESC, id) AS place, count(*) OVER (PARTITION BY norm) AS k FROM m),
  cl AS (SELECT max(CASE WHEN place = 1 THEN id END) AS canonical_id, list(id ORDER BY id) FILTER (WHERE place > 1) AS merged_ids, CAST(sum(CASE WHEN place > 1 THEN n ELSE 0 END) AS BIGINT) AS source_documents FROM g WHERE k > 1 GROUP BY norm)"""


def _exact_clusters(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    senders, docs = _twins(spark, d)
    rows = E.records(senders, docs)
    same = rows.select("norm", F.col("id").alias("a")).join(rows.groupBy("norm").agg(F.min("id").alias("b")), "norm").where("a <> b")
    merge = same.select(F.col("b").alias("left"), F.col("a").alias("right"), F.lit("merge").alias("decision"), F.lit("high").alias("confidence"), F.array(F.lit("normalized_exact_match")).alias("reasons"))
    return merge, E.clusters(merge, rows), E.orphans(senders, docs)


@query("q_clusters", f"WITH {_TWINS} SELECT canonical_id, merged_ids, source_documents FROM cl")
def clusters(spark, d) -> DataFrame:
    return _exact_clusters(spark, d)[1].select("canonical_id", "merged_ids", F.col("source_documents").cast("long").alias("source_documents"))


@query("q_orphans", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey <> 0)")
def orphans(spark, d) -> DataFrame:
    senders = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return E.orphans(senders, table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("correspondent"))).select("id", "name")


@query(
    "q_merge_plan_summary",
    f"""WITH {_TWINS} SELECT (SELECT sum(len(merged_ids)) FROM cl)::BIGINT AS merge_pairs, 0::BIGINT AS review_pairs, 0::BIGINT AS reject_pairs, (SELECT count(*) FROM cl) AS clusters,
        (SELECT coalesce(sum(source_documents), 0) FROM cl)::BIGINT AS planned_moves, (SELECT count(*) FROM m WHERE n = 0) AS orphans""",
)
def plan_summary(spark, d) -> DataFrame:
    return E.plan_summary(*_exact_clusters(spark, d))


@query("q_merge_apply", f"WITH {_TWINS} SELECT c AS correspondent_before, coalesce(canonical_id, c) AS correspondent, count(*) AS documents FROM docs LEFT JOIN (SELECT canonical_id, unnest(merged_ids) AS gone FROM cl) x ON c = gone GROUP BY ALL")
def merge_apply(spark, d) -> DataFrame:
    senders, docs = _twins(spark, d)
    _, found, lone = _exact_clusters(spark, d)
    plan = {"clusters": found.withColumn("status", F.lit("approved")), "orphans": lone}
    _, after, _ = E.apply_plan(plan, senders, docs.withColumn("correspondent_before", F.col("correspondent")))
    return after.groupBy("correspondent_before", "correspondent").agg(F.count("*").alias("documents"))


@query("q_documents_per_sender", "SELECT o_custkey AS correspondent, count(*) AS count FROM orders GROUP BY o_custkey")
def per_sender(spark, d) -> DataFrame:
    return E.documents_per_sender(table(spark, d, "orders").select(F.col("o_custkey").alias("correspondent")))


# --- evaluation ------------------------------------------------------------------------------------------------------


def _dates(spark, d) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    k = F.col("l_orderkey") % 11
    expected = F.when(k == 0, None).otherwise(iso("o_orderdate"))
    actual = F.when(k <= 1, None).when(k == 2, "soon").when(k == 3, iso("o_orderdate")).otherwise(iso("l_shipdate"))
    return rows.select("l_orderkey", "l_linenumber", expected.alias("e"), actual.alias("a"))


_DATES = """x AS (SELECT l_orderkey, l_linenumber, l_orderkey % 11 AS k, CAST(o_orderdate AS DATE) AS e, CAST(l_shipdate AS DATE) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  y AS (SELECT l_orderkey, l_linenumber, k, CASE WHEN k IN (1, 2) THEN NULL WHEN k IN (0, 3) THEN 0 ELSE abs(date_diff('day', s, e)) END AS dist FROM x),
  z AS (SELECT l_orderkey, l_linenumber, CASE WHEN k = 0 THEN true WHEN k IN (1, 2) THEN false ELSE dist = 0 END AS date_exact_match, dist AS date_distance_days,
        CASE WHEN k = 0 THEN 1.0 WHEN k IN (1, 2) THEN 0.0 ELSE greatest(0, 1 - dist / 365.0::DOUBLE) END::DOUBLE AS date_partial_credit,
        CASE WHEN k = 0 THEN true WHEN k = 1 THEN false END AS date_null_correct, k FROM y)"""


@query("q_score_date", f"WITH {_DATES} SELECT l_orderkey, l_linenumber, date_exact_match, date_distance_days, round(date_partial_credit, 6) AS date_partial_credit, date_null_correct FROM z")
def score_date(spark, d) -> DataFrame:
    s = S.score_date(F.col("e"), F.col("a"))
    s["date_partial_credit"] = F.round(s["date_partial_credit"], 6)
    return _dates(spark, d).select("l_orderkey", "l_linenumber", *[v.alias(k) for k, v in s.items()])


@query(
    "q_score_title",
    """WITH p AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE p_type END AS e, p_name || ' ' || lower(CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END) AS a FROM part),
       t AS (SELECT *, list_distinct(list_filter(string_split(lower(e), ' '), lambda x: x <> '')) AS x, list_distinct(list_filter(string_split(lower(a), ' '), lambda x: x <> '')) AS y FROM p)
       SELECT p_partkey, CASE WHEN e <> '' THEN contains(lower(a), lower(e)) END AS title_contains_match,
              CASE WHEN e <> '' THEN round(len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE), 6) END AS title_keyword_overlap FROM t""",
)
def score_title(spark, d) -> DataFrame:
    expected = F.when(F.col("p_partkey") % 7 == 1, "").when(F.col("p_partkey") % 7 != 0, F.col("p_type"))
    actual = F.concat("p_name", F.lit(" "), F.lower(F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.col("p_brand"))))
    s = S.score_title(expected, actual)
    return table(spark, d, "part").select("p_partkey", s["title_contains_match"].alias("title_contains_match"), F.round(s["title_keyword_overlap"], 6).alias("title_keyword_overlap"))


_CORR = f"""c AS (SELECT d.doc_id, CASE WHEN quality IS NULL THEN NULL ELSE source || ' Inc' END AS e, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN upper(source) || ', LLC' ELSE lang END AS a FROM documents d LEFT JOIN labels USING (doc_id)),
  v AS (SELECT doc_id, CASE WHEN e IS NULL AND a IS NULL THEN true WHEN e IS NULL OR a IS NULL THEN false ELSE {_norm_sql('e', T.EVAL_SUFFIXES)} = {_norm_sql('a', T.EVAL_SUFFIXES)} END AS corr_exact_match, e IS NULL AS corr_expected_null, a IS NULL AS corr_predicted_null FROM c)"""


def _senders(spark, d, fuzzy: bool) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    k = F.col("doc_id") % 4
    expected = F.when(F.col("quality").isNotNull(), F.concat("source", F.lit(" Inc")))
    actual = F.when(k == 0, None).when(k == 1, F.concat(F.upper("source"), F.lit(", LLC"))).otherwise(F.col("lang"))
    s = S.score_sender(expected, actual, fuzzy)
    return rows.select("doc_id", *[v.alias(n) for n, v in s.items()])


@query("q_score_corr_null", f"WITH {_CORR} SELECT * FROM v")
def score_corr(spark, d) -> DataFrame:
    return _senders(spark, d, False)


@query("q_score_corr_fuzzy")
def score_fuzzy(spark, d) -> DataFrame:
    return _senders(spark, d, True)


@query(
    "q_eval_aggregate",
    f"""WITH {_CORR}, {_DATES}, dd AS (SELECT l_orderkey AS doc_id, date_exact_match, date_partial_credit FROM z), j AS (SELECT * FROM v LEFT JOIN dd USING (doc_id))
        SELECT round(avg(corr_exact_match::INT), 6) AS correspondent_exact_accuracy, round(count(*) FILTER (WHERE corr_expected_null AND corr_predicted_null) / CAST(nullif(count(*) FILTER (WHERE corr_predicted_null), 0) AS DOUBLE), 6) AS null_precision,
          round(count(*) FILTER (WHERE corr_expected_null AND corr_predicted_null) / CAST(nullif(count(*) FILTER (WHERE corr_expected_null), 0) AS DOUBLE), 6) AS null_recall,
          round(avg(date_exact_match::INT), 6) AS date_exact_accuracy, round(avg(date_partial_credit), 6) AS date_partial_mean, count(*) AS n FROM j""",
)
def eval_aggregate(spark, d) -> DataFrame:
    s = S.score_date(F.col("e"), F.col("a"))
    dates = _dates(spark, d).select(F.col("l_orderkey").alias("doc_id"), *[v.alias(k) for k, v in s.items()])
    rows = _senders(spark, d, False).join(dates, "doc_id", "left").withColumn("corr_fuzzy_score", F.lit(None).cast("double")).withColumn("title_contains_match", F.lit(None).cast("boolean"))
    got = S.aggregate_scores(rows)
    keep = ("correspondent_exact_accuracy", "null_precision", "null_recall", "date_exact_accuracy", "date_partial_mean")
    return got.select(*[F.round(c, 6).alias(c) for c in keep], "n")


@query(
    "q_majority_vote",
    """WITH c AS (SELECT user_id, event_type, count(*) AS k FROM events GROUP BY ALL), m AS (SELECT user_id, max(k) AS top, sum(k)::BIGINT AS n_votes FROM c GROUP BY user_id)
       SELECT user_id, CASE WHEN count(*) > 1 THEN 'tie' ELSE max(event_type) END AS verdict, n_votes FROM c JOIN m USING (user_id) WHERE k = top GROUP BY user_id, n_votes""",
)
def majority(spark, d) -> DataFrame:
    return S.majority(table(spark, d, "events"), "user_id", "event_type")


_SPLIT = "s AS (SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'validation' ELSE 'test' END AS split FROM documents)"


@query("q_split_filter", f"WITH {_SPLIT} SELECT split, count(*) AS n FROM s GROUP BY split UNION ALL SELECT 'missing', 1")
def split_filter(spark, d) -> DataFrame:
    entries = table(spark, d, "documents").select("doc_id", F.col("source").alias("original_key"), F.concat(F.lit("/app/"), F.col("lang"), F.lit(".pdf")).alias("file_path"))
    out, missing = assign_splits(entries, ["src1", "src2", "no such key"])
    parts = [of_split(out, s).select(F.lit(s).alias("split")) for s in ("validation", "test")]
    return parts[0].union(parts[1]).groupBy("split").agg(F.count("*").alias("n")).union(missing.agg(F.lit("missing").alias("split"), F.count("*").alias("n")))


# --- queues ------------------------------------------------------------------------------------------------------------

_TAGS = "CASE event_type WHEN 'click' THEN 'embed, metadata' WHEN 'view' THEN 'ocr,embed' WHEN 'error' THEN ' embed ' ELSE '' END"
_STAGE = "CASE event_type WHEN 'click' THEN 'metadata' WHEN 'view' THEN 'ocr' WHEN 'error' THEN 'embed' ELSE 'refresh' END"


def staged(spark, d) -> DataFrame:
    kind = F.col("event_type")
    tags = F.when(kind == "click", "embed, metadata").when(kind == "view", "ocr,embed").when(kind == "error", " embed ").otherwise("")
    return table(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("doc_id"), "event_type", T.route(T.tag_set(tags)).alias("stage"))


@query("q_route_stage", f"SELECT event_id, {_STAGE} AS stage FROM events")
def route_stage(spark, d) -> DataFrame:
    return staged(spark, d).select("event_id", "stage")


@query(
    "q_queue_dedup",
    f"""WITH o AS (SELECT event_id, user_id, {_STAGE} AS stage, ts, CASE WHEN event_id % 4 = 3 THEN 'remove' ELSE 'enqueue' END AS op FROM events)
        SELECT event_id, coalesce((SELECT arg_max(p.op, (p.ts, p.event_id)) FROM o p WHERE p.user_id = o.user_id AND p.stage = o.stage AND (p.ts, p.event_id) < (o.ts, o.event_id)) = 'remove', true) AS added
        FROM o WHERE op = 'enqueue'""",
)
def queue_dedup(spark, d) -> DataFrame:
    """Every fourth event takes the document out of its queue, after which it is new again."""
    events = staged(spark, d).withColumn("op", F.when(F.col("event_id") % 4 == 3, "remove").otherwise("enqueue"))
    return K.dedup_enqueue(events).select("event_id", "added")


@query(
    "q_retry_backoff",
    """WITH o AS (SELECT *, event_type = 'purchase' AS ok FROM events WHERE event_type IN ('error', 'purchase')),
       r AS (SELECT *, sum(ok::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM o),
       n AS (SELECT event_id, CAST((row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1) % 3 + 1 AS INTEGER) AS attempt FROM r WHERE NOT ok)
       SELECT event_id, attempt, attempt = 3 AS dead, CAST(CASE WHEN attempt < 3 THEN least(60 * pow(2, attempt - 1), 3600) END AS BIGINT) AS delay_s FROM n""",
)
def retry_backoff(spark, d) -> DataFrame:
    rows = table(spark, d, "events").where("event_type IN ('error', 'purchase')").select("event_id", "ts", F.col("user_id").alias("doc_id"), (F.col("event_type") == "purchase").alias("ok"))
    return K.retries(rows).select("event_id", "attempt", "dead", "delay_s")


@query(
    "q_suppression",
    """SELECT event_id, EXISTS (SELECT 1 FROM events m WHERE m.event_type = 'purchase' AND m.user_id = e.user_id AND m.ts <= e.ts AND e.ts < m.ts + INTERVAL 300 SECONDS) AS ignored FROM events e WHERE event_type <> 'purchase'""",
)
def suppression(spark, d) -> DataFrame:
    return K.suppressed(table(spark, d, "events"), F.col("event_type") == "purchase", "user_id").select("event_id", "ignored")


_REPLAY = f"""q AS (SELECT user_id, {_STAGE} AS stage, arg_max(CASE WHEN event_id % 4 = 3 THEN 'remove' ELSE 'enqueue' END, (ts, event_id)) AS op FROM events GROUP BY 1, 2)"""


def ops(spark, d) -> DataFrame:
    return staged(spark, d).withColumn("op", F.when(F.col("event_id") % 4 == 3, "remove").otherwise("enqueue"))


@query("q_pending_counts", f"WITH {_REPLAY} SELECT stage, count(*) AS pending FROM q WHERE op = 'enqueue' GROUP BY stage")
def pending_counts(spark, d) -> DataFrame:
    return K.pending(K.replay(ops(spark, d)))


@query("q_stage_outcomes", "SELECT count(*) FILTER (WHERE event_type = 'purchase') AS succeeded, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events")
def stage_outcomes(spark, d) -> DataFrame:
    return K.outcomes(table(spark, d, "events").select(F.when(F.col("event_type") == "purchase", True).when(F.col("event_type") == "error", False).alias("ok")))


@query("q_health", "SELECT false AS healthy")
def health(spark, d) -> DataFrame:
    beats = table(spark, d, "events").groupBy("event_type").agg(F.max(K.seconds(F.col("ts"))).alias("beat"))
    return K.healthy(beats, F.lit(2e9))


@query("q_stream_pending", f"WITH {_REPLAY} SELECT stage, count(*) AS pending FROM q WHERE op = 'enqueue' GROUP BY stage")
def stream_pending(spark, d) -> DataFrame:
    """The same counts from the stateful stream over the event files."""
    from ..streaming import queues as SQ

    SQ.use_rocksdb(spark)
    schema = table(spark, d, "events").schema
    path = f"{d}/events.parquet"
    stream = spark.readStream.schema(schema).parquet(_listing(spark, path))
    kind = F.col("event_type")
    tags = F.when(kind == "click", "embed, metadata").when(kind == "view", "ocr,embed").when(kind == "error", " embed ").otherwise("")
    events = stream.select("event_id", K.seconds(F.col("ts")).alias("ts"), F.col("user_id").alias("doc_id"), T.route(T.tag_set(tags)).alias("stage"), F.when(F.col("event_id") % 4 == 3, "remove").otherwise("enqueue").alias("op"))
    out, check = new_folder(spark, "stream"), new_folder(spark, "streamlog")
    SQ.run_once(SQ.stage_queue(events, timers=False), out, check)
    return K.pending(SQ.latest(spark.read.schema(SQ.CHANGE).parquet(out)))


def _listing(spark, path: str) -> str:
    """A stream reads a folder or a pattern; a single file is matched by a pattern of its name."""
    return path[:-1] + "[" + path[-1] + "]"


# --- chat --------------------------------------------------------------------------------------------------------------


def _steps(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    n = F.length("text")
    return c.select("conv_id", F.when(F.col("role") == "user", n).alias("prompt"), F.when(F.col("role") == "assistant", n).alias("completion"), F.when(F.col("turn") % 3 == 0, n + 1).alias("total"))


@query(
    "q_chat_usage",
    """WITH s AS (SELECT conv_id, CASE WHEN role = 'user' THEN length(text) ELSE 0 END AS p, CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END AS c, CASE WHEN turn % 3 = 0 THEN length(text) + 1 END AS t FROM conversations),
       g AS (SELECT conv_id, sum(p)::BIGINT AS prompt, sum(c)::BIGINT AS completion, sum(coalesce(t, p + c))::BIGINT AS total FROM s GROUP BY conv_id)
       SELECT conv_id, CASE WHEN total > 0 THEN prompt END AS prompt, CASE WHEN total > 0 THEN completion END AS completion, CASE WHEN total > 0 THEN total END AS total FROM g""",
)
def chat_usage(spark, d) -> DataFrame:
    return M.conversation_usage(_steps(spark, d))


@query(
    "q_chat_sources",
    """SELECT conv_id AS doc_id, bool_or(role <> 'assistant') AS matched, bool_or(role = 'assistant') AS inspected, source AS title FROM conversations JOIN documents ON conv_id = doc_id GROUP BY conv_id, source""",
)
def chat_sources(spark, d) -> DataFrame:
    refs = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.when(F.col("role") == "assistant", "read").otherwise("search").alias("kind"))
    return M.chat_sources(refs, table(spark, d, "documents").select("doc_id", F.col("source").alias("title")))


@query("q_first_titles", "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) SELECT o_custkey, list(o_orderkey ORDER BY n) AS sample FROM r WHERE n <= 5 GROUP BY o_custkey")
def first_titles(spark, d) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("n")).where("n <= 5")
    return rows.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("sample"))


@query("q_ai_result", """SELECT doc_id, '{"timestamp":"t","metadata_model":"m","metadata_api_base":null,"version":"1","ai_metadata":{"title":"' || source || '","document_date":null,"correspondent":"' || lang || '","summary":null}}' AS blob FROM documents""")
def ai_result(spark, d) -> DataFrame:
    none = F.lit(None).cast("string")
    blob = T.ai_result(F.lit("t"), F.lit("m"), none, F.lit("1"), F.col("source"), none, F.col("lang"), none)
    return table(spark, d, "documents").select("doc_id", blob.alias("blob"))
