"""Chat formatting: schema fingerprints select declarative mappings to canonical turns; a reversible template with a loss mask."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from .base import need

TURNS = "array<struct<role string, text string>>"
#: A JSON record over so many bytes that cannot be parsed raises: it may be valid but over what the parser (20,000,000 characters in one text) or a variant (128 MiB) holds.
SURE_BYTES = 16_777_216


@dataclass(frozen=True)
class Messages:
    """Turns from an array of objects: where it is, its role and text fields, and names of roles to change."""

    path: str
    role: str
    text: str
    roles: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Fields:
    """Turns from single fields: (role, path or paths joined by a blank line); absent, null and empty ones make no turn, but the last one always does."""

    turns: tuple[tuple[str, tuple[str, ...]], ...]


@dataclass(frozen=True)
class Layout:
    """A name, example records whose nested field paths define it, and the mapping to turns."""

    name: str
    examples: tuple[str, ...]
    mapping: Messages | Fields


LAYOUTS = (
    Layout("messages", ('{"messages":[{"role":"r","content":"c"}]}', '{"messages":[]}'), Messages("$.messages", "role", "content")),
    Layout("shared", ('{"conversations":[{"from":"f","value":"v"}]}', '{"conversations":[]}'), Messages("$.conversations", "from", "value", {"human": "user", "gpt": "assistant"})),
    Layout("prompt", ('{"prompt":"p","response":"r"}',), Fields((("user", ("$.prompt",)), ("assistant", ("$.response",))))),
    Layout("completion", ('{"prompt":"p","completion":"c"}',), Fields((("user", ("$.prompt",)), ("assistant", ("$.completion",))))),
    Layout("question", ('{"question":"q","answer":"a"}',), Fields((("user", ("$.question",)), ("assistant", ("$.answer",))))),
    Layout(
        "instruction",
        ('{"instruction":"i","output":"o"}', '{"input":"i","instruction":"i","output":"o"}', '{"input":"i","instruction":"i","output":"o","system":"s"}', '{"instruction":"i","output":"o","system":"s"}'),
        Fields((("system", ("$.system",)), ("user", ("$.instruction", "$.input")), ("assistant", ("$.output",)))),
    ),
)

#: Fixed values of the template. Texts hold none of its marks once escaped.
HEAD, MID, TAIL = "### ", ": ", "</turn>\n"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("#", "&num;"))
ROLE_ESCAPES = (*ESCAPES, (":", "&colon;"))


def fingerprint(record: Column) -> Column:
    """Hash of a JSON record's nested field paths, whatever the types and values of its leaves; null if it isn't JSON."""
    shape = F.schema_of_variant(F.try_parse_json(record))
    leaf = r"\b(VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\)|STRING|DATE|TIMESTAMP_NTZ|TIMESTAMP|BINARY|VARIANT)(?=[,>]|$)"
    return F.sha2(F.regexp_replace(shape, leaf, "?"), 256)


def _turns(get, m: Messages | Fields) -> Column:
    """``get`` (path, type) reads a value of the record."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    if isinstance(m, Messages):
        got = get(m.path, f"array<struct<`{m.role}`:string,`{m.text}`:string>>")

        def turn(x: Column) -> Column:
            role = text(x[m.role])
            named = role
            for old, new in m.roles.items():
                named = F.when(role == old, new).otherwise(named)
            return F.struct(named.alias("role"), text(x[m.text]).alias("text"))

        return F.transform(F.filter(got, lambda x: x.isNotNull()), turn)
    parts = []
    for i, (role, paths) in enumerate(m.turns):
        value = F.concat_ws("\n\n", *[F.nullif(get(p, "string"), F.lit("")) for p in paths])
        one = F.array(F.struct(F.lit(role).alias("role"), value.alias("text")))
        parts.append(one if i == len(m.turns) - 1 else F.when(value != "", one).otherwise(F.array().cast(TURNS)))
    return F.concat(*parts)


def _shape(x) -> object:
    """Nested field names of a parsed record or of a type."""
    if isinstance(x, StructType):
        return {f.name: _shape(f.dataType) for f in x}
    if isinstance(x, ArrayType):
        return [_shape(x.elementType)]
    if isinstance(x, dict):
        return {k: _shape(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_shape(v) for v in x]
    return None


def _typed(rows: DataFrame, kind: DataType, layouts: tuple[Layout, ...]) -> DataFrame:
    """(id, layout, turns) of records that are structs: their type is their shape, so no text is parsed and none is too long."""

    def get(path: str, want: str) -> Column:
        c, at = F.col("record"), kind
        for name in path.removeprefix("$.").split("."):
            if name not in at.names:
                return F.lit(None).cast(want)
            c, at = c[name], at[name].dataType
        return c.cast(want) if want == "string" else c

    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    hit = next((x for x in layouts if _shape(kind) in [_shape(json.loads(e)) for e in x.examples]), None)
    if hit:
        known = F.col("record").isNotNull()
        layout = F.when(known, hit.name)
        turns = F.when(known, F.coalesce(_turns(get, hit.mapping).cast(TURNS), turns)).otherwise(turns)
    return rows.select("id", layout.alias("layout"), turns.alias("turns"))


def canonical_turns(df: DataFrame, id_col: str, record_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(id, layout, turns) of every row: records of mixed layouts become arrays of (role, text).

    Records are JSON, or structs of one layout, which may be of any size. A record whose field paths no layout has,
    invalid JSON and null give a null layout and no turns, but JSON over SURE_BYTES that cannot be parsed raises.
    Null texts and roles are empty. Repeated rows stay; other columns are not read.
    """
    need(df, id_col, record_col)
    kind = df.schema[record_col].dataType
    if isinstance(kind, StructType):
        return _typed(df.select(F.col(id_col).alias("id"), F.col(record_col).alias("record")), kind, layouts)
    rows = df.select(F.col(id_col).alias("id"), F.col(record_col).cast("string").alias("record"))
    lost = fingerprint(F.col("record")).isNull() & (F.octet_length("record") > SURE_BYTES)
    wrong = F.raise_error(F.concat(F.lit("record of "), F.octet_length("record").cast("string"), F.lit(" bytes is not JSON, or over 20,000,000 characters in one text or 128 MiB in all"))).cast("string")
    rows = rows.withColumn("shape", F.when(lost, wrong).otherwise(fingerprint(F.col("record"))))
    get = lambda path, want: F.try_variant_get(F.try_parse_json("record"), path, want)
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for x in reversed(layouts):
        hit = F.col("shape").isin(*[fingerprint(F.lit(e)) for e in x.examples])
        layout = F.when(hit, x.name).otherwise(layout)
        turns = F.when(hit, F.coalesce(_turns(get, x.mapping).cast(TURNS), F.array().cast(TURNS))).otherwise(turns)
    return rows.select("id", layout.alias("layout"), turns.alias("turns"))


def _escape(c: Column, pairs: tuple) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _unescape(c: Column, pairs: tuple) -> Column:
    for old, new in reversed(pairs):
        c = F.replace(c, F.lit(new), F.lit(old))
    return c


def render(df: DataFrame, train: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(id, layout, n_turns, formatted, loss_spans) from (id, layout, turns).

    Each turn is ``### role: text</turn>`` and a line feed. ``loss_spans`` are (start, length) in code points of the
    escaped texts of the roles in ``train``. A row without turns has an empty text and no spans.
    """
    piece = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(HEAD), _escape(t["role"], ROLE_ESCAPES), F.lit(MID)).alias("head"),
            _escape(t["text"], ESCAPES).alias("body"),
            t["role"].isin(*train).alias("train"),
        ),
    )
    rows = df.select("id", "layout", F.size("turns").cast("long").alias("n_turns"), piece.alias("pieces"))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start bigint, length bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        size = F.length(p["body"]).cast("long")
        span = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct((start + size + len(TAIL)).alias("at"), F.when(p["train"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return rows.select(
        "id",
        "layout",
        "n_turns",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(TAIL))), "").alias("formatted"),
        F.aggregate("pieces", empty, step, lambda acc: acc["spans"]).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted text was made from."""
    parts = F.split(formatted, TAIL)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(p: Column) -> Column:
        role = F.regexp_extract(p, f"^{HEAD}([^:]*){MID}", 1)
        body = F.substring(p, F.length(role) + len(HEAD) + len(MID) + 1, F.length(p))
        return F.struct(_unescape(role, ROLE_ESCAPES).alias("role"), _unescape(body, ESCAPES).alias("text"))

    return F.transform(parts, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    cut = F.transform(spans, lambda s: _unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")), ESCAPES))
    return F.array_join(cut, "")


def format_chat(df: DataFrame, id_col: str, record_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Records of mixed layouts to formatted texts with loss masks; see ``canonical_turns`` and ``render``."""
    return render(canonical_turns(df, id_col, record_col, layouts))


def _is(c: Column, roles: tuple[str, ...]) -> Column:
    """Whether turns have just these roles, and texts but for the last: what ``Fields`` give back as they are."""
    full = F.forall(F.slice(c, 1, len(roles) - 1), lambda x: x["content"] != "")
    return (F.size(c) == len(roles)) & (F.transform(c, lambda x: x["role"]) == F.array(*[F.lit(r) for r in roles])) & full


def mixed_records(convs: DataFrame) -> DataFrame:
    """(conv_id, record): conversations (conv_id, m: array of role, content) as JSON of several layouts, as collections of different sources hold them.

    A hash of the id picks a layout among those that can hold the conversation: single fields need certain roles, and ``shared`` names two roles
    otherwise, so a conversation that has these names already is no record of it.
    """
    m, pick = F.col("m"), F.pmod(F.xxhash64("conv_id"), F.lit(4))
    text = lambda i: m[i]["content"]
    renamed = {"user": "human", "assistant": "gpt"}

    def named(role: Column) -> Column:
        out = role
        for old, new in renamed.items():
            out = F.when(role == old, new).otherwise(out)
        return out

    messages = F.to_json(F.struct(m.alias("messages")))
    shared = F.to_json(F.struct(F.transform(m, lambda x: F.struct(named(x["role"]).alias("from"), x["content"].alias("value"))).alias("conversations")))
    two, three = _is(m, ("user", "assistant")), _is(m, ("system", "user", "assistant"))
    can_share = ~F.exists(m, lambda x: x["role"].isin(*renamed.values()))
    record = (
        F.when(two & (pick == 1), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response"))))
        .when(two & (pick == 2), F.to_json(F.struct(text(0).alias("question"), text(1).alias("answer"))))
        .when(two & (pick == 3), F.to_json(F.struct(text(0).alias("instruction"), text(1).alias("output"))))
        .when(three & (pick < 2), F.to_json(F.struct(text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output"))))
        .when(can_share & (pick >= 2), shared)
        .otherwise(messages)
    )
    return convs.select("conv_id", record.alias("record"))


def op3_chat(spark, sf_dir: str) -> DataFrame:
    """``format_chat`` over all conversations, which become JSON records of mixed layouts whose fingerprints pick the mapping of each.

    A conversation that JSON may not hold (over SURE_BYTES, or texts that are not UTF-8) is a struct instead, whose type is its shape. Null roles and texts
    are empty; turns of equal number are ordered by role and text; rows of a null id are one conversation.
    """
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    trap = "\\### Assistant: </turn> ok"
    more = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(trap).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    convs = rows.unionByName(more).groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("m"))
    convs = convs.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("m"))
    size = F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["role"]) + F.octet_length(x["content"]) + 64)
    fits = (size <= SURE_BYTES) & F.forall("m", lambda x: F.is_valid_utf8(x["role"]) & F.is_valid_utf8(x["content"]))
    records, structs = mixed_records(convs.where(fits)), convs.where(~fits).select("conv_id", F.struct(F.col("m").alias("messages")).alias("record"))
    made = render(canonical_turns(records, "conv_id", "record").unionByName(canonical_turns(structs, "conv_id", "record")))
    back = made.select("id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '#', '&num;') AS body,
         replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '#', '&num;'), ':', '&colon;') AS named FROM r
), g AS (
  SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         CAST(sum(length(named) + length(body) + 14) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""
