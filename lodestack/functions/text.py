"""Text as column expressions: names, snippets, headers, bounded contexts, ids, dates. No user functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms dropped from sender names, from evaluated names, words that say an organisation.
SENDER_SUFFIXES = "inc ltd llc ag gmbh corp co company corporation limited incorporated pllc plc sa bv nv".split()
EVAL_SUFFIXES = "inc ltd llc ag gmbh corp co company limited incorporated".split()
GENERIC_TOKENS = "company corp corporation group holding holdings services solutions systems international global".split()
HINT_TOKENS = GENERIC_TOKENS + "bank insurance university department agency association inc llc ltd gmbh".split()


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words_in(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def strip(c: Column | str) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def squeeze(c: Column | str) -> Column:
    """White space runs become one space, none at the ends."""
    return strip(F.regexp_replace(col(c), r"(?U)\s+", " "))


def present(c: Column | str) -> Column:
    """Null for the empty string: both count as absent."""
    return F.nullif(col(c), F.lit(""))


def _bare(c: Column, suffixes: Sequence[str]) -> Column:
    without = F.regexp_replace(c, rf"(?U)\b({'|'.join(suffixes)})\b", "")
    return squeeze(F.regexp_replace(without, r"(?U)[^\w\s]", " "))


def sender_name(c: Column | str) -> Column:
    """Name of a sender for comparison: lower case, spelled-out ampersand, no dots, apostrophes or legal forms."""
    c = F.replace(F.replace(strip(F.lower(col(c))), F.lit("&"), F.lit(" and ")), F.lit("."), F.lit(""))
    return _bare(F.translate(c, "/-'", "  "), SENDER_SUFFIXES)


def eval_name(c: Column | str) -> Column:
    """Name for scoring: as ``sender_name`` with fewer legal forms, and other punctuation read as spaces."""
    return _bare(F.replace(strip(F.lower(col(c))), F.lit("."), F.lit("")), EVAL_SUFFIXES)


def tokens(c: Column | str) -> Column:
    """Words of a squeezed text; none for an empty one."""
    return F.filter(F.split(squeeze(c), " "), lambda t: t != "")


def token_sort(c: Column | str) -> Column:
    return F.array_join(F.array_sort(tokens(c)), " ")


def token_overlap(a: Column, b: Column) -> Column:
    """Shared distinct tokens of two arrays over the larger number of distinct tokens; 0 if either is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    most = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / most)


def person_shape(t: Column) -> Column:
    """Two to four alphabetic words longer than a letter, none of which says an organisation."""
    alphabetic = F.forall(t, lambda x: x.rlike(r"^\p{L}{2,}$"))
    return F.size(t).between(2, 4) & ~F.arrays_overlap(t, words_in(HINT_TOKENS)) & alphabetic


def shape_conflict(a: Column, b: Column) -> Column:
    """One looks like a person and the other doesn't, or what is left without generic words is disjoint."""
    x, y = (F.array_except(t, words_in(GENERIC_TOKENS)) for t in (a, b))
    return (person_shape(a) != person_shape(b)) | ((F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y))


def blocking_keys(name: Column, t: Column) -> Column:
    """Keys by which names may meet: sorted tokens, first token, first 12 characters, every token of 4 or more."""
    some = F.array(F.concat(F.lit("first:"), F.get(t, F.lit(0))), F.concat(F.lit("prefix:"), F.substring(name, 1, 12)))
    long = F.transform(F.filter(t, lambda x: F.length(x) >= 4), lambda x: F.concat(F.lit("token:"), x))
    head = F.array(F.concat(F.lit("token_sort:"), F.array_join(F.array_sort(t), " ")))
    return F.array_distinct(F.concat(head, F.when(F.size(t) > 0, F.concat(some, long)).otherwise(F.array().cast("array<string>"))))


def snippet(c: Column | str, limit: int = 280) -> Column:
    """Squeezed text of at most ``limit`` characters, cut ones ending in three dots."""
    clean = squeeze(F.coalesce(col(c), F.lit("")))
    cut = F.concat(F.regexp_replace(F.substring(clean, 1, limit - 3), r"(?U)\s+$", ""), F.lit("..."))
    return F.when(F.length(clean) <= limit, clean).otherwise(cut)


def hit_line(doc_id: Column, title: Column, sender: Column, date: Column, kind: Column, path: Column, tags: Column, text: Column) -> Column:
    """One line for a hit; absent and empty parts are left out."""
    label = lambda name, c: F.concat(F.lit(f"{name}: "), present(c))
    listed = F.array_join(tags, ", ")
    parts = F.concat_ws(" | ", F.concat(F.lit("Doc "), F.coalesce(doc_id.cast("string"), F.lit("?"))), present(title), present(sender), present(date), label("Type", kind), label("Path", path), label("Tags", listed))
    return F.concat(F.lit("["), parts, F.lit("]: "), snippet(text))


def chunk_header(title: Column, sender: Column, date: Column, summary: Column) -> Column:
    """Header lines put before a chunk."""
    known = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(present(c), F.lit("Unknown")))
    lines = F.concat_ws("\n", known("Title", title), known("Sender", sender), known("Date", date), F.concat(F.lit("Summary: "), present(summary)), F.lit("---"))
    return F.concat(lines, F.lit("\n"))


def iso_date(c: Column | str) -> Column:
    """Date of a strict ISO day, else null."""
    return F.when(col(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), col(c).try_cast("date"))


def year_of(c: Column | str) -> Column:
    """Year as text: of an ISO day or date-time, else the first four characters of texts that long."""
    c = col(c)
    return F.when(present(c).isNull(), None).otherwise(F.coalesce(F.lpad(F.year(iso_date(F.substring(c, 1, 10))).cast("string"), 4, "0"), F.when(F.length(c) >= 4, F.substring(c, 1, 4))))


def first_label(*names: Column) -> Column:
    """First of several labels that isn't blank, stripped."""
    return F.coalesce(*[present(strip(n)) for n in names])


def webhook_doc_id(doc_url: Column, document_url: Column, document_id: Column, other_id: Column) -> Column:
    """Id from the first nonempty URL's /documents/N part, else from the id fields; null if none is a number."""
    url = F.coalesce(present(doc_url), document_url)
    found = present(F.regexp_extract(F.coalesce(url, F.lit("")), r"/documents/(\d+)(?:/|$)", 1))
    return F.coalesce(found.try_cast("long"), document_id.try_cast("long"), other_id.try_cast("long"))


def tag_set(c: Column) -> Column:
    """Distinct stripped tags of a comma-separated text; null is none."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip)
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def event_tags(tag_list: Column, has_tag_list: Column, document_tags: Column) -> Column:
    """``tag_list`` decides whenever the key is there, even if empty."""
    return tag_set(F.when(has_tag_list, tag_list).otherwise(document_tags))


STAGES = ("ocr", "metadata", "embed", "refresh")


def route(tags: Column, ocr: str = "ocr", metadata: str = "metadata", embed: str = "embed") -> Column:
    """Stage by the tags' priority; refresh if none asks for one."""
    r = F.lit("refresh")
    for tag, stage in ((embed, "embed"), (metadata, "metadata"), (ocr, "ocr")):
        r = F.when(F.array_contains(tags, tag), stage).otherwise(r)
    return r


def bounded_context(c: Column | str, most: int = 6000, start: int = 2500, end: int = 2000, windows: int = 3) -> Column:
    """Texts over ``most`` characters become their start, centred windows of the middle, and their end.

    The ranges are known in closed form from the length; touching ones are merged and gaps show as a line of dots.
    """
    c = F.coalesce(col(c), F.lit(""))
    n = F.length(c)
    budget = max(0, most - start - end)
    width = budget // windows if budget and windows else 0
    low = F.least(F.lit(start), n)
    high = F.greatest(low, n - end)
    ranges = [F.struct(F.lit(0).alias("a"), low.alias("b"))]
    for i in range(1, windows + 1 if width else 1):
        centre = low + F.bround(F.lit(i) * (high - low) / (windows + 1)).cast("int")
        b = F.least(high, F.greatest(low, centre - width // 2) + width)
        ranges.append(F.struct(F.greatest(low, b - width).alias("a"), b.alias("b")))
    ranges.append(F.struct(F.greatest(F.lit(0), n - end).alias("a"), n.alias("b")))
    spans = F.array_sort(F.filter(F.array(*ranges), lambda r: (r["a"] < r["b"]) | (r["a"] == 0)))
    # a text is cut at the running end of what came before, so overlapping parts appear once
    zero = F.struct(F.lit("").alias("text"), F.lit(0).alias("end"))

    def add(acc: Column, r: Column) -> Column:
        frm = F.greatest(acc["end"], r["a"])
        gap = F.when(r["a"] > acc["end"], "\n...\n").otherwise("")
        return F.struct(F.concat(acc["text"], gap, F.substring(c, frm + 1, F.greatest(F.lit(0), r["b"] - frm))).alias("text"), F.greatest(acc["end"], r["b"]).alias("end"))

    return F.when(n <= most, c).otherwise(F.aggregate(spans, zero, add, lambda acc: acc["text"]))


def page_selection(total: Column, threshold: int = 40, first: int = 20, last: int = 20) -> Column:
    """Zero-based pages to read: all up to the threshold, beyond it the first and last so many."""
    none = F.array().cast("array<int>")
    span = lambda a, b: F.when(b > a, F.sequence(a, b - 1)).otherwise(none)
    total = total.cast("int")
    n_first, n_last = F.least(F.lit(first), total), F.least(F.lit(last), total)
    some = F.array_sort(F.array_union(span(F.lit(0), n_first), span(total - n_last, total)))
    return F.when(total > threshold, some).otherwise(span(F.lit(0), total))


def without_thinking(c: Column | str, separate: Column | None = None) -> Column:
    """Answer text without inline thinking spans, stripped; untouched where a provider gave the reasoning apart."""
    c = F.coalesce(col(c), F.lit(""))
    plain = strip(F.regexp_replace(c, r"(?is)<(think|thinking)>.*?</\1>", ""))
    return plain if separate is None else F.when(present(separate).isNotNull(), c).otherwise(plain)


def field_value(fields: Column, field_id: int) -> Column:
    """Value of the first custom field with an id, as text."""
    return F.get(F.filter(fields, lambda f: f["field"] == field_id), F.lit(0))["value"].cast("string")


def merge_fields(fields: Column, managed: dict[int, Column]) -> Column:
    """Custom fields with the managed ones replaced at the end, in the order given."""
    kept = F.filter(F.coalesce(fields, F.array().cast("array<struct<field bigint, value string>>")), lambda f: ~f["field"].isin(*managed))
    return F.concat(kept, F.array(*[F.struct(F.lit(k).cast("long").alias("field"), v.cast("string").alias("value")) for k, v in managed.items()]))


def move_tag(tags: Column, done: Column, following: Column) -> Column:
    """Tags without the finished stage's, and with the next stage's if it isn't there."""
    kept = F.filter(F.coalesce(tags, F.array().cast("array<bigint>")), lambda t: t != done)
    return F.when(following.isNull() | F.array_contains(kept, following), kept).otherwise(F.array_append(kept, following))


def clean_title(c: Column | str) -> Column:
    return F.substring(col(c), 1, 128)


def plausible_date(c: Column | str, today: Column) -> Column:
    """Strict ISO dates from 1900 to ``today``, else null."""
    d = iso_date(c)
    return F.when((d >= F.lit("1900-01-01").cast("date")) & (d <= today), d)


def point_id(doc_id: Column, chunk: Column, stride: int = 10_000) -> Column:
    """Deterministic id of a chunk; it repeats beyond ``stride`` chunks a document."""
    return doc_id.cast("long") * stride + chunk


def judge_excerpt(c: Column | str, limit: int = 2000) -> Column:
    return F.substring(strip(F.coalesce(col(c), F.lit(""))), 1, limit)


def full_text(doc_id: Column, title: Column, content: Column, limit: int = 8000) -> Column:
    """What the read tool shows: a heading and the text, cut at ``limit`` characters."""
    text = strip(F.coalesce(content, F.lit("")))
    cut = F.concat(F.regexp_replace(F.substring(text, 1, limit), r"(?U)\s+$", ""), F.lit("\n\n[truncated]"))
    shown = F.when(F.length(text) > limit, cut).otherwise(text)
    head = F.concat(F.lit("[Doc "), doc_id.cast("string"), F.lit(" | "), F.coalesce(present(title), F.lit("Untitled")), F.lit("]\n"))
    return F.when(text == "", F.concat(F.lit("Document "), doc_id.cast("string"), F.lit(" has no OCR content."))).otherwise(F.concat(head, shown))


def render_dpi(width_in: Column, height_in: Column, max_dim: Column, dpi: int = 300) -> Column:
    """Resolution that keeps the longest side of a page within ``max_dim`` pixels."""
    longest = F.greatest(width_in, height_in) * dpi
    return F.when(max_dim.isNotNull() & (longest > max_dim), F.floor(dpi * max_dim / longest)).otherwise(F.lit(dpi)).cast("int")


def backoff(n: Column, base: int = 60, most: int = 3600) -> Column:
    """Seconds until the next try after the n-th failure."""
    return F.least(base * F.pow(F.lit(2.0), n - 1), F.lit(float(most))).cast("long")


def ai_result(timestamp: Column, model: Column, api_base: Column, version: Column, title: Column, date: Column, sender: Column, summary: Column) -> Column:
    """Result blob as JSON, nulls written out."""
    inner = F.struct(title.alias("title"), date.cast("string").alias("document_date"), sender.alias("correspondent"), summary.alias("summary"))
    return F.to_json(F.struct(timestamp.alias("timestamp"), model.alias("metadata_model"), api_base.alias("metadata_api_base"), version.alias("version"), inner.alias("ai_metadata")), {"ignoreNullFields": "false"})


def is_ai_note(c: Column | str) -> Column:
    """The note is a JSON object with a key that only the pipeline writes."""
    v = F.try_parse_json(col(c))
    keys = F.coalesce(F.json_object_keys(col(c)), F.array().cast("array<string>"))
    return v.isNotNull() & F.arrays_overlap(keys, words_in(["OCR_MODEL", "ocr_model"]))


def detail_url(base: str, doc_id: Column) -> Column:
    return F.format_string(f"{base}/documents/%d/details", doc_id.cast("long"))


def thumb_url(base: str, doc_id: Column) -> Column:
    return F.format_string(f"{base}/api/documents/%d/thumb/", doc_id.cast("long"))


def preview_url(base: str, doc_id: Column) -> Column:
    return F.format_string(f"{base}/api/documents/%d/preview/", doc_id.cast("long"))


def listed(names: Column) -> Column:
    return F.coalesce(present(F.array_join(names, ", ")), F.lit("(none)"))


def split_key(original_key: Column, path: Column) -> Column:
    """Key of a golden entry: its own, else the file's stem."""
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)
    return F.coalesce(present(original_key), stem)


def usage(prompt: Column, completion: Column, total: Column) -> Column:
    """Token usage with missing numbers as 0 and a missing total as their sum."""
    p, c = F.coalesce(prompt, F.lit(0)), F.coalesce(completion, F.lit(0))
    return F.struct(p.alias("prompt"), c.alias("completion"), F.coalesce(total, p + c).alias("total"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays in double precision, summed in order; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def sigmoid(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-c))
