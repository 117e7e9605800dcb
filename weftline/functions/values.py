"""Values as they come in files and forms: folded, parsed, normalised, rendered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import text as T


def ascii_lower(c: Column) -> Column:
    """Lower case, accents dropped, what is then not ASCII left out."""
    return F.regexp_replace(F.lower(F.translate(c, T.ACCENTED, T.PLAIN)), "[^\\x00-\\x7F]", "")


def plain_marks(c: Column) -> Column:
    """Lower case with plain apostrophes, blanks and hyphens."""
    return F.lower(F.translate(c, "’ " + T.DASHES, "' " + "-" * len(T.DASHES)))


def plain_lines(c: Column) -> Column:
    """Unix line ends, no blanks around lines, at most one empty line in a row, none at the ends."""
    c = F.regexp_replace(F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "[ \\t]*\\n[ \\t]*", "\n")
    return F.regexp_replace(F.regexp_replace(c, "\\n{3,}", "\n\n"), "^[ \\t\\n]+|[ \\t\\n]+$", "")


def article_number(c: Column) -> Column:
    """Without dots and white space."""
    return F.regexp_replace(c, "[.\\s]+", "")


def text_list(c: Column) -> Column:
    """array<string> of a JSON array, or else of parts between ; and , without blanks around them and empty ones."""
    parsed = F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>"))
    parts = F.transform(F.coalesce(parsed, F.split(c, "[;,]\\s*"), F.array().cast("array<string>")), lambda x: F.trim(x))
    return F.filter(parts, lambda x: F.coalesce(x, F.lit("")) != "")


def unique_union(*lists: Column) -> Column:
    """The lists one after the other, each value once, where it came first; no blank ones."""
    return F.array_distinct(F.filter(F.transform(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]), lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != ""))


def merged_gold(curated: Column, resolved: Column, labels: Column) -> Column:
    """curated and resolved ids; if any of them is no raw label, raw labels that the curated list brought are left out."""
    keys, curated_keys = F.transform(labels, T.match_key), F.transform(curated, T.match_key)
    union = unique_union(curated, resolved)
    is_label = lambda x: F.array_contains(keys, T.match_key(x))
    kept = F.filter(union, lambda x: ~is_label(x) | ~F.array_contains(curated_keys, T.match_key(x)))
    return F.when(F.exists(union, lambda x: ~is_label(x)), kept).otherwise(union)


def source_labels(c: Column, start: str) -> Column:
    """Labels of a free text field: cut at line breaks, at ' ; ', at tabs and before each match of ``start`` (a pattern)."""
    joined = F.regexp_replace(F.trim(c), "[\\r\\n]+", " ; ")
    parts = F.flatten(F.transform(F.split(joined, "\\s+;\\s+|\\t+"), lambda p: F.split(p, f"(?={start})")))
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.regexp_replace(p, "^[ ;]+|[ ;]+$", "")), lambda p: p != ""))


def finite(c: Column) -> Column:
    """A finite double of a string or number, else null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def ratio(c: Column) -> Column:
    """A finite number from 0 to 1, else null."""
    return F.when(finite(c).between(0, 1), finite(c))


#: Forms of a date, tried in this order.
DATE_FORMS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyyMMdd")


def any_date(c: Column) -> Column:
    """The date of a string in any of DATE_FORMS; else of its first yyyy-MM or MM/yyyy, the first of that month."""
    whole = F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(form)).cast("date") for form in DATE_FORMS])
    month = F.coalesce(F.try_to_timestamp(F.regexp_extract(c, "(\\d{4}-\\d{2})", 1), F.lit("yyyy-MM")), F.try_to_timestamp(F.regexp_extract(c, "(\\d{2}/\\d{4})", 1), F.lit("MM/yyyy")))
    return F.coalesce(whole, month.cast("date"))


def month_label(c: Column) -> Column:
    """MM/yy, '' without a date."""
    return F.coalesce(F.date_format(any_date(c), "MM/yy"), F.lit(""))


def local_label(ts: Column, zone: str = "Europe/Paris") -> Column:
    """dd/MM/yyyy HH:mm of a UTC time in a zone."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "dd/MM/yyyy HH:mm")


def iso_date(c: Column) -> Column:
    """yyyy-MM-dd of milliseconds since 1970 (digits only) or of an ISO date or time; else null."""
    millis = F.when(c.rlike("^-?\\d{9,}$"), F.date_format(F.timestamp_millis(c.try_cast("long")), "yyyy-MM-dd"))
    return F.coalesce(millis, F.date_format(F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")), "yyyy-MM-dd"))


def satisfaction(stars: Column, helpful: Column) -> Column:
    return F.when(stars.isNotNull(), F.when(stars >= 3, "Satisfied").otherwise("Dissatisfied")).when(helpful.isNotNull(), F.when(helpful, "Satisfied").otherwise("Dissatisfied")).otherwise("Unknown")


def star_label(stars: Column) -> Column:
    """One star a step, from 0 to 4; '' without any."""
    return F.when(stars.between(0, 4), F.repeat(F.lit("★"), stars.cast("int") + 1)).otherwise("")


def bucket(c: Column, groups: dict[str, tuple[str, ...]], other: str) -> Column:
    """The name of the group that holds the value; other for the rest and null."""
    out = F
    for name, values in groups.items():
        out = out.when(c.isin(list(values)), name)
    return out.otherwise(other)


def nullable(c: Column) -> Column:
    """Trimmed; null if blank or the word NULL."""
    return F.when(F.upper(F.trim(c)).isin("", "NULL"), None).otherwise(F.trim(c))


def article_url(article_id: Column, category: Column, root: Column) -> Column:
    """The address of an article below root: codes on one route, all else on another."""
    return F.concat(root, F.lit("/"), F.when(F.upper(category) == "CODE", "codes").otherwise("loda"), F.lit("/article_lc/"), article_id)


LINK = "array<struct<id:string,cid:string,text:string,linkType:string,typeLien:string,title:string>>"


def links(c: Column, dropped: str = "TXT_SOURCE") -> Column:
    """A JSON array of links as structs of id, kind, title: alias keys resolved, ``dropped`` kinds left out, null if none stay."""
    rows = F.transform(F.from_json(c, LINK), lambda x: F.struct(F.coalesce(x["id"], x["cid"]).alias("id"), F.coalesce(x["linkType"], x["typeLien"]).alias("kind"), F.coalesce(x["title"], x["text"]).alias("title")))
    kept = F.filter(rows, lambda x: F.coalesce(x["kind"], F.lit("")) != dropped)
    return F.when(F.size(kept) > 0, kept)


def render(template: Column, values: dict[str, Column]) -> Column:
    """{name} replaced by each value, null as ''."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def fingerprint(fields: dict[str, Column], digits: int = 64) -> Column:
    """SHA-256 of the fields as JSON with sorted keys; null fields are written."""
    whole = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(whole, 256), 1, digits)


def hides_sources(answer: Column, starts: list[str], inside: list[str], short: int = 150) -> Column:
    """True for no answer, for one that begins as ``starts`` say, and for a short one with a phrase of ``inside``."""
    low = F.lower(F.trim(answer))
    begins, has = F.lit(False), F.lit(False)
    for s in starts:
        begins = begins | low.startswith(s)
    for s in inside:
        has = has | low.contains(s)
    return F.coalesce(answer == "", F.lit(True)) | begins | ((F.length(answer) < short) & has)


def signalled(folded: Column, hints: list[str], rule: str, topics: list[tuple[str, bool]]) -> Column:
    """A hint matches; or the rule does with a topic of high signal (True) or two of any. Words (\\b, \\w) are of ASCII."""
    has = lambda pattern: folded.rlike(T.ascii_bounds(pattern))
    hit = F.lit(False)
    for h in hints:
        hit = hit | has(h)
    score = sum((F.when(has(p), 2 if high else 1).otherwise(0) for p, high in topics), F.lit(0))
    return hit | (has(rule) & (score >= 2))


def cascade(cases: list[tuple[Column, str]], other: str) -> Column:
    """The name of the first case that holds."""
    out = F
    for when, name in cases:
        out = out.when(F.coalesce(when, F.lit(False)), name)
    return out.otherwise(other)


def natural_key(c: Column) -> tuple[Column, Column]:
    """Sort keys: the leading whole number (texts without one last), then the text."""
    return F.coalesce(F.regexp_extract(c, "^(\\d+)", 1).try_cast("decimal(38,0)"), F.expr("cast('1e37' as decimal(38,0))")), c


def last_heading(path: Column) -> Column:
    """What follows the last '>' of a heading path."""
    return F.trim(F.regexp_replace(path, "^.*>\\s*", ""))


def period(mode: str, start=None, end=None, last=None, today=None):
    """(from, to) dates of a period: 'all' has no bounds, 'month' is the calendar month before today, 'window' is start to end,
    'custom' too, but keeps the last applied period while it is incomplete or turned round."""
    import datetime

    if mode == "all":
        return None, None
    if mode == "month":
        first = (today or datetime.date.today()).replace(day=1)
        end = first - datetime.timedelta(days=1)
        return end.replace(day=1), end
    if mode == "custom" and (start is None or end is None or start > end):
        return last if last is not None else (None, None)
    if mode in ("custom", "window"):
        return start, end
    raise ValueError(f"unknown period {mode!r}")


def in_period(c: Column, bounds: tuple) -> Column:
    """Inclusive; a missing bound is none."""
    out = F.lit(True)
    if bounds[0] is not None:
        out = out & (c.cast("date") >= F.lit(bounds[0]))
    if bounds[1] is not None:
        out = out & (c.cast("date") <= F.lit(bounds[1]))
    return out
