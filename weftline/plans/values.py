"""Queries over value functions: folding, lists, numbers, dates, labels, links, rules on texts."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import values as V
from weftline.plans.common import Tables, query

_ACC = f"'{T.ACCENTED}', '{T.PLAIN}'"
_DASH = f"'’ {T.DASHES}', '\\' {'-' * len(T.DASHES)}'".replace("\\'", "''")


@query(rf"""SELECT doc_id, md5(regexp_replace(lower(translate(text, {_ACC})), '[^\x00-\x7F]', '', 'g')) AS ascii, md5(lower(translate(text, {_DASH}))) AS marks,
md5(regexp_replace(regexp_replace(regexp_replace(replace(replace(text || chr(13) || chr(10) || ' ', chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]*\n[ \t]*', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \t\n]+|[ \t\n]+$', '', 'g')) AS lines FROM documents""")
def text_normals(t: Tables) -> DataFrame:
    text = F.col("text")
    return t.documents.select("doc_id", F.md5(V.ascii_lower(text)).alias("ascii"), F.md5(V.plain_marks(text)).alias("marks"), F.md5(V.plain_lines(F.concat(text, F.lit("\r\n ")))).alias("lines"))


@query(r"""WITH x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '["' || source || '", "' || lang || ' ", ""]' WHEN 1 THEN ' ' || source || '; ' || lang || ',' || source || ';;' END AS raw, source, lang FROM documents)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source || '|' || lang WHEN 1 THEN source || '|' || lang || '|' || source ELSE '' END AS parts, CASE doc_id % 3 WHEN 0 THEN source || '|' || lang || '|x' WHEN 1 THEN source || '|' || lang || '|x' ELSE 'x|' || lang END AS merged,
CASE doc_id % 3 WHEN 2 THEN '' ELSE source || '|new' END AS tags FROM x""")
def list_values(t: Tables) -> DataFrame:
    i, s, lang = F.col("doc_id"), F.col("source"), F.col("lang")
    raw = F.when(i % 3 == 0, F.concat(F.lit('["'), s, F.lit('", "'), lang, F.lit(' ", ""]'))).when(i % 3 == 1, F.concat(F.lit(" "), s, F.lit("; "), lang, F.lit(","), s, F.lit(";;")))
    rows = t.documents.select(i, s, lang, V.text_list(raw).alias("parts"))
    added = F.when(F.size("parts") > 0, F.array_except(F.array_union("parts", F.array(F.lit("new"))), F.array(lang))).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", F.array_join("parts", "|").alias("parts"), F.array_join(V.unique_union(F.col("parts"), F.array(F.lit("x"), F.lit(" "), lang)), "|").alias("merged"), F.array_join(added, "|").alias("tags"))


@query("""WITH x AS (SELECT doc_id, ['F' || doc_id % 4, 'Art. ' || doc_id % 3] AS labels, CASE WHEN doc_id % 5 = 0 THEN ['F' || doc_id % 4, 'id' || doc_id] ELSE ['f ' || doc_id % 4] END AS curated, CASE WHEN doc_id % 2 = 0 THEN ['doc' || doc_id, 'ART.' || doc_id % 3] ELSE ['Art. ' || doc_id % 3] END AS resolved FROM documents)
SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR doc_id % 2 = 0 THEN array_to_string(list_concat(CASE WHEN doc_id % 5 = 0 THEN ['id' || doc_id] ELSE [] END, resolved), '|') ELSE array_to_string(list_concat(curated, resolved), '|') END AS gold FROM x""")
def gold_union(t: Tables) -> DataFrame:
    n = lambda k: (F.col("doc_id") % k).cast("string")
    text = lambda a, b: F.concat(F.lit(a), b)
    own = F.col("doc_id").cast("string")
    curated = F.when(F.col("doc_id") % 5 == 0, F.array(text("F", n(4)), text("id", own))).otherwise(F.array(text("f ", n(4))))
    resolved = F.when(F.col("doc_id") % 2 == 0, F.array(text("doc", own), text("ART.", n(3)))).otherwise(F.array(text("Art. ", n(3))))
    return t.documents.select("doc_id", F.array_join(V.merged_gold(curated, resolved, F.array(text("F", n(4)), text("Art. ", n(3)))), "|").alias("gold"))


@query("""SELECT doc_id, 'Fiche A ' || source || '|' || 'Article L' || doc_id || '|code ' || lang AS labels FROM documents""")
def label_split(t: Tables) -> DataFrame:
    raw = F.concat(F.lit(" Fiche A "), "source", F.lit(" ;\nArticle L"), F.col("doc_id").cast("string"), F.lit("\tcode "), "lang", F.lit(" ; Fiche A "), "source")
    return t.documents.select("doc_id", F.array_join(V.source_labels(raw, "(?:Article|Fiche) [A-Z]"), "|").alias("labels"))


@query("""WITH x AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'NaN' WHEN 1 THEN 'x' || value WHEN 2 THEN '' ELSE CAST(value / 100 AS VARCHAR) END AS raw FROM events), y AS (SELECT event_id, try_cast(raw AS DOUBLE) AS v FROM x)
SELECT event_id, CASE WHEN NOT isnan(v) THEN v END AS number, CASE WHEN v BETWEEN 0 AND 1 THEN v END AS ratio FROM y""")
def safe_numbers(t: Tables) -> DataFrame:
    k = F.col("event_id") % 5
    raw = F.when(k == 0, "NaN").when(k == 1, F.concat(F.lit("x"), F.col("value").cast("string"))).when(k == 2, "").otherwise((F.col("value") / 100).cast("string"))
    return t.events.select("event_id", V.finite(raw).alias("number"), V.ratio(raw).alias("ratio"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 7 THEN '' ELSE strftime(o_orderdate, '%m/%y') END AS label, CASE WHEN o_orderkey % 8 IN (0, 1, 2) THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 8 = 6 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso,
strftime(o_orderdate + INTERVAL (o_orderkey % 86400) SECOND + INTERVAL 9 HOUR, '%d/%m/%Y %H:%M') AS local FROM orders""")
def date_labels(t: Tables) -> DataFrame:
    d, k = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 8
    form = lambda p: F.date_format(d, p)
    raw = F.when(k == 0, form("yyyy-MM-dd")).when(k == 1, form("yyyy-MM-dd'T'HH:mm:ss")).when(k == 2, form("yyyy-MM-dd HH:mm:ss")).when(k == 3, form("dd/MM/yyyy")).when(k == 4, form("dd-MM-yyyy")).when(k == 5, form("yyyyMMdd")).when(k == 6, F.concat(F.lit("since "), form("yyyy-MM"))).otherwise("no date")
    iso = F.when(k == 6, F.unix_millis(d).cast("string")).otherwise(raw)
    later = F.timestamp_seconds(F.unix_timestamp(d) + F.col("o_orderkey") % 86400)
    return t.orders.select("o_orderkey", V.month_label(raw).alias("label"), V.iso_date(iso).alias("iso"), V.local_label(later, "Asia/Tokyo").alias("local"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN CASE WHEN doc_id % 5 >= 3 THEN 'Satisfied' ELSE 'Dissatisfied' END WHEN quality IS NOT NULL THEN CASE WHEN quality = 1 THEN 'Satisfied' ELSE 'Dissatisfied' END ELSE 'Unknown' END AS satisfaction,
CASE WHEN doc_id % 3 > 0 THEN repeat('★', CAST(doc_id % 5 + 1 AS INT)) ELSE '' END AS stars, CASE WHEN toxic = 1 THEN 'safety' WHEN quality = 0 THEN 'content' ELSE 'other' END AS issue, CASE WHEN doc_id % 4 IN (1, 3) THEN NULL ELSE 'x' || doc_id END AS cleaned FROM labels""")
def feedback_labels(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    stars = F.when(i % 3 > 0, i % 5)
    issue = F.when(F.col("toxic") == 1, "insult").when(F.col("quality") == 0, "wrong").otherwise("late")
    raw = F.when(i % 4 == 1, " null ").when(i % 4 == 3, " ").otherwise(F.concat(F.lit(" x"), i.cast("string")))
    return t.labels.select("doc_id", V.satisfaction(stars, F.col("quality") == 1).alias("satisfaction"), V.star_label(stars).alias("stars"), V.bucket(issue, {"safety": ("insult",), "content": ("wrong", "missing")}, "other").alias("issue"), V.nullable(raw).alias("cleaned"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'c' || page_id || ':CITE:' || page_id % 7 END AS links, CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1 END AS n_links,
'https://law.example/' || CASE WHEN page_id % 2 = 0 THEN 'codes' ELSE 'loda' END || '/article_lc/A' || page_id AS url, 'Dear ' || page_id || ', see  and {other}.' AS prompt FROM pages""")
def page_references(t: Tables) -> DataFrame:
    i = F.col("page_id").cast("string")
    drop = F.lit('{"id":"s","linkType":"TXT_SOURCE"}')
    keep = F.concat(F.lit('{"cid":"c'), i, F.lit('","typeLien":"CITE","text":"'), (F.col("page_id") % 7).cast("string"), F.lit('"}'))
    raw = F.concat(F.lit("["), drop, F.when(F.col("page_id") % 3 > 0, F.concat(F.lit(","), keep)).otherwise(""), F.lit("]"))
    found = V.links(raw)
    said = F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["id"], x["kind"], x["title"])), "|")
    url = V.article_url(F.concat(F.lit("A"), i), F.when(F.col("page_id") % 2 == 0, "code").otherwise("DECRET"), F.lit("https://law.example"))
    prompt = V.render(F.lit("Dear {name}, see {what} and {other}."), {"name": F.col("page_id"), "what": F.lit(None)})
    return t.pages.select("page_id", said.alias("links"), F.coalesce(F.size(found), F.lit(0)).alias("n_links"), url.alias("url"), prompt.alias("prompt"))


@query("""SELECT p_partkey, sha256('{"brand":"' || p_brand || '","model":' || CASE WHEN p_partkey % 2 = 0 THEN 'null' ELSE '"' || p_type || '"' END || ',"size":' || p_size || '}') AS whole,
substr(sha256('{"size":' || p_size || '}'), 1, 16) AS short FROM part""")
def config_fingerprint(t: Tables) -> DataFrame:
    fields = {"size": F.col("p_size"), "brand": F.col("p_brand"), "model": F.when(F.col("p_partkey") % 2 == 1, F.col("p_type"))}
    return t.part.select("p_partkey", V.fingerprint(fields).alias("whole"), V.fingerprint({"size": F.col("p_size")}, 16).alias("short"))


_HINTS, _RULE, _TOPICS = [r"\bthe ed\w*", r"\bof the\b"], r"\b(?:and|der|de)\b", [(r"\bin\b", False), (r"\bon\w*", False), (r"\bgeheit\w*", True)]


@query(rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lower(translate(coalesce(text, ''), {_ACC})) AS f FROM documents), s AS (SELECT *, CAST(regexp_matches(f, '\bin\b') AS INT) + CAST(regexp_matches(f, '\bon\w*') AS INT) + 2 * CAST(regexp_matches(f, '\bgeheit\w*') AS INT) AS score FROM d)
SELECT doc_id, regexp_matches(f, '\bthe ed\w*') OR regexp_matches(f, '\bof the\b') OR (regexp_matches(f, '\b(?:and|der|de)\b') AND score >= 2) AS legal,
text = '' OR starts_with(lower(trim(text, ' ')), 'the') OR (length(text) < 150 AND contains(lower(text), 'an')) AS hidden, CASE WHEN contains(f, 'geheit') THEN 'law' WHEN contains(f, 'the') THEN 'guide' ELSE 'document' END AS class FROM s""")
def text_rules(t: Tables) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = t.documents.select("doc_id", text.alias("text"), T.lower(F.translate(text, T.ACCENTED, T.PLAIN)).alias("f"))
    f = F.col("f")
    return rows.select("doc_id", V.signalled(f, _HINTS, _RULE, _TOPICS).alias("legal"), V.hides_sources(F.col("text"), ["the"], ["an"]).alias("hidden"), V.cascade([(f.contains("geheit"), "law"), (f.contains("the"), "guide")], "document").alias("class"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND (o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) OR o_orderstatus = 'F')""")
def scope_filter(t: Tables) -> DataFrame:
    bounds = V.period("custom", datetime.date(1997, 1, 1), datetime.date(1997, 12, 31))
    asked = t.customer.filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("asked"))
    inside = t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & V.in_period(F.col("o_orderdate"), bounds))
    return inside.join(asked, "o_custkey", "left").filter(F.coalesce("asked", F.lit(False)) | (F.col("o_orderstatus") == "F")).select("o_orderkey")


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-02-01' AND o_orderdate < TIMESTAMP '1997-03-01'""")
def previous_month(t: Tables) -> DataFrame:
    return t.orders.filter(V.in_period(F.col("o_orderdate"), V.period("month", today=datetime.date(1997, 3, 15)))).select("o_orderkey")


@query("""WITH x AS (SELECT doc_id, list_filter([lang, CASE WHEN doc_id % 2 = 0 THEN 'even' END, CASE WHEN doc_id % 3 = 0 THEN 'third' END], lambda v: v IS NOT NULL) AS tags, text FROM documents)
SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place FROM x WHERE list_has_all(tags, ['even', 'third']) AND list_has_any(tags, ['en', 'de']) AND trim(coalesce(text, '')) <> '' ORDER BY doc_id LIMIT 50""")
def tag_filter(t: Tables) -> DataFrame:
    """The first 50 by id (a top-k report) of documents with all of one set of tags and any of another."""
    tags = F.array_compact(F.array("lang", F.when(F.col("doc_id") % 2 == 0, "even"), F.when(F.col("doc_id") % 3 == 0, "third")))
    kept = t.documents.withColumn("tags", tags).filter(F.forall(F.array(F.lit("even"), F.lit("third")), lambda x: F.array_contains("tags", x)) & F.arrays_overlap("tags", F.array(F.lit("en"), F.lit("de"))) & ~T.is_blank(F.col("text")))
    first = kept.select("doc_id").orderBy("doc_id").limit(50).agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))  # 50 ids at most
    return first.select(F.posexplode("ids").alias("place", "doc_id")).select("doc_id", (F.col("place") + 1).cast("long").alias("place"))


@query("""SELECT s_suppkey, s_name FROM supplier WHERE upper(trim(s_name)) IN (SELECT upper(trim(s_name)) FROM supplier WHERE s_nationkey < 5)""")
def key_filter(t: Tables) -> DataFrame:
    key = F.upper(F.trim("s_name"))
    asked = t.supplier.filter("s_nationkey < 5").select(F.concat(F.lit(" "), F.lower("s_name")).alias("s_name")).select(key.alias("k")).distinct()
    return t.supplier.withColumn("k", key).join(asked, "k", "left_semi").select("s_suppkey", "s_name")


@query(r"""WITH k AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'x' || s_suppkey % 9 ELSE (s_suppkey * 7) % 13 || ' Rue ' || s_nationkey END AS label FROM supplier)
SELECT s_suppkey, label, row_number() OVER (ORDER BY coalesce(TRY_CAST(nullif(regexp_extract(label, '^(\d+)', 1), '') AS DOUBLE), 1e37), label, s_suppkey) AS place FROM k""")
def natural_order(t: Tables) -> DataFrame:
    """Places of a directory in natural order, by range partitions: counts of each before it, then places within."""
    from weftline.operators import ranking

    n = lambda k: k.cast("string")
    label = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("x"), n(F.col("s_suppkey") % 9))).otherwise(F.concat(n(F.col("s_suppkey") * 7 % 13), F.lit(" Rue "), n(F.col("s_nationkey"))))
    rows = t.supplier.select("s_suppkey", label.alias("label"))
    number, text = V.natural_key(F.col("label"))
    return ranking.places(rows.select("*", number.alias("n")), ["n", "label", "s_suppkey"], "place").drop("n")
