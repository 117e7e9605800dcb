"""Queries over legal references in texts: extraction, parsing, links, matching, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import refs as R
from weftline.operators import citations, context, ranking
from weftline.plans.common import ORACLES, Tables, query
from weftline.plans.retrieval import context_pack

HOST = "law.example.org"
#: Labels of sources by category of reference.
SOURCES = {"CODE": "codes", "DECRET": "decrees", "ANNEXE": "guides", "FICHE": "guides"}


def _text() -> Column:
    """Whole texts with references put in at both ends: the tables' prose has none."""
    i = F.col("doc_id")
    n = lambda c: c.cast("string")
    return F.concat(
        F.lit("Voir Art. L. "), n(100 + i % 90), F.lit("-2 2° a), L"), n(100 + i % 90), F.lit("-2 2° a) et R. 123-"), n(i % 5), F.lit(" 1°; D"), n(300 + i % 7), F.lit("-1. "), F.coalesce("text", F.lit("")), F.lit(" Article 34 du décret n° 86-"), n(i % 11),
        F.lit(" du 17 janvier 1986, DÉCRET n°2020-1; III de l'article 2 du décret 2019-"), n(i % 13), F.lit(" annexe "), n(i % 3), F.lit(". Fiche 8 [Le code]("), F.lit(f"https://{HOST}/c/"), n(i % 4), F.lit(") [Le code](https://other.example/x)"),
    )


_TEXT = f"""'Voir Art. L. ' || (100 + doc_id % 90) || '-2 2° a), L' || (100 + doc_id % 90) || '-2 2° a) et R. 123-' || (doc_id % 5) || ' 1°; D' || (300 + doc_id % 7) || '-1. ' || coalesce(text, '') || ' Article 34 du décret n° 86-' || (doc_id % 11)
 || ' du 17 janvier 1986, DÉCRET n°2020-1; III de l''article 2 du décret 2019-' || (doc_id % 13) || ' annexe ' || (doc_id % 3) || '. Fiche 8 [Le code](https://{HOST}/c/' || (doc_id % 4) || ') [Le code](https://other.example/x)'"""
_FORMS = " UNION ALL ".join(f"SELECT doc_id, {i} AS form, unnest(regexp_extract_all(t, '(?i){form.replace(chr(39), chr(39) * 2)}')) AS ref, unnest(range(1, len(regexp_extract_all(t, '(?i){form.replace(chr(39), chr(39) * 2)}')) + 1)) AS pos FROM d" for i, form in enumerate(R.KINDS.values()))
_LINK = R.link_form(HOST)
_REFS = f"""d AS (SELECT doc_id, {_TEXT} AS t FROM documents), f AS ({_FORMS} UNION ALL SELECT doc_id, 99, unnest(regexp_extract_all(t, '(?i){_LINK}', 1)), unnest(range(1, len(regexp_extract_all(t, '(?i){_LINK}', 1)) + 1)) FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, replace(replace(lower(trim(ref)), ' ', ''), '.', '') ORDER BY form, pos) AS n FROM f), refs AS (SELECT doc_id, trim(ref) AS ref, row_number() OVER (PARTITION BY doc_id ORDER BY form, pos) AS place FROM k WHERE n = 1)"""


def _references(t: Tables) -> DataFrame:
    return citations.references(t.documents.select("doc_id", _text().alias("text")), HOST)


def _parsed(ref: str = "ref") -> list[Column]:
    p = R.parsed(F.col(ref))
    return [R.source_of(p["category"], SOURCES).alias("source"), p["category"].alias("category"), p["number"].alias("number"), p["paragraph"].alias("paragraph"), p["decree"].alias("decree")]


@query(f"WITH {_REFS} SELECT doc_id, ref, place FROM refs")
def legal_references(t: Tables) -> DataFrame:
    return _references(t)


_PARSED = rf"""{_REFS}, p AS (SELECT ref, CASE WHEN regexp_matches(ref, '(?i)^article\s+\d+\s+du\s+décret') THEN ['decrees', 'DECRET', '34', NULL, regexp_extract(ref, '(\d{{2,4}}-\d+)', 1)] WHEN regexp_matches(ref, '(?i)^III\s+de') THEN ['decrees', 'DECRET', '2', 'III', regexp_extract(ref, '(\d{{4}}-\d+)', 1)]
 WHEN regexp_matches(ref, '(?i)^décret') THEN ['decrees', 'DECRET', NULL, NULL, regexp_extract(ref, '(\d{{2,4}}-\d+)', 1)] WHEN regexp_matches(ref, '(?i)^(art\.?\s*)?l\.?\s*\d{{3}}-') THEN ['codes', 'CODE', 'L' || regexp_extract(ref, '(\d{{3}}-\d+)', 1), nullif(regexp_extract(ref, '(\d+°( [a-z]\))?)', 1), ''), NULL]
 WHEN regexp_matches(ref, '(?i)^[rd]\.?\s*\d{{3}}-') THEN ['codes', 'CODE', upper(ref[1]) || regexp_extract(ref, '(\d{{3}}-\d+)', 1), nullif(regexp_extract(ref, '(\d+°)', 1), ''), NULL] WHEN regexp_matches(ref, '(?i)^annexe') THEN ['guides', 'ANNEXE', 'A' || regexp_extract(ref, '(\d+)', 1), NULL, NULL] WHEN regexp_matches(ref, '(?i)^fiche') THEN ['guides', 'FICHE', 'F' || regexp_extract(ref, '(\d+)', 1), NULL, NULL]
 ELSE ['UNKNOWN', 'OTHER', ref, NULL, NULL] END AS p FROM (SELECT DISTINCT ref FROM refs))"""


@query(f"WITH {_PARSED} SELECT ref, p[1] AS source, p[2] AS category, p[3] AS number, p[4] AS paragraph, p[5] AS decree FROM p")
def parsed_references(t: Tables) -> DataFrame:
    return _references(t).select("ref").distinct().select("ref", *_parsed())


@query(f"WITH {_PARSED} SELECT p[1] AS source, p[2] AS category, count(*) AS n, count(*) FILTER (p[3] IN (SELECT 'L' || (100 + s_suppkey) || '-2' FROM supplier)) AS resolved FROM refs JOIN p USING (ref) GROUP BY 1, 2")
def reference_summary(t: Tables) -> DataFrame:
    """Counts of references by source and category, and of those whose number is known."""
    known = t.supplier.select(F.concat(F.lit("L"), (100 + F.col("s_suppkey")).cast("string"), F.lit("-2")).alias("number"), F.lit(1).alias("known"))
    each = _references(t).groupBy("ref").agg(F.count("*").alias("n")).select("n", *_parsed())
    counts = each.join(known, "number", "left").groupBy("source", "category")
    return counts.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("known") == 1, F.col("n"))), F.lit(0)).alias("resolved"))


@query(f"WITH d AS (SELECT doc_id, {_TEXT} AS t FROM documents) SELECT doc_id, 'Le code' AS title, regexp_extract(t, '{_LINK}', 2) AS url FROM d")
def reference_links(t: Tables) -> DataFrame:
    return citations.links(t.documents.select("doc_id", _text().alias("text")), HOST)


def known_references(refs: DataFrame) -> DataFrame:
    """number, cid, id of refs: the least id of each pair, so that a mention meets no more rows than its number has cids."""
    return refs.groupBy("number", "cid").agg(F.min("id").alias("id"))


@query(f"""WITH {_REFS}, r AS (SELECT s_suppkey AS id, 'L. ' || (100 + s_suppkey % 6) || ' -2' AS number, CASE WHEN s_suppkey % 4 > 0 THEN 'C' || s_suppkey % 3 END AS cid FROM supplier), n AS (SELECT *, replace(replace(number, ' ', ''), '.', '') AS k FROM r WHERE cid IS NOT NULL),
m AS (SELECT DISTINCT doc_id, 'L' || (100 + doc_id % 90) || '-2' AS k FROM documents), a AS (SELECT doc_id, cid, arg_min(k, id) AS number FROM m JOIN n USING (k) GROUP BY ALL), x AS (SELECT doc_id, false AS is_decree, number, cid FROM a UNION ALL SELECT DISTINCT doc_id, true, '2020-1', 'DECREE-2020-1' FROM documents)
SELECT doc_id, is_decree, number, cid, row_number() OVER (PARTITION BY doc_id ORDER BY is_decree, number, cid) AS place FROM x""")
def matched_references(t: Tables) -> DataFrame:
    """References served with an answer that it mentions: each id once, known decrees last."""
    from weftline.operators.fusion import ranked

    said = t.documents.select("doc_id", _text().alias("t"))
    refs = t.supplier.select(F.col("s_suppkey").alias("id"), F.regexp_replace(F.concat(F.lit("L. "), (100 + F.col("s_suppkey") % 6).cast("string"), F.lit(" -2")), "[ .]", "").alias("number"), F.when(F.col("s_suppkey") % 4 > 0, F.concat(F.lit("C"), (F.col("s_suppkey") % 3).cast("string"))).alias("cid")).filter("cid is not null")
    mentions = said.select("doc_id", F.explode(R.article_mentions(F.regexp_replace("t", "([LRD])\\. ", "$1"))).alias("number"))
    articles = ranking.first_by(mentions.join(known_references(refs), "number"), ["doc_id", "cid"], [F.col("id")]).select("doc_id", F.lit(False).alias("is_decree"), "number", "cid")
    decrees = said.select("doc_id", F.explode(R.decree_mentions(F.lower("t"))).alias("number")).filter("number = '2020-1'")
    both = articles.unionByName(decrees.select("doc_id", F.lit(True).alias("is_decree"), "number", F.concat(F.lit("DECREE-"), "number").alias("cid")))
    return ranked(both, ["doc_id"], [F.col("is_decree"), F.col("number"), F.col("cid")]).withColumnRenamed("rank", "place")


@query(f"""WITH RECURSIVE cp AS ({ORACLES["context_pack"]}), {_REFS}, rt AS (SELECT doc_id AS id, CAST(sum(length(ref) + 3) // 4 AS BIGINT) AS tokens FROM refs GROUP BY doc_id),
o AS (SELECT query_id, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS pos, added FROM cp), s AS (SELECT query_id, id, tokens, row_number() OVER (PARTITION BY query_id ORDER BY list_contains(added, id), pos) AS r FROM o JOIN rt USING (id)),
g AS (SELECT query_id, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS used, CAST([] AS BIGINT[]) AS ids FROM cp UNION ALL SELECT s.query_id, s.r, CASE WHEN used + tokens <= 150 THEN used + tokens ELSE used END, CASE WHEN used + tokens <= 150 THEN list_append(ids, s.id) ELSE ids END FROM g JOIN s ON s.query_id = g.query_id AND s.r = g.r + 1),
e AS (SELECT query_id, arg_max(ids, r) AS with_refs, arg_max(used, r) AS refs_used FROM g GROUP BY query_id)
SELECT query_id, ids, cp.used + refs_used AS used, whole, added, with_refs, refs_used FROM cp JOIN e USING (query_id)""")
def context_pack_refs(t: Tables) -> DataFrame:
    """Packed contexts with the legal references of their sections, under a budget of 150 tokens for these."""
    tokens = _references(t).groupBy(F.col("doc_id").alias("id")).agg(F.floor(F.sum(F.length("ref") + 3) / 4).cast("long").alias("tokens"))
    return context.inject_references(context_pack(t), tokens, 150)
