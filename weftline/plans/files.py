"""Queries over file sources, on payloads made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import tables as TB
from weftline.plans.common import Tables, query
from weftline.sources import files as S


@query("SELECT 'f' || l_orderkey AS file, CASE WHEN bool_or(l_linenumber % 7 = 6) THEN 0 ELSE count(*) END AS n_chunks FROM lineitem GROUP BY l_orderkey")
def valid_chunks(t: Tables) -> DataFrame:
    n = F.col("l_linenumber")
    line = F.when(n % 7 == 6, F.when(n % 2 == 0, "[1]").otherwise("{}")).otherwise(F.to_json(F.struct("l_partkey", "l_suppkey")))
    lines = t.lineitem.select(F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("file"), line.alias("value"))
    blank = t.orders.join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_semi").select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("file"), F.lit("  ").alias("value"))
    return S.valid_chunks(lines.unionByName(blank))


@query("""SELECT p_partkey AS payload_id, 'V' || p_partkey AS version_id, CASE WHEN p_partkey % 3 = 0 THEN 'V' || p_partkey ELSE 'C' || p_partkey % 40 END AS cid, 'N' || p_size AS number, 'VIGUEUR' AS state, '2020-01-01' AS start, CAST(NULL AS VARCHAR) AS "end", 'CODE' AS nature, p_name || ' &' AS body,
CASE WHEN p_partkey % 2 = 0 THEN 'new ' || p_brand ELSE 'code ' || p_brand END AS title, 'c' || p_partkey AS concordances, '' AS modifications, 'a|b' AS citations FROM part""")
def xml_articles(t: Tables) -> DataFrame:
    k, s = F.col("p_partkey"), lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    ids = s("<META><META_COMMUN><ID>V", k, "</ID></META_COMMUN><META_SPEC><META_ARTICLE>", F.when(k % 3 > 0, s("<CID>C", k % 40, "</CID>")).otherwise(""), "<NUM>N", F.col("p_size"), "</NUM><DATE_DEBUT>2020-01-01</DATE_DEBUT></META_ARTICLE></META_SPEC></META>")
    titles = s('<TITRE_TXT id_txt="X1" debut="2019-01-01" fin="', F.when(k % 2 == 0, "2019-12-31").otherwise("2021-01-01"), '">old ', F.col("p_brand"), '</TITRE_TXT><TITRE_TXT id_txt="', F.when(k % 2 == 0, "X2").otherwise("LEGITEXT3"), '" debut="2019-06-01" fin="2999-01-01">', F.when(k % 2 == 0, "new ").otherwise("code "), F.col("p_brand"), "</TITRE_TXT>")
    links = s('<LIENS><LIEN id="a" typelien="CITATION">x</LIEN><LIEN id="c', k, '" typelien="CONCORDANCE">y</LIEN><LIEN id="b" typelien="CITE">z</LIEN></LIENS>')
    xml = s("<ARTICLE>", ids, '<CONTEXTE><TEXTE nature="code">', titles, "</TEXTE></CONTEXTE><BLOC_TEXTUEL><CONTENU> ", F.col("p_name"), "\n &amp; </CONTENU></BLOC_TEXTUEL>", links, "</ARTICLE>")
    rows = S.articles(t.part.select(k.alias("payload_id"), xml.alias("xml")))
    joined = {c: F.array_join(c, "|").alias(c) for c in ("concordances", "modifications", "citations")}
    return rows.select(*[joined.get(c, F.col(c)) for c in rows.columns])


@query(r"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS t FROM documents)
SELECT doc_id AS payload_id, 'V' || doc_id AS version_id, 'C' || doc_id AS cid, doc_id % 9 || '-1' AS number, CASE WHEN doc_id % 4 = 0 THEN 'ABROGE' ELSE 'VIGUEUR' END AS state, 'DECRET' AS nature, md5(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS body, 'Decret ' || lang AS title, CASE WHEN doc_id % 2 = 0 THEN 'D. ' || lang ELSE 'Decret ' || lang END AS short_title,
'Partie ' || doc_id % 3 || ' > Titre & ' || source AS subtitles, 'S' || doc_id % 5 AS section_id, 'Titre & ' || source AS section_title, CASE WHEN doc_id % 3 > 0 THEN 'M' || doc_id % 3 END AS ministry, CASE WHEN doc_id % 7 = 0 THEN 'note ' || lang END AS note, 'https://law.example/loda/article_lc/V' || doc_id AS url FROM d JOIN documents USING (doc_id)""")
def xml_article_records(t: Tables) -> DataFrame:
    """Whole texts as articles of decrees, a paragraph a line, with headings above them."""
    k, s = F.col("doc_id"), lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    escaped = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    meta = s("<META><META_COMMUN><ID>V", k, "</ID></META_COMMUN><META_SPEC><META_ARTICLE><CID>C", k, "</CID><NUM>", k % 9, "-1</NUM>", F.when(k % 4 == 0, "<ETAT>ABROGE</ETAT>").otherwise(""), "<DATE_DEBUT>2020-01-01</DATE_DEBUT></META_ARTICLE></META_SPEC></META>")
    title = s('<TITRE_TXT id_txt="T" debut="2019-01-01" fin="2999-01-01"', F.when(k % 2 == 0, s(' c_titre_court="D. ', F.col("lang"), '"')).otherwise(""), ">Decret ", F.col("lang"), "</TITRE_TXT>")
    above = s('<TM><TITRE_TM id="P">Partie ', k % 3, '</TITRE_TM><TM><TITRE_TM id="S', k % 5, '">Titre &amp; ', F.col("source"), "</TITRE_TM></TM></TM>")
    context = s('<CONTEXTE><TEXTE nature="decret"', F.when(k % 3 > 0, s(' ministere="M', k % 3, '"')).otherwise(""), ">", title, above, "</TEXTE></CONTEXTE>")
    body = s("<BLOC_TEXTUEL><CONTENU><p>", F.replace(escaped, F.lit("\n"), F.lit("</p>\n<p>")), "</p></CONTENU></BLOC_TEXTUEL>")
    note = F.when(k % 7 == 0, s("<NOTA><CONTENU><p>note</p> ", F.col("lang"), "</CONTENU></NOTA>")).otherwise("")
    rows = S.article_records(t.documents.select(k.alias("payload_id"), s("<ARTICLE>", meta, context, body, note, "</ARTICLE>").alias("xml")))
    return rows.withColumn("body", F.md5("body")).select("payload_id", "version_id", "cid", "number", "state", "nature", "body", "title", "short_title", "subtitles", "section_id", "section_title", "ministry", "note", "url")


@query("""WITH n AS (SELECT 'lake_' || CASE WHEN o_orderkey % 50 = 7 THEN 'FULL' ELSE 'delta' END || '_' || strftime(o_orderdate, '%Y%m%d') || printf('%08d', o_orderkey) || '.zip' AS name, CASE WHEN o_orderkey % 50 = 7 THEN 'full' ELSE 'delta' END AS kind, strftime(o_orderdate, '%Y%m%d') || printf('%08d', o_orderkey) AS stamp FROM orders), m AS (SELECT max(stamp) AS newest FROM n WHERE kind = 'full')
SELECT name, kind, stamp FROM n, m WHERE (kind = 'full' AND stamp = newest) OR (kind = 'delta' AND stamp > newest)""")
def archive_index(t: Tables) -> DataFrame:
    stamp = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))
    name = F.concat(F.lit("lake_"), F.when(F.col("o_orderkey") % 50 == 7, "FULL").otherwise("delta"), F.lit("_"), stamp, F.lit(".zip"))
    return S.archives_to_read(t.orders.select(name.alias("name")), "(?i)lake_(full|delta)_(\\d{16})\\.zip$")


@query("""SELECT s_suppkey, '<a/>' || CASE WHEN s_suppkey % 2 = 0 THEN '<Situation id="keep">k' || s_suppkey || '</Situation>' ELSE '' END || '<z/>' AS xml FROM supplier""")
def situation_filter(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    own = F.concat(F.lit('<Situation id="'), F.when(k % 2 == 0, "keep").otherwise("keeper"), F.lit('">k'), k.cast("string"), F.lit("</Situation>"))
    xml = F.concat(F.lit('<a/><Situation id="other">\nx</Situation>'), own, F.lit("<z/>"))
    return t.supplier.select("s_suppkey", S.situation(xml, "keep").alias("xml"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS code, event_id * 1000 AS s, CAST(trunc(value) AS BIGINT) AS d FROM events), k AS (SELECT *, substr(md5(user_id || '|' || event_id), 1, 16) AS own FROM e)
SELECT own AS span_id, '{"traceId":"' || md5(CAST(user_id AS VARCHAR)) || '","spanId":"' || own || '","parentSpanId":"' || substr(md5(user_id || '|root'), 1, 16) || '","name":"rag.' || event_type || '","kind":1,"startTimeUnixNano":"' || s || '","endTimeUnixNano":"' || (s + greatest(0, d) * 1000000) || '","attributes":[{"key":"rag.turn_id","value":{"stringValue":"' || user_id || '"}},{"key":"rag.stage","value":{"stringValue":"' || event_type || '"}}],"status":{"code":' || code || '}}' AS payload FROM k""")
def trace_spans(t: Tables) -> DataFrame:
    events = t.events.select(F.col("user_id").alias("turn_id"), F.col("event_id").alias("event_index"), F.col("event_type").alias("stage"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), (F.col("event_id") * 1000).alias("start_ns"), F.col("value").alias("duration_ms"))
    return S.spans(events)


@query(r"""WITH x AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, max(l_partkey) AS a, max(l_suppkey) AS b FROM lineitem GROUP BY 1, 2), h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM x), f AS (SELECT doc_id, first(a) AS ha, first(b) AS hb FROM h WHERE k = 1 GROUP BY doc_id)
SELECT doc_id, n, CASE WHEN k > 1 THEN ha || ': ' || a || '; ' || hb || ': ' || b || '; x: y' ELSE a || ' ' || b || ' x' END AS line FROM h JOIN f USING (doc_id)""")
def table_flatten(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n")).agg(F.max("l_partkey").alias("a"), F.max("l_suppkey").alias("b"))
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("n"))
    lines = rows.withColumn("k", k).select("doc_id", "n", F.concat(F.lit("| "), F.col("a").cast("string"), F.lit(" | "), F.col("b").cast("string"), F.when(F.col("k") == 1, " | x |").otherwise(" | y |")).alias("line"))
    return TB.flattened(lines, least_rows=1)


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Elle est ' || lang || ' depuis deux mille dix et le restera.' WHEN doc_id % 3 = 1 THEN '## Encadré : ' || lang ELSE '## ' || lang END AS line FROM documents WHERE doc_id % 4 > 0""")
def heading_refine(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 3
    line = F.when(k == 0, F.concat(F.lit("## Elle est "), "lang", F.lit(" depuis deux mille dix et le restera."))).when(k == 1, F.concat(F.lit("Encadré : "), "lang")).otherwise(F.concat(F.lit("## "), "lang"))
    folio = t.documents.select("doc_id", F.lit(0).alias("n"), F.when(F.col("doc_id") % 4 > 0, line).otherwise("- 12 -").alias("line"))
    return TB.refined(folio.withColumn("page", F.lit(1))).select("doc_id", "line")
