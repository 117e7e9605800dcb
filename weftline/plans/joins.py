"""Queries over resolving joins: enrichment, counts, cascades, unique matches, hydration, aliases, canonical rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import values as V
from weftline.operators import ranking
from weftline.operators import resolve as R
from weftline.plans.common import Tables, query


@query("""WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1)
SELECT c_custkey, c_name, o_orderstatus, o_totalprice FROM customer LEFT JOIN d ON c_custkey = o_custkey WHERE c_nationkey < 9""")
def section_documents(t: Tables) -> DataFrame:
    asked = t.customer.filter("c_nationkey < 9").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return R.enrich(asked, t.orders, "o_custkey", ["o_orderstatus", "o_totalprice"], ["o_orderdate", "o_orderkey"]).withColumnRenamed("o_custkey", "c_custkey")


@query("""WITH k AS (SELECT upper(trim(CAST(l_orderkey AS VARCHAR))) AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT o_orderkey, coalesce(n, 0) AS n_chunks FROM orders LEFT JOIN k ON CAST(o_orderkey AS VARCHAR) = k""")
def chunk_counts(t: Tables) -> DataFrame:
    lines = t.lineitem.filter("l_returnflag = 'R'").select(F.concat(F.lit(" "), F.col("l_orderkey").cast("string")).alias("id"))
    return R.with_counts(t.orders.select("o_orderkey"), lines, "o_orderkey", "id", "n_chunks")


@query("""WITH f AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS label, max(ts) AS newest FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id)
SELECT e.event_id, f.label, f.user_id IS NOT NULL AS evaluated FROM events e LEFT JOIN f USING (user_id) WHERE e.event_type = 'view'""")
def feedback_export(t: Tables) -> DataFrame:
    feedback = t.events.filter(F.col("event_type").isin("purchase", "error")).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("label"))
    joined = R.many_to_one(t.events.filter("event_type = 'view'").select("event_id", "user_id"), feedback, "user_id")
    return joined.select("event_id", "label", F.col("label").isNotNull().alias("evaluated"))


@query("""WITH s AS (SELECT p_partkey % 60 AS number, CASE WHEN p_partkey % 5 > 0 THEN 'C' || p_partkey % 90 END AS cid, p_brand AS title, p_partkey FROM part), g AS (SELECT number, cid, title, max(p_partkey) AS last FROM s WHERE cid IS NOT NULL GROUP BY ALL)
SELECT number, arg_max(cid, last) AS cid, arg_max(title, last) AS title FROM g WHERE number IN (SELECT s_suppkey FROM supplier) GROUP BY number""")
def number_resolution(t: Tables) -> DataFrame:
    i = F.col("p_partkey")
    rows = t.part.select((i % 60).alias("number"), F.when(i % 5 > 0, F.concat(F.lit("C"), (i % 90).cast("string"))).alias("cid"), F.col("p_brand").alias("title"), i).filter("cid is not null")
    asked = t.supplier.select(F.col("s_suppkey").alias("number"))
    return ranking.first_by(rows.join(asked, "number", "left_semi"), ["number"], [-i]).select("number", "cid", "title")


@query("""WITH a AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'L ' || p_partkey || '-1' WHEN 1 THEN 'D' || p_partkey || '-2' ELSE '86-' || p_partkey END AS number, 'Decree 86-' || p_partkey || ' on ' || p_type AS title FROM part),
r AS (SELECT s_suppkey AS ref_id, CASE s_suppkey % 4 WHEN 0 THEN 'L' || s_suppkey || '1' WHEN 1 THEN 'D' || s_suppkey || '-2' WHEN 2 THEN '86-' || s_suppkey ELSE 'none' END AS ref FROM supplier),
x AS (SELECT ref_id, (SELECT min(id) FROM a WHERE contains(title, ref) AND regexp_matches(ref, '^[0-9]{2,4}-[0-9]+$') AND list_contains(regexp_extract_all(title, '[0-9]{2,4}-[0-9]+'), ref)) AS v0, (SELECT min(id) FROM a WHERE number = ref) AS v1, (SELECT min(id) FROM a WHERE replace(replace(number, '-', ''), ' ', '') = replace(replace(ref, '-', ''), ' ', '')) AS v2 FROM r)
SELECT ref_id, coalesce(v0, v1, v2) AS article_id, CASE WHEN v0 IS NOT NULL THEN 0 WHEN v1 IS NOT NULL THEN 1 WHEN v2 IS NOT NULL THEN 2 END AS attempt FROM x""")
def reference_cascade(t: Tables) -> DataFrame:
    i, s = F.col("p_partkey").cast("string"), F.col("s_suppkey").cast("string")
    a, b = F.col("p_partkey") % 3, F.col("s_suppkey") % 4
    articles = t.part.select(F.col("p_partkey").alias("id"), F.when(a == 0, F.concat(F.lit("L "), i, F.lit("-1"))).when(a == 1, F.concat(F.lit("D"), i, F.lit("-2"))).otherwise(F.concat(F.lit("86-"), i)).alias("number"), F.concat(F.lit("Decree 86-"), i, F.lit(" on "), "p_type").alias("title"))
    refs = t.supplier.select(F.col("s_suppkey").alias("ref_id"), F.when(b == 0, F.concat(F.lit("L"), s, F.lit("1"))).when(b == 1, F.concat(F.lit("D"), s, F.lit("-2"))).when(b == 2, F.concat(F.lit("86-"), s)).otherwise("none").alias("ref"))
    in_title = articles.select("id", F.explode(F.array_distinct(F.regexp_extract_all("title", F.lit("[0-9]{2,4}-[0-9]+"), F.lit(0)))).alias("key"))
    squeezed = lambda c: F.regexp_replace(c, "[- ]", "")
    least = lambda df, key: df.groupBy(key.alias("key")).agg(F.min("id").alias("value"))
    attempts = [(F.when(F.col("ref").rlike("^[0-9]{2,4}-[0-9]+$"), F.col("ref")), least(in_title, F.col("key"))), (F.col("ref"), least(articles, F.col("number"))), (squeezed("ref"), least(articles, squeezed("number")))]
    return R.cascade(refs, attempts, "article_id").select("ref_id", "article_id", "attempt")


@query("""SELECT 'supplier' AS side, s_suppkey AS id, s_nationkey AS class_id, c_custkey AS same_id, (SELECT count(*) FROM customer c WHERE c.c_nationkey = s_nationkey) + CAST(c_custkey IS NOT NULL AND coalesce(c_nationkey <> s_nationkey, true) AS BIGINT) AS n_links FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey
UNION ALL SELECT 'customer', c_custkey, c_nationkey, s_suppkey, (SELECT count(*) FROM supplier s WHERE s.s_nationkey = c_nationkey) + CAST(s_suppkey IS NOT NULL AND coalesce(s_nationkey <> c_nationkey, true) AS BIGINT) FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def source_candidates(t: Tables) -> DataFrame:
    """Suppliers and customers of one number or of one nation, in factored form: all pairs of a class, and the pairs of one number."""
    suppliers = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("class_id"))
    customers = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("class_id"))
    return R.either_key(suppliers, customers, ("supplier", "customer"))


@query("""SELECT l_orderkey, arg_max(l_linenumber, (l_extendedprice, -l_linenumber, -l_partkey)) AS best_section, arg_max(l_partkey, (l_quantity, -l_linenumber, -l_partkey)) AS best_chunk FROM lineitem GROUP BY l_orderkey""")
def best_per_document(t: Tables) -> DataFrame:
    back = [(-F.col("l_linenumber")).alias("b"), (-F.col("l_partkey")).alias("c")]
    return t.lineitem.groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("l_extendedprice", *back)).alias("best_section"), F.max_by("l_partkey", F.struct("l_quantity", *back)).alias("best_chunk"))


_SECTIONS = """s AS (SELECT l_orderkey AS doc_id, l_linenumber AS section_id, 'Part ' || l_returnflag || ' > Item ' || l_linenumber % 3 AS path FROM lineitem)"""


@query(f"""WITH {_SECTIONS}, c AS (SELECT o_orderkey AS chunk_id, o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'Part R > Item 1' WHEN 1 THEN 'Other > Item 2' WHEN 2 THEN 'Item 0' ELSE 'none' END AS path FROM orders),
one AS (SELECT doc_id, path, min(section_id) AS id FROM s GROUP BY ALL HAVING count(DISTINCT section_id) = 1), two AS (SELECT doc_id, split_part(path, ' > ', 2) AS path, min(section_id) AS id FROM s GROUP BY ALL HAVING count(DISTINCT section_id) = 1), four AS (SELECT doc_id, min(section_id) AS id FROM s GROUP BY doc_id HAVING count(DISTINCT section_id) = 1)
SELECT chunk_id, coalesce(one.id, two.id, four.id) AS section_id FROM c LEFT JOIN one ON one.doc_id = c.doc_id AND one.path = c.path LEFT JOIN two ON two.doc_id = c.doc_id AND two.path = CASE WHEN contains(c.path, ' > ') THEN split_part(c.path, ' > ', 2) ELSE c.path END LEFT JOIN four ON four.doc_id = c.doc_id""")
def section_match(t: Tables) -> DataFrame:
    sections = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("section_id"), F.concat(F.lit("Part "), "l_returnflag", F.lit(" > Item "), (F.col("l_linenumber") % 3).cast("string")).alias("path"))
    k = F.col("o_orderkey") % 4
    chunks = t.orders.select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderkey").alias("doc_id"), F.when(k == 0, "Part R > Item 1").when(k == 1, "Other > Item 2").when(k == 2, "Item 0").otherwise("none").alias("path"))
    return R.match_sections(chunks, sections).select("chunk_id", "section_id")


@query("""WITH r AS (SELECT event_id AS ref_id, CASE WHEN event_id % 2 = 0 THEN 'benchmark' ELSE 'documents' END AS tab, user_id AS id, CASE WHEN event_id % 7 = 0 THEN 'own ' || event_id WHEN event_id % 7 = 1 THEN '' END AS txt FROM events)
SELECT ref_id, md5(coalesce(nullif(trim(txt), ''), CASE WHEN tab = 'benchmark' THEN nullif(trim(b.text), '') ELSE nullif(trim(d.text), '') END)) AS digest FROM r LEFT JOIN documents d ON d.doc_id = r.id LEFT JOIN benchmark b ON b.item_id = r.id""")
def chunk_hydration(t: Tables) -> DataFrame:
    i = F.col("event_id")
    refs = t.events.select(i.alias("ref_id"), F.when(i % 2 == 0, "benchmark").otherwise("documents").alias("table"), F.col("user_id").alias("id"), F.when(i % 7 == 0, F.concat(F.lit("own "), i.cast("string"))).when(i % 7 == 1, "").alias("text"))
    tables = {"documents": t.documents.select(F.col("doc_id").alias("id"), "text"), "benchmark": t.benchmark.select(F.col("item_id").alias("id"), "text")}
    return R.hydrate(refs, tables).select("ref_id", F.md5("text").alias("digest"))


@query("""WITH e AS (SELECT o_orderkey, unnest(['N' || o_custkey % 25, 'N' || o_orderkey % 25, 'N99']) AS rule FROM orders) SELECT e.o_orderkey, e.rule, n.n_name, c.c_custkey IS NOT NULL AS populated FROM e JOIN nation n ON e.rule = 'N' || n.n_nationkey LEFT JOIN customer c ON c.c_custkey = e.o_orderkey WHERE n.n_regionkey < 3""")
def rules_star(t: Tables) -> DataFrame:
    listed = F.concat(F.lit("N"), (F.col("o_custkey") % 25).cast("string"), F.lit("; N"), (F.col("o_orderkey") % 25).cast("string"), F.lit(", N99"))
    rules = t.orders.select("o_orderkey", F.explode(V.text_list(listed)).alias("rule"))
    named = rules.join(t.nation.filter("n_regionkey < 3").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("rule"), "n_name"), "rule")
    people = t.customer.select(F.col("c_custkey").alias("o_orderkey"), F.lit(True).alias("populated"))
    return named.join(people, "o_orderkey", "left").select("o_orderkey", "rule", "n_name", F.coalesce("populated", F.lit(False)).alias("populated"))


@query("""WITH v AS (SELECT s_suppkey AS id, 'S. ' || s_suppkey AS value FROM supplier), g AS (SELECT p_partkey // 4 AS grp, 'P' || p_partkey AS value FROM part UNION ALL SELECT p_partkey // 4, 's' || p_partkey // 2 FROM part WHERE p_partkey % 4 = 0),
k AS (SELECT DISTINCT grp, value, replace(replace(upper(value), ' ', ''), '.', '') AS k FROM g)
SELECT id, value FROM v UNION SELECT v.id, b.value FROM v JOIN k a ON a.k = replace(replace(upper(v.value), ' ', ''), '.', '') JOIN k b ON a.grp = b.grp AND a.k <> b.k""")
def alias_closure(t: Tables) -> DataFrame:
    values = t.supplier.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("S. "), F.col("s_suppkey").cast("string")).alias("value"))
    p, group = F.col("p_partkey"), F.floor(F.col("p_partkey") / 4).alias("group")
    groups = t.part.select(group, F.concat(F.lit("P"), p.cast("string")).alias("value")).unionByName(t.part.filter(p % 4 == 0).select(group, F.concat(F.lit("s"), F.floor(p / 2).cast("string")).alias("value")))
    return R.alias_closure(values, groups)


@query("""WITH r AS (SELECT 'K' || l_orderkey AS cid, CASE WHEN l_orderkey % 3 = 0 THEN '' WHEN l_orderkey % 3 = 1 THEN 'K' || l_orderkey || '_' || (l_linenumber - 1) ELSE 'K' || l_orderkey || '_' || l_linenumber END AS chunk_id, CAST(l_partkey AS VARCHAR) AS text FROM lineitem)
SELECT cid, coalesce(max(text) FILTER (chunk_id = cid || '_0'), CASE WHEN count(*) = 1 AND max(chunk_id) = '' THEN max(text) END) AS text, count(*) AS n, coalesce(max(text) FILTER (chunk_id = cid || '_0'), CASE WHEN count(*) = 1 AND max(chunk_id) = '' THEN max(text) END) IS NULL AS missing FROM r GROUP BY cid""")
def canonical_rows(t: Tables) -> DataFrame:
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    cid = F.concat(F.lit("K"), o.cast("string"))
    chunk = F.when(o % 3 == 1, F.concat(cid, F.lit("_"), (n - 1).cast("string"))).when(o % 3 == 2, F.concat(cid, F.lit("_"), n.cast("string")))
    return R.canonical_rows(t.lineitem.select(cid.alias("cid"), chunk.alias("chunk_id"), F.col("l_partkey").cast("string").alias("text")))


@query("""WITH u AS (SELECT doc_id FROM documents WHERE lang = 'en' UNION SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT item_id FROM benchmark) SELECT 'documents' AS name, doc_id AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM u) UNION ALL SELECT 'pages', page_id FROM pages WHERE page_id IN (SELECT doc_id FROM u)""")
def universe_filter(t: Tables) -> DataFrame:
    ids = t.documents.filter("lang = 'en'").select(F.col("doc_id").alias("id")).union(t.labels.filter("quality = 1").select("doc_id")).union(t.benchmark.select("item_id")).distinct()
    frames = {"documents": t.documents.select(F.col("doc_id").alias("id")), "pages": t.pages.select(F.col("page_id").alias("id"))}
    labelled = [df.select(F.lit(name).alias("name"), "id") for name, df in frames.items()]
    return labelled[0].unionByName(labelled[1]).join(ids, "id", "left_semi").select("name", "id")


@query("""WITH b AS (SELECT l_orderkey AS doc, l_linenumber AS pos, l_returnflag AS a, l_linestatus AS b, l_suppkey % 2 AS c FROM lineitem), f AS (SELECT *, row_number() OVER (PARTITION BY doc, a, b, c ORDER BY pos) AS n FROM b) SELECT doc, pos, row_number() OVER (PARTITION BY doc ORDER BY pos) - 1 AS place FROM f WHERE n = 1""")
def block_dedup(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"), (F.col("l_suppkey") % 2).alias("c"))
    kept = rows.groupBy("doc", "a", "b", "c").agg(F.min("pos").alias("pos"))
    return kept.select("doc", "pos", (F.row_number().over(Window.partitionBy("doc").orderBy("pos")) - 1).cast("long").alias("place"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END AS finished FROM orders WHERE o_orderstatus <> 'P') SELECT o_custkey, o_orderkey AS run FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY finished DESC NULLS LAST, o_orderkey DESC) AS n FROM r) WHERE n = 1""")
def latest_run(t: Tables) -> DataFrame:
    finished = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderdate"))
    return t.orders.filter("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct(finished.isNotNull(), finished, "o_orderkey")).alias("run"))


@query()
def random_sample(t: Tables) -> DataFrame:
    """A sample of 100 documents for one seed (sampling is the feature)."""
    return ranking.sample_rows(t.documents.select("doc_id", "lang"), 100, 7, "doc_id")


@query("""WITH c AS (SELECT l_orderkey AS q, l_linenumber AS chunk, l_extendedprice AS score, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS section FROM lineitem)
SELECT q, chunk, section, score FROM (SELECT *, row_number() OVER (PARTITION BY q, section ORDER BY score DESC, chunk) AS n FROM c WHERE section IS NOT NULL) WHERE n = 1 UNION ALL SELECT q, chunk, section, score FROM c WHERE section IS NULL""")
def section_expansion(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("chunk"), F.col("l_extendedprice").alias("score"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("section"))
    best = ranking.first_by(rows.filter("section is not null"), ["q", "section"], [-F.col("score"), F.col("chunk")])
    return best.select("q", "chunk", "section", "score").unionByName(rows.filter("section is null").select("q", "chunk", "section", "score"))


@query("""WITH c AS (SELECT l_orderkey AS q, 'A' || l_suppkey AS cid, l_returnflag AS tab, CASE l_linenumber % 3 WHEN 0 THEN 'A' || l_suppkey || '_0' WHEN 1 THEN 'A' || l_suppkey || '_r2s' ELSE 'x' || l_linenumber END AS chunk FROM lineitem),
k AS (SELECT q, chunk, CASE WHEN chunk IN (cid || '_0', cid || '_r2s') THEN 'cid:' || tab || ':' || cid ELSE 'chunk:' || chunk END AS grp FROM c) SELECT q, grp, count(*) AS n_chunks, min(chunk) AS first_chunk FROM k GROUP BY q, grp""")
def pair_fusion(t: Tables) -> DataFrame:
    cid, k = F.concat(F.lit("A"), F.col("l_suppkey").cast("string")), F.col("l_linenumber") % 3
    chunk = F.when(k == 0, F.concat(cid, F.lit("_0"))).when(k == 1, F.concat(cid, F.lit("_r2s"))).otherwise(F.concat(F.lit("x"), F.col("l_linenumber").cast("string")))
    rows = t.lineitem.select(F.col("l_orderkey").alias("q"), cid.alias("cid"), F.col("l_returnflag").alias("tab"), chunk.alias("chunk"))
    pair = F.col("chunk").isin(F.concat("cid", F.lit("_0")), F.concat("cid", F.lit("_r2s"))) & ~T.is_blank(F.col("cid"))
    key = F.when(pair, F.concat_ws(":", F.lit("cid"), "tab", "cid")).otherwise(F.concat(F.lit("chunk:"), "chunk"))
    return rows.groupBy("q", key.alias("grp")).agg(F.count("*").alias("n_chunks"), F.min("chunk").alias("first_chunk"))
