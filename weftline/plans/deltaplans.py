"""Queries over delta plans and their application."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import delta as O
from weftline.operators import deltaplans as D
from weftline.plans.common import Tables, query

_I = F.col


def _hashes(t: Tables) -> tuple[DataFrame, DataFrame]:
    i = _I("doc_id")
    manifest = t.documents.filter(i % 5 > 0).select(i.alias("uid"), F.md5("text").alias("content_hash"), (i % 11 == 0).alias("abrogated"), F.lit(False).alias("protected"), (i % 7 == 0).alias("pending"), (i % 22 == 0).alias("limbo"))
    corpus = t.documents.filter(i % 4 > 0).select(i.alias("uid"), F.md5(F.concat("text", F.when(i % 3 == 0, "x").otherwise(""))).alias("content_hash"), (i % 17).alias("n_chunks"))
    return manifest, corpus


_SCOPED = """m AS (SELECT doc_id AS uid, md5(text) AS h, doc_id % 11 = 0 AS abrogated, doc_id % 7 = 0 AS pending, doc_id % 22 = 0 AS limbo FROM documents WHERE doc_id % 5 > 0), c AS (SELECT doc_id AS uid, md5(text || CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE '' END) AS h, doc_id % 17 AS n FROM documents WHERE doc_id % 4 > 0),
b AS (SELECT coalesce(m.uid, c.uid) AS uid, c.uid IS NOT NULL AS stored, coalesce(pending, false) AS pending, coalesce(limbo, false) AS limbo, CASE WHEN m.uid IS NULL THEN 'stale' WHEN abrogated THEN CASE WHEN c.uid IS NULL THEN 'acknowledged' ELSE 'remove_abrogated' END WHEN c.uid IS NULL THEN 'new' WHEN m.h = c.h AND n > 0 THEN 'unchanged' ELSE 'changed' END AS action FROM m FULL OUTER JOIN c ON m.uid = c.uid),
p AS (SELECT uid, CASE WHEN pending THEN CASE WHEN stored THEN 'pending_kept' ELSE 'pending_skipped' END WHEN limbo AND action IN ('remove_abrogated', 'stale') THEN 'limbo_kept' ELSE action END AS action FROM b)"""


@query(f"WITH {_SCOPED} SELECT uid, CASE WHEN uid % 2 = 1 THEN 'out_of_scope' ELSE action END AS action FROM p")
def scoped_plan(t: Tables) -> DataFrame:
    return D.scoped_plan(*_hashes(t), scope=t.documents.filter("doc_id % 2 = 0").select(_I("doc_id").alias("uid")))


@query(f"""WITH {_SCOPED}, i AS (SELECT doc_id AS uid, md5(text) AS content_hash, 9 AS n_chunks FROM documents WHERE doc_id % 6 > 0),
s AS (SELECT p.uid, action, CASE WHEN action IN ('new', 'changed') THEN CASE WHEN i.uid IS NULL THEN 'failed' ELSE 'ingested' END WHEN action IN ('remove_abrogated', 'stale') THEN 'removed' ELSE 'kept' END AS status FROM p LEFT JOIN i ON i.uid = p.uid),
a AS (SELECT uid, h, n FROM c WHERE uid NOT IN (SELECT uid FROM s WHERE status IN ('ingested', 'removed')) UNION ALL SELECT uid, content_hash, n_chunks FROM i WHERE uid IN (SELECT uid FROM s WHERE status = 'ingested'))
SELECT 'status ' || status AS name, count(*) AS n, CAST(sum(uid) AS BIGINT) AS mark FROM s GROUP BY status UNION ALL SELECT 'corpus', count(*), CAST(sum(uid * 31 + n) AS BIGINT) FROM a""")
def delta_run(t: Tables) -> DataFrame:
    """A whole run: plan, application, status by uid, and the corpus afterwards."""
    manifest, corpus = _hashes(t)
    incoming = t.documents.filter("doc_id % 6 > 0").select(_I("doc_id").alias("uid"), F.md5("text").alias("content_hash"), F.lit(9).cast("long").alias("n_chunks"))
    after, status = D.apply_plan(corpus, D.scoped_plan(manifest, corpus), incoming, full=True)
    marks = after.agg(F.lit("corpus").alias("name"), F.count("*").alias("n"), F.sum(_I("uid") * 31 + _I("n_chunks")).alias("mark"))
    return status.groupBy(F.concat(F.lit("status "), "status").alias("name")).agg(F.count("*").alias("n"), F.sum("uid").alias("mark")).unionByName(marks)


@query("""WITH tx AS (SELECT s_suppkey AS text_id FROM supplier WHERE s_suppkey % 4 > 0), ct AS (SELECT l_suppkey AS text_id, 'A' || l_partkey AS article_id, l_linenumber AS version FROM lineitem WHERE l_orderkey % 3 = 0), al AS (SELECT 'A' || p_partkey AS alias, 'A' || (p_partkey - 1) AS uid FROM part WHERE p_partkey % 10 = 1),
co AS (SELECT 'A' || l_partkey AS article_id, min(l_suppkey) AS text_id, max(l_linenumber) AS version, count(*) % 9 AS n FROM lineitem WHERE l_orderkey % 3 = 1 GROUP BY 1),
w AS (SELECT coalesce(al.uid, article_id) AS uid, max(version) AS want FROM ct SEMI JOIN tx USING (text_id) LEFT JOIN al ON alias = article_id GROUP BY 1),
st AS (SELECT coalesce(al.uid, article_id) AS uid, co.*, tx.text_id IS NOT NULL AS listed FROM co LEFT JOIN al ON alias = article_id LEFT JOIN tx ON tx.text_id = co.text_id),
r AS (SELECT coalesce(w.uid, st.uid) AS uid, article_id, text_id, w.uid IS NOT NULL AS wanted, listed, version, want, n, min(article_id) OVER (PARTITION BY coalesce(w.uid, st.uid)) AS first FROM st FULL OUTER JOIN w ON w.uid = st.uid),
j AS (SELECT *, CASE WHEN article_id IS NULL THEN 'new' WHEN article_id <> first THEN 'twin' WHEN wanted THEN CASE WHEN version = want AND n > 0 THEN 'unchanged' ELSE 'changed' END WHEN listed THEN 'stale' ELSE 'foreign' END AS action FROM r),
sh AS (SELECT text_id, avg(CAST(action = 'stale' AS INT)) AS share FROM j WHERE article_id IS NOT NULL GROUP BY text_id)
SELECT uid, coalesce(article_id, uid) AS article_id, CASE WHEN action = 'stale' AND share > 0.05 THEN 'blocked_stale' ELSE action END AS action FROM j LEFT JOIN sh USING (text_id)""")
def legal_plan(t: Tables) -> DataFrame:
    a = lambda c: F.concat(F.lit("A"), c.cast("string"))
    texts = t.supplier.filter("s_suppkey % 4 > 0").select(_I("s_suppkey").alias("text_id"))
    contents = t.lineitem.filter("l_orderkey % 3 = 0").select(_I("l_suppkey").alias("text_id"), a(_I("l_partkey")).alias("article_id"), _I("l_linenumber").alias("version"))
    aliases = t.part.filter("p_partkey % 10 = 1").select(a(_I("p_partkey")).alias("alias"), a(_I("p_partkey") - 1).alias("uid"))
    corpus = t.lineitem.filter("l_orderkey % 3 = 1").groupBy(a(_I("l_partkey")).alias("article_id")).agg(F.min("l_suppkey").alias("text_id"), F.max("l_linenumber").alias("version"), (F.count("*") % 9).alias("n_chunks"))
    return D.legal_plan(texts, contents, aliases, corpus, most_stale=0.05)


@query("""SELECT doc_id, CASE WHEN doc_id % 3 > 0 AND doc_id % 5 > 0 AND doc_id % 2 = 0 THEN CAST(doc_id % 7 AS INT) ELSE 0 END AS reusable FROM documents WHERE text IS NOT NULL""")
def gold_reuse(t: Tables) -> DataFrame:
    i = _I("doc_id")
    docs = t.documents.filter("text is not null").select("doc_id", F.concat(F.lit("d"), i.cast("string")).alias("uid"), F.md5("text").alias("checksum"))
    state = t.documents.filter("text is not null").select(F.concat(F.lit(" D"), i.cast("string")).alias("uid"), F.when(i % 3 > 0, F.md5("text")).otherwise("").alias("checksum"), F.when(i % 5 > 0, "f1").otherwise("f0").alias("fingerprint"), (i % 7).cast("int").alias("n_valid"), i).filter(i % 2 == 0).drop("doc_id")
    return D.reuse(docs, state, F.lit("f1")).select("doc_id", "reusable")


@query("""WITH d AS (SELECT o_orderkey AS short, o_orderkey + 5000000 AS id, 0 AS gen FROM orders WHERE o_orderkey % 3 > 0), p AS (SELECT l_orderkey + 5000000 AS id, l_linenumber AS pos, 0 AS gen FROM lineitem WHERE l_orderkey % 3 > 0), nd AS (SELECT o_orderkey AS short, o_orderkey + 9000000 AS id FROM orders WHERE o_orderkey % 4 = 0), np AS (SELECT l_orderkey + 9000000 AS id, l_linenumber + 10 AS pos FROM lineitem WHERE l_orderkey % 4 = 0),
mv AS (SELECT nd.id, coalesce(d.id, nd.id) AS new FROM nd LEFT JOIN d USING (short)), ad AS (SELECT id FROM d WHERE short NOT IN (SELECT short FROM nd) UNION ALL SELECT new FROM mv), ap AS (SELECT id, pos, gen FROM p WHERE id NOT IN (SELECT new FROM mv) UNION ALL SELECT new, pos, 1 FROM np JOIN mv USING (id))
SELECT 'documents' AS name, count(*) AS n, CAST(sum(id) AS BIGINT) AS mark FROM ad UNION ALL SELECT 'parts', count(*), CAST(sum(id * 7 + pos * 3 + gen) AS BIGINT) FROM ap""")
def bundle_replace(t: Tables) -> DataFrame:
    docs = lambda mod, eq, add, gen: t.orders.filter(f"o_orderkey % {mod} {eq}").select(_I("o_orderkey").alias("short"), (_I("o_orderkey") + add).alias("id"), F.lit(gen).alias("gen"))
    parts = lambda mod, eq, add, up, gen: t.lineitem.filter(f"l_orderkey % {mod} {eq}").select((_I("l_orderkey") + add).alias("id"), (_I("l_linenumber") + up).alias("pos"), F.lit(gen).alias("gen"))
    out = D.replace_bundles({"documents": docs(3, "> 0", 5000000, 0), "parts": parts(3, "> 0", 5000000, 0, 0)}, {"documents": docs(4, "= 0", 9000000, 1), "parts": parts(4, "= 0", 9000000, 10, 1)}, "short", "id")
    a = out["documents"].agg(F.lit("documents").alias("name"), F.count("*").alias("n"), F.sum("id").alias("mark"))
    return a.unionByName(out["parts"].agg(F.lit("parts").alias("name"), F.count("*").alias("n"), F.sum(_I("id") * 7 + _I("pos") * 3 + _I("gen")).alias("mark")))


@query("""WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN ' ' WHEN c_custkey % 3 = 1 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS bal FROM customer), s AS (SELECT s_suppkey AS c_custkey, CASE WHEN s_suppkey % 5 > 0 THEN s_name END AS name, s_acctbal AS bal FROM supplier)
SELECT c_custkey, CASE WHEN trim(coalesce(r.name, '')) = '' AND s.name IS NOT NULL THEN s.name ELSE r.name END AS name, coalesce(r.bal, s.bal) AS bal, CAST(trim(coalesce(r.name, '')) = '' AND s.name IS NOT NULL AS INT) + CAST(r.bal IS NULL AND s.bal IS NOT NULL AS INT) AS filled FROM r LEFT JOIN s USING (c_custkey)""")
def conditional_backfill(t: Tables) -> DataFrame:
    k = _I("c_custkey")
    rows = t.customer.select(k, F.when(k % 3 == 0, " ").when(k % 3 == 1, None).otherwise(_I("c_name")).alias("name"), F.when(k % 2 == 0, _I("c_acctbal")).alias("bal"))
    source = t.supplier.select(_I("s_suppkey").alias("c_custkey"), F.when(_I("s_suppkey") % 5 > 0, _I("s_name")).alias("name"), _I("s_acctbal").alias("bal"))
    return D.backfill(rows, source, "c_custkey", ["name", "bal"])


@query("""WITH a AS (SELECT p_partkey AS cid, md5(p_name) AS v FROM part WHERE p_partkey % 6 > 0), d AS (SELECT p_partkey AS cid, md5(p_name || CASE WHEN p_partkey % 4 = 0 THEN 'x' ELSE '' END) AS v FROM part WHERE p_partkey % 5 > 0)
SELECT coalesce(a.cid, d.cid) AS cid, CASE WHEN d.cid IS NULL THEN 'create' WHEN a.cid IS NULL THEN 'remove' WHEN a.v = d.v THEN 'keep' ELSE 'refresh' END AS action FROM a FULL OUTER JOIN d ON a.cid = d.cid""")
def derived_plan(t: Tables) -> DataFrame:
    k = _I("p_partkey")
    articles = t.part.filter(k % 6 > 0).select(k.alias("cid"), F.md5("p_name").alias("variant"))
    derived = t.part.filter(k % 5 > 0).select(k.alias("cid"), F.md5(F.concat("p_name", F.when(k % 4 == 0, "x").otherwise(""))).alias("variant"))
    return D.derived_plan(articles, derived)


@query("""WITH o AS (SELECT l_orderkey AS turn_id, l_linenumber AS event_index, max(l_partkey) AS ref, 'old' AS state FROM lineitem WHERE l_linenumber < 4 GROUP BY 1, 2), n AS (SELECT l_orderkey AS turn_id, l_linenumber AS event_index, CASE WHEN l_linenumber = 3 THEN NULL ELSE max(l_suppkey) END AS ref, 'new' AS state FROM lineitem WHERE l_linenumber > 2 GROUP BY 1, 2)
SELECT coalesce(n.turn_id, o.turn_id) AS turn_id, coalesce(n.event_index, o.event_index) AS event_index, coalesce(n.ref, o.ref) AS ref, coalesce(n.state, o.state) AS state FROM o FULL OUTER JOIN n ON o.turn_id = n.turn_id AND o.event_index = n.event_index""")
def log_upsert(t: Tables) -> DataFrame:
    g = lambda cut, value, state: t.lineitem.filter(cut).groupBy(_I("l_orderkey").alias("turn_id"), _I("l_linenumber").alias("event_index")).agg(F.max(value).alias("ref")).withColumn("state", F.lit(state))
    new = g("l_linenumber > 2", "l_suppkey", "new").withColumn("ref", F.when(_I("event_index") != 3, _I("ref")))
    return O.upsert(g("l_linenumber < 4", "l_partkey", "old"), new, ["turn_id", "event_index"], keep_on_null=["ref"])


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 3 AS r, c_name AS v FROM customer WHERE c_custkey % 4 > 0), n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_custkey % 2 END AS e, 5 AS r, 'new' AS v FROM customer WHERE c_custkey % 5 > 0), b AS (SELECT coalesce(c.k, n.k) AS k, c.r AS cr, c.v AS cv, n.e, n.r AS nr, n.v AS nv, n.k IS NOT NULL AND n.e IS NOT DISTINCT FROM c.r AS taken FROM c FULL OUTER JOIN n ON c.k = n.k)
SELECT k, cr AS revision, cv AS value, CASE WHEN taken THEN 'superseded' ELSE 'current' END AS state FROM b WHERE cr IS NOT NULL UNION ALL SELECT k, nr, nv, CASE WHEN taken THEN 'current' ELSE 'rejected' END FROM b WHERE nr IS NOT NULL""")
def feedback_revision(t: Tables) -> DataFrame:
    k = _I("c_custkey")
    current = t.customer.filter(k % 4 > 0).select(k.alias("k"), (k % 3).alias("revision"), _I("c_name").alias("value"))
    changes = t.customer.filter(k % 5 > 0).select(k.alias("k"), F.when(k % 8 > 0, k % 2).alias("expected"), F.lit(5).cast("long").alias("revision"), F.lit("new").alias("value"))
    return D.revise(current, changes, "k")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(list_sort(list_distinct(['p' || l_partkey, 's' || l_suppkey, 'p' || l_suppkey])), ',') AS chunk_ids, array_to_string(list_sort(list_distinct([l_returnflag, 'S'])), ',') AS tables FROM lineitem""")
def trace_events(t: Tables) -> DataFrame:
    ref = lambda p, c, table: F.struct(F.concat(F.lit(p), _I(c).cast("string")).alias("id"), table.alias("table"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.array(ref("p", "l_partkey", _I("l_returnflag")), ref("s", "l_suppkey", F.lit("S"))).alias("pool"), F.array(ref("p", "l_suppkey", F.lit("S"))).alias("kept"))
    return D.trace_events(rows, ["pool", "kept"]).select("l_orderkey", "l_linenumber", "l_partkey", F.array_join("chunk_ids", ",").alias("chunk_ids"), F.array_join("tables", ",").alias("tables"))


@query("""SELECT p_partkey AS payload_id, CASE WHEN p_partkey % 4 = 0 THEN 'K' || p_partkey ELSE 'A' || p_partkey END AS id, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS title, p_size AS version, CASE WHEN p_partkey % 3 = 0 THEN 'title' ELSE '' END AS errors FROM part""")
def payload_rows(t: Tables) -> DataFrame:
    k = _I("p_partkey")
    fields = F.struct(F.concat(F.lit(" a"), k.cast("string")).alias("id"), F.when(k % 3 > 0, _I("p_name")).alias("title"), _I("p_size").alias("version"))
    aliases = t.part.filter(k % 4 == 0).select(F.concat(F.lit("a"), k.cast("string")).alias("alias"), F.concat(F.lit("K"), k.cast("string")).alias("uid"))
    rows = D.payload_rows(t.part.select(k.alias("payload_id"), F.to_json(fields).alias("payload")), "id string, title string, version int", ["id", "title"], aliases)
    return rows.select("payload_id", "id", "title", "version", F.array_join("errors", ",").alias("errors"))


@query("""SELECT event_id, event_type AS stage, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, round(value, 3) AS duration, event_type <> 'error' AS rag, strftime(ts, '%Y-%m-%d') AS day FROM events""")
def run_rows(t: Tables) -> DataFrame:
    """A wide row of each run from its state as JSON; turns without retrieval have rag false."""
    p = F.from_json("props", "k long")
    return t.events.select("event_id", _I("event_type").alias("stage"), p["k"].alias("k"), F.round("value", 3).alias("duration"), (_I("event_type") != "error").alias("rag"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("""WITH a AS (SELECT p_partkey, 'C' || p_partkey % 80 AS cid, CASE WHEN p_partkey % 7 > 0 THEN p_name ELSE ' ' END AS text, p_type AS variant, p_partkey % 9 = 0 AS is_summary FROM part) SELECT p_partkey, cid FROM a WHERE trim(text) <> '' AND NOT is_summary AND cid IN (SELECT 'C' || s_suppkey FROM supplier) AND variant LIKE 'E%'""")
def article_rows(t: Tables) -> DataFrame:
    """Rows of articles with text, without summaries where the table marks them, of a set of ids and a kind of variant."""
    k = _I("p_partkey")
    rows = t.part.select(k, F.concat(F.lit("C"), (k % 80).cast("string")).alias("cid"), F.when(k % 7 > 0, _I("p_name")).otherwise(" ").alias("text"), _I("p_type").alias("variant"), (k % 9 == 0).alias("is_summary"))
    if "is_summary" in rows.columns:
        rows = rows.filter(~_I("is_summary"))
    asked = t.supplier.select(F.concat(F.lit("C"), _I("s_suppkey").cast("string")).alias("cid"))
    return rows.filter("trim(text) <> '' and variant like 'E%'").join(asked, "cid", "left_semi").select("p_partkey", "cid")


@query("""SELECT n.n_name, NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 0) AS is_empty FROM nation n""")
def empty_corpora(t: Tables) -> DataFrame:
    has = t.supplier.filter("s_acctbal > 0").select(_I("s_nationkey").alias("n_nationkey"), F.lit(True).alias("has")).distinct()
    return t.nation.join(has, "n_nationkey", "left").select("n_name", _I("has").isNull().alias("is_empty"))


_RUN = """m AS (SELECT doc_id AS id, doc_id % 7 > 0 AS in_force, doc_id % 11 > 0 AS valid FROM documents WHERE doc_id % 29 > 0), f AS (SELECT doc_id AS id, text FROM documents WHERE doc_id % 13 > 0 AND text IS NOT NULL),
d AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 > 0 THEN sha256(text) ELSE 'old' END AS checksum FROM documents WHERE doc_id % 3 > 0), c AS (SELECT doc_id AS id, k FROM documents, (SELECT unnest([0, 1]) AS k) WHERE doc_id % 3 > 0 AND doc_id % 17 > 0 UNION ALL SELECT -1, 0),
held AS (SELECT id, count(*) AS n FROM c GROUP BY id), x AS (SELECT m.*, sha256(f.text) AS h, f.text, d.checksum, d.id IS NOT NULL AS stored, coalesce(held.n, 0) AS n FROM m LEFT JOIN f USING (id) LEFT JOIN d USING (id) LEFT JOIN held USING (id)),
j AS (SELECT id, text, stored, CASE WHEN NOT valid THEN 'error' WHEN NOT in_force THEN CASE WHEN stored THEN 'removed' ELSE 'acknowledged' END WHEN h IS NULL THEN 'error' WHEN stored AND h = checksum AND n > 0 THEN 'unchanged' WHEN id % 23 = 0 THEN 'error' ELSE 'ok' END AS status, n FROM x
  UNION ALL SELECT id, NULL, true, 'removed', 0 FROM d WHERE id NOT IN (SELECT id FROM m)),
ad AS (SELECT id FROM d WHERE id NOT IN (SELECT id FROM j WHERE status IN ('ok', 'removed')) UNION ALL SELECT id FROM j WHERE status = 'ok'),
ac AS (SELECT id, k FROM c WHERE id IN (SELECT id FROM ad) AND id NOT IN (SELECT id FROM j WHERE status = 'ok') UNION ALL SELECT id, unnest(range(len(string_split(text, chr(10))))) FROM j WHERE status = 'ok')"""


@query(f"""WITH {_RUN} SELECT 'status ' || status AS name, count(*) AS n, CAST(sum(id) AS BIGINT) AS mark FROM j GROUP BY status UNION ALL SELECT 'documents', count(*), CAST(sum(id) AS BIGINT) FROM ad UNION ALL SELECT 'chunks', count(*), CAST(sum(id * 3 + k) AS BIGINT) FROM ac""")
def corpus_run(t: Tables) -> DataFrame:
    """A run that hashes all texts and parses into lines only those that are new or changed."""
    from weftline.operators.corpusrun import corpus_run as run

    i, uid = _I("doc_id"), F.concat(F.lit("d"), _I("doc_id").cast("string")).alias("uid")
    manifest = t.documents.filter("doc_id % 29 > 0").select(F.concat(F.lit(" D"), i.cast("string")).alias("uid"), (i % 7 > 0).alias("in_force"), (i % 11 > 0).alias("valid"))
    files = t.documents.select(uid, F.when(i % 13 > 0, F.encode("text", "UTF-8")).alias("content"))
    documents = t.documents.filter("doc_id % 3 > 0").select(uid, F.when(i % 5 > 0, F.sha2("text", 256)).otherwise("old").alias("checksum"))
    chunks = t.documents.filter("doc_id % 3 > 0 and doc_id % 17 > 0").select(uid, F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_index"), F.lit("x").alias("text"))
    chunks = chunks.unionByName(t.documents.limit(1).select(F.lit("d-1").alias("uid"), F.lit(0).alias("chunk_index"), F.lit("x").alias("text")))

    def parse(rows: DataFrame) -> DataFrame:
        lines = rows.select("uid", F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("chunk_index", "text"))
        return lines.withColumn("error", F.when(F.substring("uid", 2, 20).cast("long") % 23 == 0, "unreadable"))

    after = run(manifest, files, documents, chunks, parse)
    number = F.substring("uid", 2, 20).cast("long")
    counted = lambda df, name, mark: df.groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.sum(mark).alias("mark"))
    out = counted(after["status"], F.concat(F.lit("status "), "status"), number).unionByName(counted(after["documents"], F.lit("documents"), number))
    return out.unionByName(counted(after["chunks"], F.lit("chunks"), number * 3 + F.col("chunk_index")))
