"""Delta queries: reconciliation, upserts, cascades, identities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import delta as D
from weftline.plans.common import Tables, query

_MANIFEST = "m AS (SELECT doc_id AS uid, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE sha256(text) END AS h, doc_id % 11 = 0 AS abrogated, doc_id % 13 = 0 AS protected FROM documents WHERE doc_id % 5 > 0), c AS (SELECT doc_id AS uid, CASE WHEN doc_id % 3 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS h, doc_id % 17 AS n_chunks FROM documents WHERE doc_id % 4 > 0)"


def _manifest(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    return t.documents.filter(i % 5 > 0).select(i.alias("uid"), F.when(i % 7 != 0, F.sha2("text", 256)).alias("content_hash"), (i % 11 == 0).alias("abrogated"), (i % 13 == 0).alias("protected"))


def _corpus(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    return t.documents.filter(i % 4 > 0).select(i.alias("uid"), F.when(i % 3 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256)).alias("content_hash"), (i % 17).alias("n_chunks"))


_ACTION = "CASE WHEN m.uid IS NOT NULL AND protected THEN 'protected' WHEN m.uid IS NOT NULL AND abrogated THEN CASE WHEN c.uid IS NOT NULL THEN 'remove_abrogated' ELSE 'acknowledged' END WHEN m.uid IS NOT NULL AND c.uid IS NULL THEN 'new' WHEN m.uid IS NOT NULL THEN CASE WHEN m.h = c.h AND n_chunks > 0 THEN 'unchanged' ELSE 'changed' END ELSE 'stale' END"


@query(f"WITH {_MANIFEST} SELECT coalesce(m.uid, c.uid) AS uid, {_ACTION} AS action FROM m FULL OUTER JOIN c ON m.uid = c.uid")
def reconcile_plan(t: Tables) -> DataFrame:
    return D.reconcile(_manifest(t), _corpus(t))


@query(f"WITH {_MANIFEST}, p AS (SELECT coalesce(m.uid, c.uid) AS uid, {_ACTION} AS action FROM m FULL OUTER JOIN c ON m.uid = c.uid) SELECT action, count(*) AS n, list(uid ORDER BY uid)[1:5] AS sample FROM p GROUP BY action")
def plan_summary(t: Tables) -> DataFrame:
    plan = D.reconcile(_manifest(t), _corpus(t))
    counts = plan.groupBy("action").agg(F.count("*").alias("n"))
    return counts.join(D.least_of(plan, "action", "uid", 5).withColumnRenamed("least", "sample"), "action")


@query("WITH o AS (SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id % 3 > 0), n AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE upper(lang) END AS lang, 'new' AS source, n_chars + 1 AS n_chars FROM documents WHERE doc_id % 5 > 0) SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.lang, o.lang) AS lang, coalesce(o.source, n.source) AS source, CASE WHEN n.doc_id IS NOT NULL THEN n.n_chars ELSE o.n_chars END AS n_chars FROM o FULL OUTER JOIN n ON o.doc_id = n.doc_id")
def upsert_preserve(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "lang", "source", "n_chars")
    new = docs.filter("doc_id % 5 > 0").select("doc_id", F.when(F.col("doc_id") % 2 != 0, F.upper("lang")).alias("lang"), F.lit("new").alias("source"), (F.col("n_chars") + 1).alias("n_chars"))
    return D.upsert(docs.filter("doc_id % 3 > 0"), new, ["doc_id"], keep_on_null=["lang"], keep_old=["source"])


@query("WITH g AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'), a AS (SELECT * FROM orders ANTI JOIN g USING (o_orderkey)), b AS (SELECT * FROM lineitem l ANTI JOIN g ON l_orderkey = o_orderkey) SELECT 'orders' AS name, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS mark FROM a UNION ALL SELECT 'lineitem', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM b")
def cascade_delete(t: Tables) -> DataFrame:
    orders, lines = D.cascade_delete(t.orders, t.lineitem, "o_orderkey", "l_orderkey", t.orders.filter("o_orderstatus = 'F'"))
    return orders.agg(F.lit("orders").alias("name"), F.count("*").alias("n"), F.sum("o_orderkey").alias("mark")).unionByName(lines.agg(F.lit("lineitem").alias("name"), F.count("*").alias("n"), F.sum("l_orderkey").alias("mark")))


@query("SELECT doc_id, source FROM documents SEMI JOIN (SELECT DISTINCT source FROM documents WHERE doc_id % 100 = 7) USING (source)")
def keep_list(t: Tables) -> DataFrame:
    return D.keep_only(t.documents, "source", t.documents.filter("doc_id % 100 = 7").select("source")).select("doc_id", "source")


@query("WITH h AS (SELECT doc_id, sha1('src|' || source || '|' || substr(text, 1, 256)) AS chunk_id FROM documents) SELECT doc_id, chunk_id, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY doc_id) - 1 AS INT) AS occurrence FROM h")
def id_dedup(t: Tables) -> DataFrame:
    h = t.documents.select("doc_id", T.chunk_id(F.lit("src"), F.col("source"), F.substring("text", 1, 256)).alias("chunk_id"))
    return D.occurrence(h, ["chunk_id"], [F.col("doc_id")])


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE 0 END DESC, event_id) AS n FROM events) WHERE n = 1")
def precedence_dedup(t: Tables) -> DataFrame:
    e = F.col("event_type")
    rank = F.when(e == "purchase", 3).when(e == "signup", 2).when(e == "click", 1).otherwise(0)
    return D.precedence(t.events, ["user_id"], rank, [F.col("event_id")]).select("user_id", "event_id", "event_type")


@query("""WITH r AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 2 WHEN 'error' THEN 2 ELSE 1 END AS rank, event_id, event_type FROM events), b AS (SELECT user_id, max(rank) AS rank FROM r GROUP BY user_id)
SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id, count(DISTINCT event_type) > 1 AS contradicts FROM r JOIN b USING (user_id, rank) GROUP BY user_id""")
def source_precedence(t: Tables) -> DataFrame:
    """Live rows before dumped ones, the later among equals; contradictions among the chosen source's rows are marked."""
    rank = F.when(F.col("event_type").isin("purchase", "error"), 2).otherwise(1)
    return D.by_source(t.events.select("user_id", "event_id", "event_type"), "user_id", rank, [F.col("event_id")], "event_type").select("user_id", "event_type", "event_id", "contradicts")


@query("WITH old AS (SELECT o_orderkey AS k, o_orderkey + 1000000 AS id FROM orders WHERE o_orderkey % 3 = 0) SELECT l_orderkey, l_linenumber, coalesce(id, l_orderkey) AS order_id, id IS NOT NULL AS remapped FROM lineitem LEFT JOIN old ON l_orderkey = k")
def id_remap(t: Tables) -> DataFrame:
    old = t.orders.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") + 1000000).alias("id"))
    return t.lineitem.join(old, "l_orderkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("id", "l_orderkey").alias("order_id"), F.col("id").isNotNull().alias("remapped"))


@query("""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE source || (doc_id % 50) END AS uid, CASE WHEN doc_id % 8 = 0 THEN '' ELSE lang END AS lang FROM documents), y AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY doc_id) > 1 AND uid IS NOT NULL AS again FROM x)
SELECT doc_id, list_filter([CASE WHEN uid IS NULL THEN 'uid' END, CASE WHEN NOT lang IN ('en', 'de', 'fr', 'es') THEN 'lang' END, CASE WHEN again THEN 'duplicate' END], lambda e: e IS NOT NULL) AS errors FROM y""")
def manifest_errors(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    x = t.documents.select("doc_id", F.when(i % 9 != 0, F.concat("source", (i % 50).cast("string"))).alias("uid"), F.when(i % 8 == 0, "").otherwise(F.col("lang")).alias("lang"))
    return D.validate(x, {"uid": F.col("uid").isNotNull(), "lang": F.col("lang").isin("en", "de", "fr", "es")}, "uid", [i]).select("doc_id", "errors")


@query("SELECT o_custkey, max(o_orderdate) AS newest, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_key, count(*) AS versions FROM orders GROUP BY o_custkey")
def latest_version(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("newest"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_key"), F.count("*").alias("versions"))


@query("""WITH k AS (SELECT p_brand, p_type, p_size, min(p_partkey) AS found FROM part WHERE p_partkey % 3 > 0 GROUP BY ALL HAVING count(*) = 1) SELECT p.p_partkey, CASE WHEN p.p_partkey % 2 = 0 THEN p.p_partkey ELSE found END AS link FROM part p LEFT JOIN k USING (p_brand, p_type, p_size)""")
def unique_key_backfill(t: Tables) -> DataFrame:
    """Missing links filled from the rows of equal key, where that key has exactly one."""
    key = ["p_brand", "p_type", "p_size"]
    unique = t.part.filter("p_partkey % 3 > 0").groupBy(*key).agg(F.min("p_partkey").alias("found"), F.count("*").alias("n")).filter("n = 1").drop("n")
    return t.part.join(unique, key, "left").select("p_partkey", F.coalesce(F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey")), F.col("found")).alias("link"))


@query("""WITH p AS (SELECT lang AS name, doc_id >> 16 AS part, count(*) AS n, min(doc_id) AS lo, max(doc_id) AS hi, md5(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY doc_id)) AS mark FROM documents GROUP BY 1, 2)
SELECT name, CAST(sum(n) AS BIGINT) AS n, min(lo) AS lo, max(hi) AS hi, md5(string_agg(part || ':' || n || ':' || mark, chr(10) ORDER BY part)) AS mark FROM p GROUP BY name""")
def corpus_fingerprint(t: Tables) -> DataFrame:
    """The documents of each language."""
    return D.snapshot(t.documents.select(F.col("lang").alias("name"), F.col("doc_id").cast("long").alias("id"), F.lit(None).cast("boolean").alias("filled"))).drop("vectors")


@query("""WITH ids AS (SELECT 'documents' AS name, doc_id AS id, CAST(NULL AS BOOLEAN) AS filled FROM documents UNION ALL SELECT 'embeddings', vec_id, embedding IS NOT NULL FROM embeddings),
p AS (SELECT name, id >> 16 AS part, count(*) AS n, min(id) AS lo, max(id) AS hi, sum(CAST(filled AS BIGINT)) AS vectors, md5(string_agg(CAST(id AS VARCHAR), chr(10) ORDER BY id)) AS mark FROM ids GROUP BY 1, 2)
SELECT name, CAST(sum(n) AS BIGINT) AS n, min(lo) AS lo, max(hi) AS hi, CAST(sum(vectors) AS BIGINT) AS vectors, md5(string_agg(part || ':' || n || ':' || mark, chr(10) ORDER BY part)) AS mark FROM p GROUP BY name""")
def corpus_snapshot(t: Tables) -> DataFrame:
    documents = t.documents.select(F.lit("documents").alias("name"), F.col("doc_id").cast("long").alias("id"), F.lit(None).cast("boolean").alias("filled"))
    return D.snapshot(documents.unionByName(t.embeddings.select(F.lit("embeddings").alias("name"), F.col("vec_id").cast("long").alias("id"), F.col("embedding").isNotNull().alias("filled"))))


@query("WITH a AS (SELECT sha256(text) AS s, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), b AS (SELECT sha256(text) AS s, count(*) AS n FROM documents WHERE doc_id % 2 = 1 GROUP BY 1) SELECT CAST(sum(coalesce(a.n, 0)) AS BIGINT) AS n_left, CAST(sum(coalesce(b.n, 0)) AS BIGINT) AS n_right, CAST(sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) AS BIGINT) AS shared, round(sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) / sum(coalesce(a.n, 0)), 6) AS coverage FROM a FULL OUTER JOIN b USING (s)")
def text_overlap(t: Tables) -> DataFrame:
    def side(r: int, n: str) -> DataFrame:
        return t.documents.filter(F.col("doc_id") % 2 == r).groupBy(F.sha2("text", 256).alias("s")).agg(F.count("*").alias(n))

    both = side(0, "a").join(side(1, "b"), "s", "full_outer").na.fill(0)
    shared = F.sum(F.least("a", "b"))
    return both.agg(F.sum("a").alias("n_left"), F.sum("b").alias("n_right"), shared.alias("shared"), F.round(shared / F.sum("a"), 6).alias("coverage"))


@query("SELECT d.doc_id, list_filter([CASE WHEN l.doc_id IS NULL THEN 'labels' END, CASE WHEN b.item_id IS NULL THEN 'benchmark' END], lambda e: e IS NOT NULL) AS missing FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def layer_completeness(t: Tables) -> DataFrame:
    l, b = t.labels.select("doc_id", F.lit(1).alias("l")), t.benchmark.select(F.col("item_id").alias("doc_id"), F.lit(1).alias("b"))  # noqa: E741
    return t.documents.select("doc_id").join(l, "doc_id", "left").join(b, "doc_id", "left").select("doc_id", F.array_compact(F.array(F.when(F.col("l").isNull(), "labels"), F.when(F.col("b").isNull(), "benchmark"))).alias("missing"))


@query("WITH a AS (SELECT c_custkey AS k, c_nationkey AS n, c_acctbal AS v FROM customer), b AS (SELECT s_suppkey AS k, s_nationkey AS n, s_acctbal AS v FROM supplier) SELECT k, a.n IS DISTINCT FROM b.n AS nation_differs, a.v IS DISTINCT FROM b.v AS balance_differs FROM a JOIN b USING (k) WHERE a.n IS DISTINCT FROM b.n OR a.v IS DISTINCT FROM b.v")
def row_mismatch(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n1"), F.col("c_acctbal").alias("v1"))
    b = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n2"), F.col("s_acctbal").alias("v2"))
    return a.join(b, "k").select("k", (~F.col("n1").eqNullSafe(F.col("n2"))).alias("nation_differs"), (~F.col("v1").eqNullSafe(F.col("v2"))).alias("balance_differs")).filter("nation_differs or balance_differs")
