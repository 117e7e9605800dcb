"""Payload and manifest queries: image notes, citations, page batches, tables of contents, manifest rows, checksum plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import manifest as M
from weftline.operators import payloads as P
from weftline.plans.common import Tables, query


@query("SELECT doc_id, md5(replace(replace('![fig](img-' || doc_id % 4 || ') ' || text || ' ![](img-1) ![z]( img-2 )', '![fig](img-0)', ''), '![](img-1)', '[Illustration — a plan]').replace('![fig](img-1)', '[Illustration — a plan]')) AS digest FROM documents WHERE text IS NOT NULL")
def image_annotations(t: Tables) -> DataFrame:
    note = lambda image, kind, said: (F.lit(image), F.struct(F.lit(kind).alias("kind"), F.lit(said).cast("string").alias("description")))
    notes = F.create_map(*note("img-0", "decorative", None), *note("img-1", "informative", "a plan"), *note("img-2", "informative", None))
    docs = t.documents.filter("text is not null").withColumn("marked", F.concat(F.lit("![fig](img-"), F.col("doc_id") % 4, F.lit(") "), "text", F.lit(" ![](img-1) ![z]( img-2 )")))
    return docs.select("doc_id", F.md5(P.annotate_images(F.col("marked"), notes)).alias("digest"))


@query("WITH h AS (SELECT item_id, p, (item_id * p) % 4 AS key FROM benchmark, range(1, 7) r(p)), f AS (SELECT item_id, key, min(p) AS first FROM h GROUP BY ALL), s AS (SELECT item_id, key, row_number() OVER (PARTITION BY item_id ORDER BY first) AS n FROM f), m AS (SELECT item_id, p, n FROM h JOIN s USING (item_id, key)) SELECT item_id AS answer_id, 'see [' || max(n) FILTER (p = 1) || '], then [' || max(n) FILTER (p = 4) || '] and [' || max(n) FILTER (p = 3) || '][' || max(n) FILTER (p = 6) || ']; not [9] nor [x]' AS answer, max(n) AS n_sources FROM m GROUP BY item_id")
def citation_renumbering(t: Tables) -> DataFrame:
    items = t.benchmark.select(F.col("item_id").alias("answer_id"))
    hits = items.withColumn("position", F.explode(F.sequence(F.lit(1), F.lit(6)))).withColumn("key", F.col("answer_id") * F.col("position") % 4)
    answers = items.withColumn("answer", F.lit("see [1], then [04] and [3][6]; not [9] nor [x]"))
    return P.renumber_citations(answers, hits).withColumn("n_sources", F.col("n_sources").cast("long"))


def _batches(t: Tables) -> DataFrame:
    c = t.conversations
    page = F.struct(F.col("turn").cast("int").alias("index"), F.concat(F.lit("![a](im0) im1 "), F.coalesce("text", F.lit(""))).alias("markdown"), F.array(F.lit("im0"), F.lit(" im1 "), F.lit("")).alias("images"))
    return c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("batch"), F.array(page).alias("pages"), F.lit(1).alias("pages_processed"), F.length("text").alias("doc_size_bytes"))


@query("SELECT conv_id AS document_id, turn AS batch, md5(replace(replace('![a](im0) im1 ' || coalesce(text, ''), 'im0', printf('page-%04d-im0', turn)), 'im1', printf('page-%04d-im1', turn))) AS digest, printf('page-%04d-im0', turn) AS image FROM conversations")
def page_batches(t: Tables) -> DataFrame:
    return P.batch_pages(_batches(t)).select("document_id", "batch", F.md5("markdown").alias("digest"), F.get("images", F.lit(0)).alias("image"))


@query("SELECT conv_id AS document_id, count(*) AS n_pages, count(*) AS pages_processed, max(coalesce(length(text), 0)) AS doc_size_bytes FROM conversations GROUP BY conv_id")
def page_batch_totals(t: Tables) -> DataFrame:
    return P.batch_totals(_batches(t))


@query("WITH n AS (SELECT l_orderkey AS payload_id, l_linenumber AS num, 'LEGIARTI' || l_partkey || '-' || l_linenumber AS id, 'LEGIARTI' || l_suppkey % 3 AS cid, CASE WHEN l_linestatus = 'O' THEN 'Vigueur' ELSE 'ABROGE' END AS state FROM lineitem), o AS (SELECT *, row_number() OVER (PARTITION BY payload_id ORDER BY num, id, cid, state) AS i FROM n), g AS (SELECT payload_id, cid, coalesce(min(i) FILTER (state = 'Vigueur'), max(i)) AS i, list(DISTINCT id) AS ids FROM o GROUP BY payload_id, cid) SELECT payload_id, cid, state, num::VARCHAR AS number, id AS version_id, array_to_string(list_sort(list_append(ids, cid)), ',') AS aliases FROM g JOIN o USING (payload_id, cid, i)")
def contents_articles(t: Tables) -> DataFrame:
    node = F.struct(F.col("l_linenumber").alias("num"), F.concat(F.lit("LEGIARTI"), "l_partkey", F.lit("-"), "l_linenumber").alias("id"), F.concat(F.lit("LEGIARTI"), F.col("l_suppkey") % 3).alias("cid"), F.when(F.col("l_linestatus") == "O", "Vigueur").otherwise("ABROGE").alias("etat"))
    # Lines of an order are seldom neighbours: lists are collected once these have met, not before the shuffle as well.
    lines = t.lineitem.select(F.col("l_orderkey").alias("payload_id"), node.alias("node")).repartition("payload_id")
    nodes = lines.groupBy("payload_id").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    tree = F.struct(F.struct(F.slice("nodes", 1, 2).alias("articles")).alias("section"), F.slice("nodes", F.lit(3), F.greatest(F.size("nodes") - 2, F.lit(0))).alias("articles"))
    found = P.contents_articles(nodes.select("payload_id", F.to_json(tree).alias("payload")))
    return found.withColumn("aliases", F.array_join("aliases", ","))


@query("WITH r AS (SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN '' WHEN doc_id % 2 = 0 THEN 'U' || doc_id // 3 ELSE 'u' || doc_id // 3 END AS uid, doc_id % 7 = 0 AS untitled, doc_id % 23 = 0 AS unstored, CASE WHEN doc_id % 5 = 0 THEN 'repealed' WHEN doc_id % 17 = 0 THEN NULL ELSE 'in_force' END AS status FROM documents WHERE doc_id % 11 > 0), w AS (SELECT upper(uid) AS k, min(doc_id) AS winner FROM r WHERE uid <> '' AND NOT untitled AND NOT unstored AND status IS NOT NULL GROUP BY 1) SELECT doc_id AS record_id, uid, status, concat_ws(',', CASE WHEN uid = '' THEN 'uid_empty' END, CASE WHEN winner < doc_id THEN 'uid_duplicate' END, CASE WHEN untitled THEN 'title_empty' END, CASE WHEN unstored THEN 'storage_key_empty' END, CASE WHEN status IS NULL THEN 'repealed_invalid' END) AS errors FROM r LEFT JOIN w ON upper(uid) = k")
def manifest_validation(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    third = F.floor(i / 3).cast("string")
    records = t.documents.select(
        i.alias("record_id"),
        F.when(i % 11 > 0, " Main").otherwise("other").alias("source_corpus"),
        F.when(i % 19 == 0, " ").when(i % 2 == 0, F.concat(F.lit("U"), third)).otherwise(F.concat(F.lit("u"), third)).alias("uid"),
        F.when(i % 7 > 0, "a title").alias("title"),
        F.when(i % 23 > 0, "key").otherwise("").alias("storage_key"),
        F.when(i % 5 == 0, "Oui").when(i % 17 == 0, "perhaps").when(i % 2 == 0, "non").alias("repealed"),
    )
    return M.manifest_rows(records, "main").withColumn("errors", F.array_join("errors", ","))


@query("WITH e AS (SELECT doc_id AS uid, doc_id % 5 > 0 AS listed, doc_id % 10 = 0 AS safe, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE md5(text) END AS new FROM documents WHERE doc_id % 15 > 0), c AS (SELECT doc_id AS uid, md5(text || CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE '' END) AS old, doc_id % 13 AS n, doc_id % 8 > 0 AS complete FROM documents WHERE doc_id % 4 > 0 OR doc_id % 5 = 0), p AS (SELECT uid, CASE WHEN listed THEN CASE WHEN new = old AND n > 0 AND complete THEN 'unchanged' ELSE 'ingest' END WHEN c.uid IS NOT NULL AND NOT coalesce(safe, false) THEN 'delete' END AS action FROM e FULL OUTER JOIN c USING (uid)) SELECT * FROM p WHERE action IS NOT NULL")
def checksum_plan(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    expected = t.documents.filter(i % 15 > 0).select(i.alias("uid"), (i % 5 > 0).alias("listed"), (i % 10 == 0).alias("protected"), F.when(i % 7 != 0, F.md5("text")).alias("checksum"))
    current = t.documents.filter((i % 4 > 0) | (i % 5 == 0)).select(i.alias("uid"), F.md5(F.concat("text", F.when(i % 3 == 0, "x").otherwise(""))).alias("checksum"), (i % 13).alias("n_chunks"), (i % 8 > 0).alias("complete"))
    return M.checksum_plan(expected, current)
