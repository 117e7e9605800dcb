"""Corpus queries: text functions, chunking, markup, references, personal data, clustering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import refs as R
from weftline.functions import text as T
from weftline.operators import chunking as C
from weftline.operators.clustering import Clusters
from weftline.plans.common import Tables, query
from weftline.sources import markup as P

_FOLD = "array_to_string(regexp_extract_all(lower(translate({0}, 'àâäáãåçéèêëíìîïñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY')), '[a-z0-9]+'), ' ')"


@query(f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS s, text FROM documents)
SELECT doc_id, md5({_FOLD.format("s")}) AS folded, CAST(floor(length(text) / 4.2) AS BIGINT) AS tokens, CASE WHEN length(text) > 60 THEN rtrim(substr(text, 1, 59)) || '…' ELSE text END AS preview,
  CASE WHEN length(s) <= 40 THEN s ELSE substr(s, 1, 31) || '_' || substr(sha1(s), 1, 8) END AS bounded, upper(source) AS match_key, sha256(text) AS digest FROM d""")
def text_functions(t: Tables) -> DataFrame:
    s = F.coalesce("text", F.lit(""))
    return t.documents.select("doc_id", F.md5(T.fold(s)).alias("folded"), T.token_estimate(F.col("text"), 4.2).alias("tokens"), T.preview(F.col("text"), 60).alias("preview"), T.bounded_id(s, 40).alias("bounded"), T.match_key(F.col("source")).alias("match_key"), F.sha2("text", 256).alias("digest"))


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS s FROM documents)
SELECT doc_id, {_FOLD.format("s")} AS folded, CASE WHEN length(s) <= 40 THEN s ELSE substr(s, 1, 31) || '_' || substr(sha1(s), 1, 8) END AS bounded FROM d""")
def text_functions_whole(t: Tables) -> DataFrame:
    s = F.coalesce("text", F.lit(""))
    return t.documents.select("doc_id", T.fold(s).alias("folded"), T.bounded_id(s, 40).alias("bounded"))


@query("""WITH k AS (SELECT doc_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(source || '/' || doc_id)) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || CASE WHEN substr(h, 17, 1) IN ('0','4','8','c') THEN '8' WHEN substr(h, 17, 1) IN ('1','5','9','d') THEN '9' WHEN substr(h, 17, 1) IN ('2','6','a','e') THEN 'a' ELSE 'b' END || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM k""")
def stable_ids(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.uuid5("6ba7b811-9dad-11d1-80b4-00c04fd430c8", F.concat_ws("/", "source", F.col("doc_id").cast("string"))).alias("uuid"))


@query("SELECT a.item_id, b.item_id AS other, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS jaccard FROM (SELECT item_id, list_distinct(string_split(lower(trim(text)), ' ')) AS w FROM benchmark) a JOIN (SELECT item_id, list_distinct(string_split(lower(trim(text)), ' ')) AS w FROM benchmark) b ON b.item_id = a.item_id + 1")
def token_jaccard(t: Tables) -> DataFrame:
    w = t.benchmark.select("item_id", F.array_distinct(F.split(F.lower(F.trim("text")), " ")).alias("w"))
    b = w.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("other"), F.col("w").alias("v"))
    return w.join(b, "item_id").select("item_id", "other", F.round(T.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"))


@query("SELECT doc_id, CAST(i // 400 AS INT) AS chunk_index, substr(text, i + 1, 500) AS chunk FROM (SELECT doc_id, text, unnest(range(0, length(text), 400)) AS i FROM documents)")
def fixed_window_chunks(t: Tables) -> DataFrame:
    return C.fixed_windows(t.documents.select("doc_id", "text"), F.col("text"), 500, 100).select("doc_id", "chunk_index", "chunk")


@query()
def paragraph_chunks(t: Tables) -> DataFrame:
    return C.paragraph_chunks(t.documents)


@query()
def legal_chunks(t: Tables) -> DataFrame:
    return C.split_legal(t.documents)


@query()
def qa_chunks(t: Tables) -> DataFrame:
    return C.split_qa(t.documents)


@query()
def section_split(t: Tables) -> DataFrame:
    pages = P.page_text(t.pages)
    return C.split_sections(pages.select(F.col("page_id").alias("doc_id"), F.col("markdown").alias("text")))


@query()
def section_summary(t: Tables) -> DataFrame:
    s = section_split(t).withColumn("tokens", T.token_estimate(F.col("body")))
    return s.groupBy("level").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.floor(F.sum("tokens") / F.count("*")).alias("mean_tokens"), F.count_if("is_indexable").alias("indexable"))


@query("""WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT source, count(DISTINCT doc_id) AS total FROM documents WHERE text IS NOT NULL GROUP BY source), c AS (SELECT source, line, count(DISTINCT doc_id) AS n_docs FROM l WHERE trim(line) <> '' AND length(line) <= 80 GROUP BY ALL)
SELECT source, line, n_docs, greatest(2, CAST(ceil(0.04 * total) AS BIGINT)) AS needed FROM c JOIN n USING (source) WHERE n_docs >= greatest(2, ceil(0.04 * total))""")
def boilerplate_lines(t: Tables) -> DataFrame:
    lines = C.line_table(t.documents.filter(F.col("text").isNotNull()).select("doc_id", "source", "text"), F.col("text"))
    return C.boilerplate(lines, "source", "doc_id", 0.04, 2).withColumn("needed", F.col("needed").cast("long"))


@query()
def page_text(t: Tables) -> DataFrame:
    return P.page_text(t.pages)


@query("""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS n_paragraphs, CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS n_links FROM pages""")
def page_metadata(t: Tables) -> DataFrame:
    return P.page_metadata(t.pages)


@query("""WITH x AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS a FROM pages), y AS (SELECT page_id, h, a, unnest(range(1, len(h) + 1)) AS i FROM x)
SELECT page_id, h[i] AS href, CAST(min(i) - 1 AS INT) AS position, arg_min(a[i], i) AS anchor FROM y GROUP BY page_id, h[i]""")
def page_links(t: Tables) -> DataFrame:
    return P.page_links(t.pages)


@query(r"""WITH x AS (SELECT page_id, regexp_extract(url, '^https://([^/?#@:]+)(?:/[^?#@]*)?$', 1) AS host FROM pages) SELECT page_id, host <> '' AND host IN (SELECT host FROM x WHERE page_id % 2 = 0 AND host LIKE '%example.com') AS allowed FROM x""")
def url_allow_list(t: Tables) -> DataFrame:
    host = F.regexp_extract("url", "^https://([^/?#@:]+)(?:/[^?#@]*)?$", 1)
    hosts = t.pages.filter("page_id % 2 = 0").select(host.alias("host")).filter("host like '%example.com'").distinct().withColumn("listed", F.lit(True))
    return t.pages.withColumn("host", host).join(hosts, "host", "left").select("page_id", ((F.col("host") != "") & F.coalesce("listed", F.lit(False))).alias("allowed"))


_REF = "SELECT doc_id, 'Article ' || CASE doc_id % 4 WHEN 0 THEN 'L' WHEN 1 THEN 'R.' WHEN 2 THEN 'D ' ELSE 'A' END || (100 + doc_id) || '-' || (doc_id % 9) || ' et décret n° ' || (80 + doc_id % 20) || '/' || doc_id || ' du code; article L' || (100 + doc_id) || '-1 ' || coalesce(text, '') AS ref FROM documents"


@query(rf"""WITH r AS ({_REF}) SELECT doc_id, list_sort(list_distinct(list_transform(range(1, len(regexp_extract_all(ref, '(?i)\b([LRDA])\.?\s?(\d{{2,4}}(?:-\d+)*)', 1)) + 1), lambda i: upper(regexp_extract_all(ref, '(?i)\b([LRDA])\.?\s?(\d{{2,4}}(?:-\d+)*)', 1)[i]) || regexp_extract_all(ref, '(?i)\b([LRDA])\.?\s?(\d{{2,4}}(?:-\d+)*)', 2)[i]))) AS articles,
list_sort(list_distinct(list_transform(regexp_extract_all(ref, '(?i)d[ée]cret\s+(?:n°\s?)?(\d{{2,4}}[-/]\d+)', 1), lambda x: replace(x, '/', '-')))) AS decrees,
CASE WHEN contains(upper(translate(ref, 'éèêÉÈÊ', 'eeeEEE')), 'ARRETE') THEN 'ARRETE' ELSE 'DECRET' END AS category FROM r""")
def ref_extract(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    letter = F.when(i % 4 == 0, "L").when(i % 4 == 1, "R.").when(i % 4 == 2, "D ").otherwise("A")
    s = lambda c: c.cast("string")
    ref = F.concat(F.lit("Article "), letter, s(100 + i), F.lit("-"), s(i % 9), F.lit(" et décret n° "), s(80 + i % 20), F.lit("/"), s(i), F.lit(" du code; article L"), s(100 + i), F.lit("-1 "), F.coalesce("text", F.lit("")))
    return t.documents.select("doc_id", R.article_mentions(ref).alias("articles"), R.decree_mentions(ref).alias("decrees"), R.category(ref).alias("category"))


@query("SELECT doc_id, list_transform(range(doc_id % 20, doc_id % 20 + doc_id % 5 + 1), lambda i: '12-' || i) AS numbers FROM documents")
def number_ranges(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    a, b = F.concat(F.lit("12-"), (i % 20).cast("string")), F.concat(F.lit("12-"), (i % 20 + i % 5).cast("string"))
    return t.documents.select("doc_id", R.number_range(a, b).alias("numbers"))


_PII = {"email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "ipv4": r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b", "long_number": r"\b[0-9]{13,19}\b", "phone": r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}"}


@query("SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}' END" for n, p in _PII.items()) + "], lambda x: x IS NOT NULL) AS found FROM documents")
def pii_scan(t: Tables) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return t.documents.select("doc_id", F.array_compact(F.array(*[F.when(text.rlike(T.ascii_bounds(p)), F.lit(n)) for n, p in _PII.items()])).alias("found"))


@query(r"""WITH p AS (SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')
SELECT conv_id, turn, CAST(len(list_filter(list_distinct(regexp_extract_all(answer, '\d+')), lambda x: NOT list_contains(regexp_extract_all(question, '\d+'), x))) AS INT) AS unsourced, length(answer) >= 80 AND len(list_filter(list_distinct(regexp_extract_all(answer, '\d+')), lambda x: NOT list_contains(regexp_extract_all(question, '\d+'), x))) = 0 AS accepted FROM p""")
def number_gate(t: Tables) -> DataFrame:
    a = t.conversations.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    b = t.conversations.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    extra = F.size(F.array_except(R.numbers(F.col("answer")), R.numbers(F.col("question"))))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", extra.alias("unsourced"), ((F.length("answer") >= 80) & (extra == 0)).alias("accepted"))


@query()
def number_words_gate(t: Tables) -> DataFrame:
    """Answers, with a number in figures at the end, against questions that say it in words."""
    from weftline.functions import numbers as N

    phrase = F.element_at(F.array(*[F.lit(x) for x in ("quatre-vingt-dix-sept mille", "deux cent trois", "soixante et onze")]), (F.col("conv_id") % 3 + 1).cast("int"))
    value = F.element_at(F.array(F.lit(97_000), F.lit(203), F.lit(71)), (F.col("conv_id") % 3 + 1).cast("int")) + F.col("turn") % 4
    text = F.coalesce("text", F.lit(""))
    a = t.conversations.filter("role = 'user'").select("conv_id", "turn", F.concat(text, F.lit(" . "), phrase).alias("question"))
    b = t.conversations.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), text.alias("said"))
    pairs = a.join(b, ["conv_id", "turn"]).withColumn("answer", F.concat("said", F.lit(" soit "), value.cast("string")))
    return pairs.withColumn("unsourced", N.unsourced(F.col("answer"), F.col("question"))).select("conv_id", "turn", "unsourced", ((F.length("answer") >= 80) & (F.size("unsourced") == 0)).alias("accepted"))


@query("SELECT doc_id, length(text) BETWEEN 40 AND 1400 AND (contains(text, '|') OR contains(text, '→') OR (len(regexp_extract_all(text, '(?m)^[-*•]')) >= 3 AND regexp_matches(text, '(?m)^[^a-z]*\\bOU\\b[^a-z]*$'))) AS risky FROM documents")
def risk_pages(t: Tables) -> DataFrame:
    x = F.col("text")
    listy = (F.regexp_count(x, F.lit("(?dm)^[-*•]")) >= 3) & x.rlike(T.ascii_bounds(r"(?dm)^[^a-z]*\bOU\b[^a-z]*$"))
    return t.documents.select("doc_id", (F.length(x).between(40, 1400) & (x.contains("|") | x.contains("→") | listy)).alias("risky"))


def _grams(t: Tables) -> DataFrame:
    """doc_id, grams: words and pairs of neighbouring words."""
    words = t.documents.select("doc_id", T.words(F.coalesce("text", F.lit(""))).alias("w"))
    rest = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("w", F.lit(1), rest), F.slice("w", F.lit(2), rest), lambda a, b: F.concat_ws(" ", a, b))
    return words.select("doc_id", F.concat("w", pairs).alias("grams"))


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def _clusters(t: Tables, buckets: int = 1 << 20) -> Clusters:
    """Four clusters by buckets of grams, those in two documents at least and nine tenths at most.

    No gram is dropped for want of room: grams are hashed to ``buckets``, which bounds the vocabulary and the centres on the
    driver; grams that share a bucket count as one.
    """
    return Clusters(_grams(t).select("doc_id", F.transform("grams", lambda g: _bucket(g, buckets)).alias("buckets")), buckets, k=4, seed=7)


@query()
def tfidf_kmeans(t: Tables) -> DataFrame:
    """doc_id, cluster by TF-IDF of words and word pairs."""
    return _clusters(t).assigned()


@query()
def cluster_terms(t: Tables, buckets: int = 1 << 20) -> DataFrame:
    """cluster, rank, term: the ten heaviest buckets of each centre by their most frequent grams."""
    from weftline.operators.ranking import first_by

    found = _clusters(t, buckets)
    rows = [(c, k + 1, int(found.vocabulary[i])) for c, centre in enumerate(found.centres) for k, i in enumerate((-centre[found.vocabulary]).argsort(kind="stable")[:10])]
    heavy = t.documents.sparkSession.createDataFrame(rows, "cluster int, rank int, bucket int")
    mine = sorted({b for _, _, b in rows})
    grams = _grams(t).select(F.explode(F.filter("grams", lambda g: _bucket(g, buckets).isin(mine))).alias("term")).withColumn("bucket", _bucket(F.col("term"), buckets))
    counts = grams.groupBy("bucket", "term").agg(F.count("*").alias("n"))
    return heavy.join(first_by(counts, ["bucket"], [-F.col("n"), F.col("term")]), "bucket").select("cluster", "rank", "term")


@query()
def section_table_chunks(t: Tables) -> DataFrame:
    return C.split_section_tables(t.documents)


@query("""WITH c AS (SELECT DISTINCT l_suppkey * 20 + l_linenumber AS section_id FROM lineitem WHERE l_linenumber % 3 = 0) SELECT p_partkey AS section_id FROM part WHERE p_partkey NOT IN (SELECT section_id FROM c) AND p_size > 10 AND trim(p_name) <> ''""")
def uncovered_sections(t: Tables) -> DataFrame:
    chunks = t.lineitem.select(F.when(F.col("l_linenumber") % 3 == 0, F.col("l_suppkey") * 20 + F.col("l_linenumber")).alias("section_id"))
    sections = t.part.select(F.col("p_partkey").alias("section_id"), (F.col("p_size") > 10).alias("is_indexable"), F.col("p_name").alias("body"))
    return C.uncovered_sections(sections, chunks).select("section_id")


@query("""WITH RECURSIVE s AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, CAST(o_orderkey % 5 + 1 AS INT) AS level, o_orderpriority AS heading FROM orders),
p AS (SELECT a.doc_id, a.i, max(b.i) AS parent FROM s a LEFT JOIN s b ON a.doc_id = b.doc_id AND b.i < a.i AND b.level < a.level GROUP BY a.doc_id, a.i), d AS (SELECT doc_id, i, 0 AS depth FROM p WHERE parent IS NULL UNION ALL SELECT p.doc_id, p.i, depth + 1 FROM d JOIN p ON p.doc_id = d.doc_id AND p.parent = d.i)
SELECT doc_id, i AS section_index, depth, repeat('  ', depth) || '- ' || heading AS line FROM d JOIN s USING (doc_id, i)""")
def section_tree(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return C.section_tree(t.orders.select(F.col("o_custkey").alias("doc_id"), i.cast("long").alias("section_index"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("level"), F.col("o_orderpriority").alias("heading")))


@query("""WITH s AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS section_index, CAST(o_orderkey % 5 + 1 AS INT) AS level FROM orders)
SELECT a.doc_id, a.section_index, a.level, min(b.section_index) FILTER (b.level <= a.level) AS section_end, min(b.section_index) AS own_end FROM s a LEFT JOIN s b ON a.doc_id = b.doc_id AND b.section_index > a.section_index GROUP BY a.doc_id, a.section_index, a.level""")
def section_ends(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return C.section_ends(t.orders.select(F.col("o_custkey").alias("doc_id"), i.cast("long").alias("section_index"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("level")))


@query()
def chunk_similarity(t: Tables) -> DataFrame:
    """Answers and questions of a conversation, compared turn by turn."""
    side = lambda role: t.conversations.filter(F.col("role") == role).select(F.col("conv_id").alias("doc_id"), F.floor(F.col("turn") / 2).alias("position"), F.col("text"))
    return C.positional_similarity(side("user"), side("assistant"))


@query(r"""SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN ' ' WHEN doc_id % 3 = 1 THEN ' x ' END), ''), nullif(trim(source), '')) AS name, trim(regexp_replace(lower(translate(source || ' é ' || lang, 'é', 'e')), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CASE WHEN doc_id % 4 = 0 THEN 'unknown' ELSE lang || '_x' END AS env FROM documents""")
def text_tools(t: Tables) -> DataFrame:
    from weftline.operators.observe import env_label

    k = F.col("doc_id")
    first = T.first_filled(F.when(k % 3 == 0, " ").when(k % 3 == 1, " x "), F.col("source"))
    env = F.when(k % 4 > 0, F.concat(F.lit(" "), F.upper("lang"), F.lit("  X")))
    return t.documents.select("doc_id", first.alias("name"), T.slug(F.concat("source", F.lit(" é "), "lang")).alias("slug"), env_label(env).alias("env"))


@query("""SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.8f', CAST(x AS DOUBLE))), ',') || ']' AS literal FROM embeddings""")
def vector_literal(t: Tables) -> DataFrame:
    from weftline.operators.vectors import literal

    return t.embeddings.select("vec_id", literal(F.col("embedding")).alias("literal"))


_PAGES = """l AS (SELECT doc_id, source, trim(line) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL)),
p AS (SELECT doc_id, i // 6 AS page_no, list(line ORDER BY i) AS body, any_value(source) AS source FROM l GROUP BY 1, 2), g AS (SELECT doc_id, page_no, list_filter(list_concat(CASE WHEN page_no % 3 < 2 THEN ['— ' || source || ' —'] ELSE [] END, body, ['Page ' || page_no, 'fin de page']), lambda x: x <> '') AS lines FROM p)"""


def _paged(t: Tables) -> DataFrame:
    """Whole texts in pages of six lines, two of three with a header, all with a number and a footer."""
    lines = t.documents.filter("text is not null").select("doc_id", "source", F.split("text", "\n").alias("x"))
    pages = lines.select("doc_id", "source", "x", F.explode(F.sequence(F.lit(0), F.floor((F.size("x") - 1) / 6).cast("int"))).alias("page_no"))
    body = F.array_join(F.slice("x", F.col("page_no") * 6 + 1, F.lit(6)), "\n")
    head = F.when(F.col("page_no") % 3 < 2, F.concat(F.lit("— "), "source", F.lit(" —\n"))).otherwise("")
    return pages.select("doc_id", "page_no", F.concat(head, body, F.lit("\nPage "), F.col("page_no").cast("string"), F.lit("\n\nfin de page")).alias("text"))


@query(f"""WITH {_PAGES}, e AS (SELECT doc_id, unnest(list_distinct(list_concat(lines[1:3], lines[greatest(len(lines) - 2, 1):]))) AS line FROM g), c AS (SELECT doc_id, line, count(*) AS n_pages FROM e WHERE length(line) BETWEEN 3 AND 100 AND line[1] NOT IN ('#', '|') GROUP BY ALL),
n AS (SELECT doc_id, greatest(3, CAST(ceil(count(*) * 0.4) AS BIGINT)) AS needed FROM g GROUP BY doc_id) SELECT doc_id, line, n_pages, needed FROM c JOIN n USING (doc_id) WHERE n_pages >= needed""")
def page_edge_lines(t: Tables) -> DataFrame:
    """Headers and footers of documents: on .4 of their pages, at least three."""
    return C.page_edges(_paged(t))
