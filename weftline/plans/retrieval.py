"""Retrieval: top-k lanes, fusion, aggregation, selection, context. Queries are the rows whose id is divisible by 20."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import context, fusion, lexical, linking, patterns, vectors
from weftline.plans.common import Tables, query

_Q = "q AS (SELECT vec_id AS query_id, embedding AS qe, label AS q_label FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, q_label, e.vec_id AS id, e.label AS label, round(list_cosine_similarity(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM q, embeddings e)"


def _top(k: int, by: str = "query_id") -> str:
    return f"{_Q}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= {k})"


def vec_queries(t: Tables) -> DataFrame:
    return t.embeddings.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("q_label"))


def top(t: Tables, k: int) -> DataFrame:
    """query_id, id, score, rank with the labels of both."""
    found = vectors.vector_topk(t.embeddings, vec_queries(t), k).drop("group")
    return found.join(t.embeddings.select(F.col("vec_id").alias("id"), "label"), "id").join(vec_queries(t).select("query_id", "q_label"), "query_id")


@query(f"WITH {_top(10)} SELECT query_id, id, score, rank FROM top")
def vector_topk(t: Tables) -> DataFrame:
    return vectors.vector_topk(t.embeddings, vec_queries(t), 10).drop("group")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS norm, 1.0 AS unit, CAST(len(embedding) AS INT) AS size FROM embeddings")
def vector_normalise(t: Tables) -> DataFrame:
    unit = vectors.norm(vectors.l2_normalise(F.col("embedding")))
    return t.embeddings.select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), F.round(unit, 6).alias("unit"), F.size("embedding").alias("size"))


@query()
def ann_topk(t: Tables) -> DataFrame:
    return vectors.ann_topk(t.embeddings, vec_queries(t), 10)


_LANES = f"""{_top(10, "query_id, label % 4")}, h AS (
  SELECT query_id, e.vec_id AS id, e.label AS label, round(list_cosine_similarity(CAST(qe[1:16] AS DOUBLE[]), CAST(embedding[1:16] AS DOUBLE[])), 6) AS score FROM q, embeddings e
), ht AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label % 4 ORDER BY score DESC, id) AS rank FROM h) WHERE rank <= 10),
lanes AS (SELECT query_id, CAST(label % 4 AS VARCHAR) AS source, id, score, rank, 'chunk' AS lane FROM top UNION ALL SELECT query_id, CAST(label % 4 AS VARCHAR), id, score, rank, 'heading' FROM ht),
fused AS (SELECT query_id, source, id, round(least(sum(1 / (60 + rank)) / (8 / 61), 1.0), 9) AS score, max(score) FILTER (lane = 'chunk') AS chunk_score, max(score) FILTER (lane = 'heading') AS heading_score,
  string_agg(lane, '+' ORDER BY lane) AS path FROM lanes GROUP BY ALL)"""


def _lanes(t: Tables) -> DataFrame:
    rows = t.embeddings.withColumn("source", F.col("label") % 4)
    head = F.slice("embedding", 1, 16)
    chunk = vectors.vector_topk(rows, vec_queries(t), 10, group="source")
    heading = vectors.vector_topk(rows.withColumn("embedding", head), vec_queries(t).withColumn("embedding", head), 10, group="source")
    return chunk.withColumn("lane", F.lit("chunk")).unionByName(heading.withColumn("lane", F.lit("heading"))).withColumnRenamed("group", "source")


@query(f"WITH {_LANES} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(heading_score, 0) DESC, source, id) AS rank FROM fused")
def cross_source_rrf(t: Tables) -> DataFrame:
    return fusion.cross_source_rrf(_lanes(t), 8)


@query(f"WITH {_LANES} SELECT query_id, source, count(*) AS n, sum(CASE WHEN lane = 'chunk' THEN 1 ELSE 0 END) AS n_chunk, max(score) AS best FROM lanes GROUP BY query_id, source")
def lane_union(t: Tables) -> DataFrame:
    return _lanes(t).groupBy("query_id", "source").agg(F.count("*").alias("n"), F.sum(F.when(F.col("lane") == "chunk", 1).otherwise(0)).alias("n_chunk"), F.max("score").alias("best"))


_WORDS = "regexp_extract_all(lower(translate({0}, 'àâäáãåçéèêëíìîïñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY')), '[a-z0-9]+')"
_LEX = f"""qt AS (SELECT item_id AS query_id, unnest(list_distinct({_WORDS.format("text")})) AS token FROM benchmark),
dt AS (SELECT doc_id AS id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS.format("coalesce(text, '')")}) AS token FROM documents) GROUP BY ALL),
l AS (SELECT query_id, id, count(*) AS matched, CAST(sum(tf) AS BIGINT) AS tf FROM qt JOIN dt USING (token) GROUP BY ALL),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, tf DESC, id) AS rank FROM l) WHERE rank <= {{k}})"""


def _queries(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {_LEX.format(k=10)} SELECT * FROM lex")
def lexical_topk(t: Tables) -> DataFrame:
    return lexical.lexical_topk(t.documents.select(F.col("doc_id").alias("id"), "text"), _queries(t), 10)


_STEM = "t"
for _pattern, _new in lexical.FRENCH.endings:
    _STEM = f"regexp_replace({_STEM}, '{_pattern}', '{_new}')"
_STOP = ", ".join(f"'{w}'" for w in sorted(lexical.FRENCH.stop))


def _lexemes(ident: str, table: str) -> str:
    return f"SELECT {ident}, {_STEM} AS lexeme FROM (SELECT {ident}, unnest({_WORDS.format("coalesce(text, '')")}) AS t FROM {table}) WHERE t NOT IN ({_STOP})"


@query(f"""WITH q AS (SELECT DISTINCT item_id AS query_id, lexeme FROM ({_lexemes("item_id", "benchmark")})), d AS (SELECT doc_id AS id, lexeme, count(*) AS n FROM ({_lexemes("doc_id", "documents")}) GROUP BY ALL),
s AS (SELECT query_id, id, CAST(sum(n) AS BIGINT) AS n_covers FROM q JOIN d USING (lexeme) GROUP BY ALL)
SELECT * FROM (SELECT query_id, id, n_covers, round(0.1 * n_covers, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY n_covers DESC, id) AS rank FROM s) WHERE rank <= 10""")
def cover_density_topk(t: Tables) -> DataFrame:
    """Any lexeme of a query: each occurrence is a cover."""
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.translate("text", '"', " ").alias("text"))
    return lexical.cover_density_topk(t.documents.select(F.col("doc_id").alias("id"), "text"), asked, 10)


@query()
def cover_density_all(t: Tables) -> DataFrame:
    """All of: the first two words of each test item as a phrase, and its third and fifth word."""
    w = T.words(F.col("text"))
    text = F.concat(F.lit('"'), F.get(w, F.lit(0)), F.lit(" "), F.get(w, F.lit(1)), F.lit('" '), F.coalesce(F.get(w, F.lit(2)), F.lit("")), F.lit(" "), F.coalesce(F.get(w, F.lit(4)), F.lit("")))
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), text.alias("text"))
    return lexical.cover_density_topk(t.documents.select(F.col("doc_id").alias("id"), "text"), asked, 10, need_all=True)


_HEAD = f"""ht AS (SELECT DISTINCT doc_id AS id, unnest({_WORDS.format("coalesce(split_part(text, chr(10), 1), '')")}) AS token FROM documents),
hl AS (SELECT query_id, id, count(*) AS matched FROM qt JOIN ht USING (token) GROUP BY ALL),
hd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, id) AS rank FROM hl) WHERE rank <= 20)"""


def _heading_lane(t: Tables, k: int) -> DataFrame:
    heads = t.documents.select(F.col("doc_id").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("text"))
    return lexical.heading_topk(heads, _queries(t), k)


@query(f"""WITH {_LEX.format(k=20)}, {_HEAD}, f AS (SELECT query_id, id, a.rank AS semantic_rank, b.rank AS lexical_rank, round(0.5 / (60 + coalesce(a.rank, 20)) + 0.5 / (60 + coalesce(b.rank, 20)), 9) AS score
  FROM (SELECT query_id, id, rank FROM hd) a FULL OUTER JOIN (SELECT query_id, id, rank FROM lex) b USING (query_id, id))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 20""")
def hybrid_rrf(t: Tables) -> DataFrame:
    lex = lexical.lexical_topk(t.documents.select(F.col("doc_id").alias("id"), "text"), _queries(t), 20)
    return fusion.hybrid_rrf(_heading_lane(t, 20), lex, 20)


@query(f"""WITH {_top(20)}, p AS (SELECT query_id, id, score, id // 2 AS pair FROM top), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, pair ORDER BY score DESC, id) AS n FROM p) WHERE n = 1)
SELECT * FROM (SELECT query_id, id, score, pair, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM o) WHERE rank <= 10""")
def pair_dedup_topk(t: Tables) -> DataFrame:
    return fusion.pair_dedup(top(t, 20).select("query_id", "id", "score"), F.floor(F.col("id") / 2), 10)


@query(f"""WITH {_top(20)}, g AS (SELECT query_id, label AS section, max(score) AS top, avg(score) AS mean, count(*) AS n_chunks, arg_min(id, (-score, id)) AS best_chunk FROM top GROUP BY ALL),
x AS (SELECT query_id, section, n_chunks, best_chunk, round(0.5 * top + 0.3 * mean + 0.2 * n_chunks / max(n_chunks) OVER (PARTITION BY query_id), 11) AS score FROM g)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, section) AS rank FROM x""")
def section_aggregate(t: Tables) -> DataFrame:
    return fusion.section_aggregate(top(t, 20).select("query_id", "id", "score", "label"), F.col("label"))


@query(f"""WITH {_top(20)}, r AS (SELECT query_id, id, rank AS first_rank, round(coalesce(CASE WHEN id % 3 > 0 THEN (id * 37 % 101) / 101 END, 1 - (rank - 1) * 0.001), 6) AS rerank_score FROM top)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, first_rank) AS rank FROM r) WHERE rank <= 5""")
def rerank_cut(t: Tables) -> DataFrame:
    score = F.when(F.col("id") % 3 > 0, (F.col("id") * 37 % 101) / 101)
    return fusion.rerank_cut(top(t, 20).select("query_id", "id", "rank"), score, 5)


@query(f"""WITH {_top(20)}, l AS (SELECT query_id, id, label AS publisher, rank, first_value(label) OVER (PARTITION BY query_id ORDER BY rank) AS lead FROM top)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM l WHERE publisher <> lead) WHERE place <= 2""")
def publisher_diversity(t: Tables) -> DataFrame:
    return fusion.publisher_diversity(top(t, 20).select("query_id", "id", F.col("label").alias("publisher"), "rank"), 2)


@query(f"""WITH {_top(12)}, n AS (SELECT query_id, CAST(count(*) AS INT) AS n FROM top GROUP BY query_id),
c AS (SELECT *, CASE WHEN query_id % 80 = 0 THEN NULL WHEN query_id % 80 = 20 THEN CAST([] AS INT[]) ELSE [7, 7, 3, 40] END AS sel FROM n)
SELECT query_id, n, CASE WHEN sel IS NULL THEN [0, 1, 2, 3, 4] WHEN len(sel) = 0 THEN CAST([] AS INT[]) ELSE [7, 3, 0, 1] END AS kept, coalesce(len(sel) = 0, false) AS all_rejected FROM c""")
def selector_topup(t: Tables) -> DataFrame:
    chosen = F.when(F.col("query_id") % 80 == 0, F.lit(None)).when(F.col("query_id") % 80 == 20, F.array().cast("array<int>")).otherwise(F.array(*[F.lit(i) for i in (7, 7, 3, 40)]))
    return fusion.selector_topup(top(t, 12).select("query_id", "id"), chosen, 4).withColumn("all_rejected", F.coalesce("all_rejected", F.lit(False)))


def _sections(t: Tables) -> DataFrame:
    lex = lexical.lexical_topk(t.documents.select(F.col("doc_id").alias("id"), "text"), _queries(t), 12)
    docs = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("publisher"), T.token_estimate(F.col("text")).cast("long").alias("tokens"))
    return lex.join(docs, "id").withColumn("score", F.col("matched").cast("double"))


@query(f"""WITH RECURSIVE {_LEX.format(k=12)}, s AS (SELECT query_id, id, rank, CAST(length(text) // 4 AS BIGINT) AS tokens FROM lex JOIN documents ON id = doc_id),
f AS (SELECT query_id, 0 AS rank, CAST(0 AS BIGINT) AS used, CAST([] AS BIGINT[]) AS ids FROM (SELECT DISTINCT query_id FROM s)
  UNION ALL SELECT s.query_id, CAST(s.rank AS INT), CASE WHEN used + tokens <= 3000 THEN used + tokens ELSE used END, CASE WHEN used + tokens <= 3000 THEN list_append(ids, s.id) ELSE ids END FROM f JOIN s ON s.query_id = f.query_id AND s.rank = f.rank + 1)
SELECT query_id, arg_max(ids, rank) AS ids, arg_max(used, rank) AS used FROM f GROUP BY query_id""")
def token_budget(t: Tables) -> DataFrame:
    return context.token_budget(_sections(t), 3000)


@query(f"""WITH RECURSIVE {_LEX.format(k=12)}, s AS (SELECT query_id, id, rank, matched, source AS publisher, CAST(length(text) // 4 AS BIGINT) AS tokens FROM lex JOIN documents ON id = doc_id),
wh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM s WHERE tokens <= 400) WHERE k <= 2), w AS (SELECT query_id, sum(tokens) AS used, list(id ORDER BY rank) AS ids FROM wh GROUP BY query_id),
q AS (SELECT s.query_id, coalesce(any_value(w.used), 0) AS used1, coalesce(any_value(w.ids), CAST([] AS BIGINT[])) AS whole, arg_min(publisher, rank) AS lead FROM s LEFT JOIN w USING (query_id) GROUP BY s.query_id), rest AS (SELECT s.*, row_number() OVER (PARTITION BY s.query_id ORDER BY s.rank) AS r FROM s ANTI JOIN wh USING (query_id, id)),
f AS (SELECT query_id, CAST(0 AS BIGINT) AS r, CAST(used1 AS BIGINT) AS used, CAST([] AS BIGINT[]) AS ids FROM q UNION ALL SELECT rest.query_id, rest.r, CASE WHEN used + tokens <= 3000 THEN used + tokens ELSE used END, CASE WHEN used + tokens <= 3000 THEN list_append(ids, rest.id) ELSE ids END FROM f JOIN rest ON rest.query_id = f.query_id AND rest.r = f.r + 1),
g AS (SELECT query_id, arg_max(ids, r) AS ids, arg_max(used, r) AS used FROM f GROUP BY query_id), x AS (SELECT q.*, g.used AS used, list_concat(whole, g.ids) AS taken FROM q JOIN g USING (query_id)),
a AS (SELECT * FROM (SELECT s.query_id, s.id, s.rank, row_number() OVER (PARTITION BY s.query_id ORDER BY s.rank) AS k FROM s JOIN x USING (query_id) WHERE publisher <> lead AND NOT list_contains(taken, s.id)) WHERE k <= 2), b AS (SELECT query_id, list(id ORDER BY rank) AS added FROM a GROUP BY query_id),
y AS (SELECT x.*, coalesce(added, CAST([] AS BIGINT[])) AS added FROM x LEFT JOIN b USING (query_id))
SELECT query_id, list(s.id ORDER BY -matched, list_contains(whole, s.id), rank) AS ids, any_value(used) AS used, any_value(whole) AS whole, any_value(added) AS added FROM s JOIN y USING (query_id) WHERE list_contains(taken, s.id) OR list_contains(added, s.id) GROUP BY query_id""")
def context_pack(t: Tables) -> DataFrame:
    return context.pack_context(_sections(t), budget=3000, whole_budget=400, max_whole=2, extra=2)


@query(f"""WITH {_top(10)}, first AS (SELECT query_id, id, score, rank, 1 AS attempt FROM top WHERE score >= 0.6), w AS ({"SELECT query_id, id, score, rank, 2 AS attempt FROM top WHERE query_id NOT IN (SELECT query_id FROM first) AND rank <= 3"})
SELECT * FROM first UNION ALL SELECT * FROM w""")
def retry_unanswered(t: Tables) -> DataFrame:
    rows = top(t, 10).select("query_id", "id", "score", "rank")
    first = rows.filter("score >= 0.6")
    again = rows.filter("rank <= 3").join(first.select("query_id").distinct(), "query_id", "left_anti")
    return first.withColumn("attempt", F.lit(1)).unionByName(again.withColumn("attempt", F.lit(2)))


@query(f"""WITH {_HEAD.replace("ht AS", f"qt AS (SELECT item_id AS query_id, unnest(list_distinct({_WORDS.format('text')})) AS token FROM benchmark), ht AS", 1)} SELECT query_id, id, matched, rank FROM hd WHERE rank <= 5""")
def heading_search(t: Tables) -> DataFrame:
    return _heading_lane(t, 5)


@query("""WITH m AS (SELECT item_id, lower(split_part(text, ' ', 1)) AS marker FROM benchmark), d AS (SELECT doc_id, source, lower(coalesce(text, '')) AS text FROM documents)
SELECT item_id, any_value(marker) AS marker, count(doc_id) AS n_docs, count(DISTINCT source) AS n_sources, min(doc_id) AS first_doc FROM m LEFT JOIN d ON contains(d.text, m.marker) GROUP BY item_id""")
def marker_search(t: Tables) -> DataFrame:
    markers = t.benchmark.select("item_id", F.lower(F.split_part("text", F.lit(" "), F.lit(1))).alias("marker"))
    docs = t.documents.select("doc_id", "source", F.lower(F.coalesce("text", F.lit(""))).alias("body"))
    return lexical.marker_search(docs, markers)


@query()
def entity_link(t: Tables) -> DataFrame:
    """The page whose title fits the first sentence of each test item best, pages of the item's own site first."""
    cands = t.pages.select(F.col("page_id").alias("cand_id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.parse_url("url", F.lit("HOST")).alias("publisher"))
    sites = cands.select(F.col("cand_id").alias("query_id"), "publisher")
    labels = t.benchmark.select(F.col("item_id").alias("query_id"), F.split_part("text", F.lit("."), F.lit(1)).alias("label")).join(sites, "query_id", "left")
    return linking.entity_link(labels.withColumn("tag", F.when(F.col("query_id") % 7 == 0, "en")), cands)


@query("""WITH d AS (SELECT doc_id, source, split_part(text, chr(10), 1) AS heading FROM documents), c AS (SELECT doc_id AS chunk_id, source, CASE WHEN doc_id % 3 = 0 THEN heading ELSE ' ' || heading END AS path FROM d),
j AS (SELECT c.chunk_id, c.path, d.doc_id AS section_id, CASE WHEN c.path = d.heading THEN 0 ELSE 1 END AS kind FROM c JOIN d ON c.source = d.source AND trim(c.path) = trim(d.heading))
SELECT chunk_id, section_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY kind, section_id) AS n FROM j) WHERE n = 1""")
def resolver_cascade(t: Tables) -> DataFrame:
    """Sections by whole path, else by trimmed path; of equal headings of a source only the least id is joined."""
    from weftline.operators import resolve

    heading = F.split_part("text", F.lit("\n"), F.lit(1))
    at = lambda c: F.concat_ws("\u0001", "source", c)
    sections = t.documents.select(F.col("doc_id").alias("section_id"), "source", heading.alias("heading"))
    chunks = t.documents.select(F.col("doc_id").alias("chunk_id"), "source", F.when(F.col("doc_id") % 3 == 0, heading).otherwise(F.concat(F.lit(" "), heading)).alias("path")).filter("source is not null and path is not null")
    least = lambda key: sections.filter("source is not null and heading is not null").groupBy(key.alias("key")).agg(F.min("section_id").alias("value"))
    found = resolve.cascade(chunks, [(at(F.col("path")), least(at(F.col("heading")))), (at(F.trim("path")), least(at(F.trim("heading"))))], "section_id")
    return found.filter("section_id is not null").select("chunk_id", "section_id", F.col("attempt").alias("kind"))


@query()
def heading_scores(t: Tables) -> DataFrame:
    """Scores of the five headings that share most tokens with each query."""
    heads = t.documents.select(F.col("doc_id").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("heading"), "source")
    pairs = _heading_lane(t, 5).join(heads, "id").join(_queries(t), "query_id").select("query_id", "id", "heading", F.concat_ws(" > ", "source", "heading").alias("path"), F.col("text").alias("query"))
    return linking.heading_scores(pairs).select("query_id", "id", "score")


_PLAIN = "lower(translate(coalesce(text, ''), 'àâäáãåçéèêëíìîïñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY'))"


@query(f"""WITH {_LEX.format(k=10)}, w AS (SELECT item_id AS run_id, {_WORDS.format("text")} AS x FROM benchmark), pt AS (SELECT run_id, upper(x[3]) || '| ' || x[9] || ' ' AS pattern, unnest([x[3], x[9]]) AS needle FROM w WHERE run_id % 9 > 0 UNION ALL SELECT run_id, x[2] || ' ' || x[3], x[2] || ' ' || x[3] FROM w WHERE run_id % 9 > 0),
st AS (SELECT query_id AS run_id, id, rank, unnest([1, CASE WHEN id % 4 > 0 THEN 2 END, CASE WHEN id % 4 > 0 AND rank <= 6 THEN 3 END, CASE WHEN id % 4 > 0 AND rank <= 6 AND id % 3 > 0 THEN 4 END, CASE WHEN id % 4 > 0 AND rank <= 6 AND id % 3 > 0 AND id % 5 > 0 THEN 5 END]) AS stage FROM lex),
hit AS (SELECT run_id, pattern, max(stage) AS far, min(rank) FILTER (stage = 1) AS first_rank FROM pt JOIN st USING (run_id) JOIN (SELECT doc_id AS id, {_PLAIN} AS plain FROM documents) USING (id) WHERE stage IS NOT NULL AND contains(plain, needle) GROUP BY ALL),
j AS (SELECT run_id, pattern, coalesce(far, 0) AS far, first_rank FROM (SELECT DISTINCT run_id, pattern FROM pt) LEFT JOIN hit USING (run_id, pattern)), n AS (SELECT ['absent', 'lost_in_rerank', 'lost_in_aggregation', 'rejected_by_selector', 'lost_in_context', 'ok'] AS names)
SELECT run_id, pattern, names[far + 1] AS verdict, first_rank, names[coalesce(max(far) FILTER (far < 5) OVER (PARTITION BY run_id), 5) + 1] AS overall FROM j, n UNION ALL SELECT item_id, NULL, 'not_evaluated', NULL, 'not_evaluated' FROM benchmark WHERE item_id % 9 = 0""")
def pattern_loss(t: Tables) -> DataFrame:
    """Words of test items looked for in the whole texts that each stage of their search let through."""
    w = T.words(F.col("text"))
    at = lambda i: F.get(w, F.lit(i))
    judged = _queries(t).filter("query_id % 9 > 0").withColumnRenamed("query_id", "run_id")
    asked = judged.select("run_id", F.concat(F.upper(at(2)), F.lit("| "), at(8), F.lit(" ")).alias("pattern")).unionByName(judged.select("run_id", F.concat(at(1), F.lit(" "), at(2)).alias("pattern")))
    found = lexical.lexical_topk(t.documents.select(F.col("doc_id").alias("id"), "text"), _queries(t), 10)
    on = [F.lit(True), F.col("id") % 4 > 0, F.col("rank") <= 6, F.col("id") % 3 > 0, F.col("id") % 5 > 0]
    reached = F.array(*[F.when(F.forall(F.array(*on[: i + 1]), lambda x: x), F.lit(name)) for i, name in enumerate(patterns.STAGES)])
    passed = found.withColumn("stage", F.explode(F.array_compact(reached))).join(t.documents.select(F.col("doc_id").alias("id"), "text"), "id")
    return patterns.pattern_loss(asked, passed.select(F.col("query_id").alias("run_id"), "stage", "rank", "text"), _queries(t).select(F.col("query_id").alias("run_id")))
