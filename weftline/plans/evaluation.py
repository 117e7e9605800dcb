"""Evaluation: metrics over retrieval results, funnels, votes, calibration, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import evalmetrics as M
from weftline.operators import fusion
from weftline.operators.scratch import Scratch
from weftline.plans.common import Tables, query
from weftline.plans.retrieval import _top, top, vec_queries

_REL = f"{_top(50)}, r AS (SELECT query_id, id, rank, label = q_label AS relevant FROM top)"


def _relevant(t: Tables, k: int = 50) -> DataFrame:
    return top(t, k).select("query_id", "id", "rank", (F.col("label") == F.col("q_label")).alias("relevant"))


def _searched(t: Tables) -> DataFrame:
    """As _relevant, searched once and written, for plans that read it several times."""
    rows = _relevant(t)
    return Scratch(rows.sparkSession, "searched").save(rows, "relevant")


def _gold_metrics(t: Tables) -> DataFrame:
    """Set metrics of the first ten, with relevance as a flag and the gold size from counts by label."""
    sizes = t.embeddings.groupBy("label").agg(F.count("*").alias("n_gold"))
    n_gold = vec_queries(t).select("query_id", F.col("q_label").alias("label")).join(sizes, "label").select("query_id", "n_gold")
    relevant = F.col("relevant")
    found = _relevant(t, 10).groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(relevant).cast("int").alias("hits"), F.min(F.when(relevant, F.col("rank"))).alias("first"))
    return found.join(n_gold, "query_id").select("query_id", "hits", F.round(F.col("hits") / F.col("n_gold"), 6).alias("recall"), F.round(F.col("hits") / F.col("n"), 6).alias("precision"), (F.col("hits") > 0).cast("int").alias("hit_rate"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"))


@query(f"""WITH {_REL}, g AS (SELECT query_id, CAST(sum(CASE WHEN relevant AND rank <= 10 THEN 1 ELSE 0 END) AS BIGINT) AS hits, min(rank) FILTER (relevant) AS first_rank, sum(CASE WHEN relevant AND rank <= 10 THEN 1 / log2(rank + 1.0) ELSE 0 END) AS dcg FROM r GROUP BY query_id)
SELECT query_id, hits, CAST(hits > 0 AS INT) AS recall_at_k, round(coalesce(1 / first_rank, 0), 6) AS mrr, round(CASE WHEN hits > 0 THEN dcg / list_sum(list_transform(range(1, hits + 1), lambda i: 1 / log2(i + 1.0))) ELSE 0 END, 6) AS ndcg, first_rank FROM g""")
def retrieval_metrics(t: Tables) -> DataFrame:
    return M.ranking_metrics(_relevant(t), 10)


@query(f"""WITH {_REL}, gold AS (SELECT DISTINCT label, vec_id // 2 AS doc FROM embeddings), sizes AS (SELECT label, count(*) AS n_gold FROM gold GROUP BY label), asked AS (SELECT vec_id AS query_id, label FROM embeddings WHERE vec_id % 20 = 0),
f AS (SELECT query_id, id // 2 AS doc, min(rank) AS rank FROM r WHERE rank <= 10 GROUP BY ALL), o AS (SELECT f.*, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place, g.doc IS NOT NULL AS hit FROM f JOIN asked USING (query_id) LEFT JOIN gold g ON g.label = asked.label AND g.doc = f.doc),
x AS (SELECT query_id, count(*) AS n, count(*) FILTER (hit) AS hits, min(place) FILTER (hit) AS first FROM o GROUP BY query_id)
SELECT query_id, CAST(hits AS INT) AS hits, round(hits / n_gold, 6) AS recall, round(hits / n, 6) AS precision, CAST(hits > 0 AS INT) AS hit_rate, round(coalesce(1 / first, 0), 6) AS mrr FROM x JOIN asked USING (query_id) JOIN sizes USING (label)""")
def deterministic_metrics(t: Tables) -> DataFrame:
    """Metrics by document where two ids are aliases of one: a document is relevant if any alias is, and found where its first is."""
    from weftline.operators.fusion import ranked

    gold = t.embeddings.select(F.col("label"), F.floor(F.col("vec_id") / 2).alias("doc")).distinct()
    sizes = gold.groupBy("label").agg(F.count("*").alias("n_gold"))
    asked = vec_queries(t).select("query_id", F.col("q_label").alias("label"))
    found = _relevant(t, 10).groupBy("query_id", F.floor(F.col("id") / 2).alias("doc")).agg(F.min("rank").alias("rank"))
    placed = ranked(found, ["query_id"], [F.col("rank")], name="place").join(asked, "query_id").join(gold.withColumn("hit", F.lit(True)), ["label", "doc"], "left")
    hit = F.coalesce("hit", F.lit(False))
    x = placed.groupBy("query_id", "label").agg(F.count("*").alias("n"), F.count_if(hit).cast("int").alias("hits"), F.min(F.when(hit, F.col("place"))).alias("first")).join(sizes, "label")
    return x.select("query_id", "hits", F.round(F.col("hits") / F.col("n_gold"), 6).alias("recall"), F.round(F.col("hits") / F.col("n"), 6).alias("precision"), (F.col("hits") > 0).cast("int").alias("hit_rate"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"))


@query(f"""WITH {_REL}, n AS (SELECT label, count(*) AS n_gold FROM embeddings GROUP BY label), gold AS (SELECT vec_id AS query_id, n_gold FROM embeddings JOIN n USING (label) WHERE vec_id % 20 = 0),
x AS (SELECT query_id, count(*) AS n, count(*) FILTER (relevant) AS hits, min(rank) FILTER (relevant) AS first_rank FROM r WHERE rank <= 10 GROUP BY 1)
SELECT query_id, CAST(hits AS INT) AS hits, round(hits / n_gold, 6) AS recall, round(hits / n, 6) AS precision, CAST(hits > 0 AS INT) AS hit_rate, round(coalesce(1 / first_rank, 0), 6) AS mrr FROM x JOIN gold USING (query_id)""")
def deterministic_metrics_whole(t: Tables) -> DataFrame:
    return _gold_metrics(t)


@query(f"""WITH {_REL}, c AS (SELECT unnest([('pool', 50), ('top20', 20), ('top12', 12), ('selected', 5)]) AS s), st AS (SELECT s[1] AS stage, s[2] AS k FROM c),
g AS (SELECT query_id, count(*) AS gold FROM r WHERE relevant GROUP BY query_id), e AS (SELECT query_id, stage, sum(CASE WHEN relevant AND rank <= k THEN 1 ELSE 0 END) AS hits FROM r, st GROUP BY ALL)
SELECT stage, count(*) AS n, round(avg(CAST(hits > 0 AS INT)), 6) AS hit_rate, round(avg(hits / nullif(gold, 0)), 6) AS recall, CAST(sum(CASE WHEN gold IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS no_gold FROM e LEFT JOIN g USING (query_id) GROUP BY stage""")
def stage_funnel(t: Tables) -> DataFrame:
    cuts = {"pool": 50, "top20": 20, "top12": 12, "selected": 5}
    rows = _relevant(t)
    wide = rows.groupBy("query_id").agg(F.sum(F.col("relevant").cast("int")).alias("gold"), *[F.sum((F.col("relevant") & (F.col("rank") <= k)).cast("int")).alias(s) for s, k in cuts.items()])
    long = wide.unpivot(["query_id", "gold"], list(cuts), "stage", "hits")
    return long.groupBy("stage").agg(F.count("*").alias("n"), F.round(F.avg((F.col("hits") > 0).cast("int")), 6).alias("hit_rate"), F.round(F.avg(F.col("hits") / F.nullif("gold", F.lit(0))), 6).alias("recall"), F.sum((F.col("gold") == 0).cast("long")).alias("no_gold"))


@query(f"""WITH {_REL}, e AS (SELECT query_id, bool_or(relevant) AS pool, bool_or(relevant AND rank <= 12) AS sections, bool_or(relevant AND rank <= 5) AS selected FROM r GROUP BY query_id)
SELECT count(*) AS n, count(*) FILTER (pool AND sections) AS pool_to_sections_retained, count(*) FILTER (pool AND NOT sections) AS pool_to_sections_lost, count(*) FILTER (sections AND selected) AS sections_to_selected_retained, count(*) FILTER (sections AND NOT selected) AS sections_to_selected_lost FROM e""")
def stage_transitions(t: Tables) -> DataFrame:
    rel = F.col("relevant")
    e = _relevant(t).groupBy("query_id").agg(F.bool_or(rel).alias("pool"), F.bool_or(rel & (F.col("rank") <= 12)).alias("sections"), F.bool_or(rel & (F.col("rank") <= 5)).alias("selected"))
    return e.agg(F.count("*").alias("n"), *[F.count_if(F.col(a) & (F.col(b) if kept else ~F.col(b))).alias(f"{a}_to_{b}_{'retained' if kept else 'lost'}") for a, b in (("pool", "sections"), ("sections", "selected")) for kept in (True, False)])


_TWO = f"""{_REL}, a AS (SELECT query_id, 'cosine' AS strategy, min(rank) FILTER (relevant AND rank <= 10) AS first_rank, count(*) FILTER (relevant AND rank <= 10) AS hits FROM r GROUP BY query_id
), z AS (SELECT query_id, relevant, row_number() OVER (PARTITION BY query_id ORDER BY id % 7, rank) AS rank FROM r), b AS (SELECT query_id, 'shuffled' AS strategy, min(rank) FILTER (relevant AND rank <= 10) AS first_rank, count(*) FILTER (relevant AND rank <= 10) AS hits FROM z GROUP BY query_id), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)"""


def _strategies(t: Tables) -> DataFrame:
    rows = _searched(t)
    other = fusion.ranked(rows.withColumnRenamed("rank", "was"), ["query_id"], [F.col("id") % 7, F.col("was")])
    both = rows.withColumn("strategy", F.lit("cosine")).unionByName(other.drop("was").withColumn("strategy", F.lit("shuffled")))
    hit = F.col("relevant") & (F.col("rank") <= 10)
    return both.groupBy("query_id", "strategy").agg(F.min(F.when(hit, F.col("rank"))).alias("first_rank"), F.count_if(hit).alias("hits"))


@query(f"""WITH {_TWO} SELECT query_id, CASE WHEN count(first_rank) = 0 THEN 'all_miss' WHEN count(first_rank) = 2 THEN 'all_hit' ELSE 'split' END AS outcome, arg_min(strategy, (first_rank, strategy)) FILTER (first_rank IS NOT NULL) AS winner, min(first_rank) AS best_rank FROM u GROUP BY query_id""")
def strategy_tournament(t: Tables) -> DataFrame:
    n = F.count("first_rank")
    outcome = F.when(n == 0, "all_miss").when(n == 2, "all_hit").otherwise("split")
    return _strategies(t).groupBy("query_id").agg(outcome.alias("outcome"), F.min_by("strategy", F.when(F.col("first_rank").isNotNull(), F.struct("first_rank", "strategy"))).alias("winner"), F.min("first_rank").alias("best_rank"))


@query(f"""WITH {_TWO}, g AS (SELECT strategy, avg(CAST(hits > 0 AS INT)) AS recall, avg(coalesce(1 / first_rank, 0)) AS mrr, avg(first_rank) AS mean_rank, count(*) FILTER (hits = 0) AS missed FROM u GROUP BY strategy), base AS (SELECT * FROM g WHERE strategy = 'cosine')
SELECT g.strategy, round(g.recall, 6) AS recall, round(g.mrr, 6) AS mrr, round(g.mean_rank, 6) AS mean_rank, g.missed, round(100 * (g.recall - base.recall), 4) AS recall_pp, round(g.mrr - base.mrr, 6) AS mrr_delta FROM g, base""")
def ablation(t: Tables) -> DataFrame:
    g = _strategies(t).groupBy("strategy").agg(F.avg((F.col("hits") > 0).cast("int")).alias("recall"), F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))).alias("mrr"), F.avg("first_rank").alias("mean_rank"), F.count_if(F.col("hits") == 0).alias("missed"))
    base = g.filter("strategy = 'cosine'").select(F.col("recall").alias("r0"), F.col("mrr").alias("m0"))
    return g.crossJoin(F.broadcast(base)).select("strategy", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"), F.round("mean_rank", 6).alias("mean_rank"), "missed", F.round(100 * (F.col("recall") - F.col("r0")), 4).alias("recall_pp"), F.round(F.col("mrr") - F.col("m0"), 6).alias("mrr_delta"))


@query("""WITH x AS (SELECT CAST(quality AS INT) AS expected, CASE WHEN n_chars >= 400 THEN 1 ELSE 0 END AS predicted FROM documents JOIN labels USING (doc_id))
SELECT expected, count(*) FILTER (predicted = 0) AS predicted_0, count(*) FILTER (predicted = 1) AS predicted_1 FROM x GROUP BY expected""")
def confusion_matrix(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id").select(F.col("quality").cast("int").alias("expected"), F.when(F.col("n_chars") >= 400, 1).otherwise(0).alias("predicted"))
    return M.confusion(rows, "expected", "predicted", [0, 1]).withColumnsRenamed({"0": "predicted_0", "1": "predicted_1"})


@query("""SELECT lang, count(*) AS n, round(avg(CAST((quality = 1) = (n_chars >= 400) AS INT)), 6) AS accuracy, round(avg(CAST((quality = 1 OR toxic = 1) = (n_chars >= 400) AS INT)), 6) AS relaxed FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def intent_metrics(t: Tables) -> DataFrame:
    long = F.col("n_chars") >= 400
    rows = t.documents.join(t.labels, "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(((F.col("quality") == 1) == long).cast("int")), 6).alias("accuracy"), F.round(F.avg((((F.col("quality") == 1) | (F.col("toxic") == 1)) == long).cast("int")), 6).alias("relaxed"))


@query("""WITH g AS (SELECT user_id, count(*) AS n, CAST(sum(CAST(value > 50 AS INT)) AS BIGINT) AS yes, min(event_id) FILTER (value > 50) AS fy, min(event_id) FILTER (NOT value > 50) AS fn FROM events GROUP BY user_id),
v AS (SELECT *, n // 2 + 1 AS quorum, CASE WHEN yes >= n // 2 + 1 THEN true WHEN n - yes >= n // 2 + 1 THEN false END AS verdict FROM g)
SELECT user_id, n, yes, quorum, verdict, CASE WHEN verdict THEN fy WHEN NOT verdict THEN fn END AS representative, yes || '/' || n AS agreement FROM v""")
def majority_vote(t: Tables) -> DataFrame:
    return M.majority(t.events.select("user_id", "event_id", (F.col("value") > 50).alias("yes_vote")), "user_id", "yes_vote", "event_id")


_DIMS = """d AS (SELECT doc_id, quality, (doc_id % 11) / 10 AS legal, (doc_id % 7) / 6 AS complete, (doc_id % 5) / 4 AS aligned, (doc_id % 3) / 2 AS support, CASE WHEN doc_id % 9 > 0 THEN (doc_id % 13) / 12 END AS raw,
  toxic = 1 AS wrong, CASE WHEN doc_id % 4 > 0 THEN (doc_id % 4 - 1) / 2 END AS recall, CASE WHEN doc_id % 4 = 1 THEN 0.0 ELSE 1.0 END AS hit_rate FROM labels),
c AS (SELECT *, list_filter([CASE WHEN wrong THEN 'material_contradiction_with_gold_answer' END, CASE WHEN aligned < 0.75 THEN 'weak_gold_answer_alignment' END, CASE WHEN legal < 0.8 THEN 'legal_correctness_below_gate' END, CASE WHEN complete < 0.7 THEN 'incomplete_answer' END, CASE WHEN support < 0.7 THEN 'weak_source_support' END], lambda r: r IS NOT NULL) AS hard,
  CASE WHEN recall IS NOT NULL AND hit_rate = 0 THEN ['no_expected_source_retrieved'] WHEN recall < 1 THEN ['missing_expected_source'] ELSE CAST([] AS VARCHAR[]) END AS soft,
  least(0.35 * legal + 0.25 * complete + 0.25 * aligned + 0.15 * support, raw, CASE WHEN wrong THEN 0.6 END, CASE WHEN aligned < 0.75 OR legal < 0.8 OR support < 0.7 THEN 0.75 END, CASE WHEN complete < 0.7 THEN 0.8 END) AS basis FROM d),
j AS (SELECT doc_id, quality, round(least(basis, CASE WHEN recall IS NOT NULL AND hit_rate = 0 THEN 0.6 WHEN recall < 1 THEN 0.85 END), 6) AS score, round(basis, 6) AS basis, basis >= 0.8 AND len(hard) = 0 AND legal >= 0.8 AND complete >= 0.75 AND aligned >= 0.8 AS passed, array_to_string(list_concat(hard, soft), ',') AS caps FROM c)"""


def _judged(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    dims = {"legal_correctness": (i % 11) / 10, "completeness": (i % 7) / 6, "gold_answer_alignment": (i % 5) / 4, "source_support": (i % 3) / 2}
    got = M.calibrated(M.RUBRIC, F.when(i % 9 > 0, (i % 13) / 12), dims, F.col("toxic") == 1, F.when(i % 4 > 0, (i % 4 - 1) / 2), F.when(i % 4 == 1, 0.0).otherwise(1.0))
    return t.labels.select("doc_id", "quality", *[c.alias(name) for name, c in got.items()])


@query(f"WITH {_DIMS} SELECT doc_id, score, basis, passed, caps FROM j")
def judge_calibration(t: Tables) -> DataFrame:
    return _judged(t).select("doc_id", "score", "basis", "passed", F.array_join("caps", ",").alias("caps"))


@query(f"WITH {_DIMS} SELECT quality, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(CAST(passed AS INT)), 6) AS pass_rate, round(avg(CAST(passed AS INT)) FILTER (doc_id % 10 > 0), 6) AS pass_rate_excluding FROM j GROUP BY quality")
def eval_aggregate(t: Tables) -> DataFrame:
    p = F.col("passed").cast("int")
    return _judged(t).groupBy("quality").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg(p), 6).alias("pass_rate"), F.round(F.avg(F.when(F.col("doc_id") % 10 > 0, p)), 6).alias("pass_rate_excluding"))


@query(f"""WITH {_DIMS}, g AS (SELECT unnest([0.2, 0.4, 0.6, 0.8]) AS threshold), m AS (SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (score >= threshold AND quality = 1) AS tp, count(*) FILTER (score >= threshold AND quality = 0) AS fp, count(*) FILTER (score < threshold AND quality = 1) AS fn, count(*) FILTER (score < threshold AND quality = 0) AS tn FROM j, g GROUP BY threshold)
SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS agreement, row_number() OVER (ORDER BY (tp + tn) / (tp + fp + fn + tn) DESC, threshold) AS place FROM m""")
def threshold_sweep(t: Tables) -> DataFrame:
    grid = F.array(*[F.lit(x) for x in (0.2, 0.4, 0.6, 0.8)])
    rows = _judged(t).withColumn("threshold", F.explode(grid))
    over, good = F.col("score") >= F.col("threshold"), F.col("quality") == 1
    m = rows.groupBy("threshold").agg(F.count_if(over & good).alias("tp"), F.count_if(over & ~good).alias("fp"), F.count_if(~over & good).alias("fn"), F.count_if(~over & ~good).alias("tn"))
    agreement = (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return m.withColumn("agreement", F.round(agreement, 6)).withColumn("place", F.row_number().over(Window.orderBy(F.desc(agreement), "threshold")))


@query("""WITH a AS (SELECT source, avg(quality) AS q, avg(toxic) AS x FROM documents JOIN labels USING (doc_id) WHERE doc_id % 2 = 0 GROUP BY source), b AS (SELECT source, avg(quality) AS q, avg(toxic) AS x FROM documents JOIN labels USING (doc_id) WHERE doc_id % 2 = 1 GROUP BY source)
SELECT source, round(a.q - b.q, 6) AS delta_quality, round(a.x - b.x, 6) AS delta_toxic, CASE WHEN a.q IS NULL OR b.q IS NULL THEN 'missing' WHEN round(a.q - b.q, 6) >= -0.05 THEN 'pass' ELSE 'fail' END AS verdict FROM a FULL OUTER JOIN b USING (source)""")
def baseline_gate(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id")

    def half(r: int, p: str) -> DataFrame:
        return rows.filter(F.col("doc_id") % 2 == r).groupBy("source").agg(F.avg("quality").alias(f"{p}q"), F.avg("toxic").alias(f"{p}x"))

    both = half(0, "a").join(half(1, "b"), "source", "full_outer")
    delta = F.round(F.col("aq") - F.col("bq"), 6)
    return both.select("source", delta.alias("delta_quality"), F.round(F.col("ax") - F.col("bx"), 6).alias("delta_toxic"), F.when(F.col("aq").isNull() | F.col("bq").isNull(), "missing").when(delta >= -0.05, "pass").otherwise("fail").alias("verdict"))


_PAIRS = f"{_REL}, a AS (SELECT query_id, list(id ORDER BY rank) AS l FROM r WHERE rank <= 10 GROUP BY 1), z AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank + (id % 5) * 3, id) AS n FROM r), b AS (SELECT query_id, list(id ORDER BY n) AS m FROM z WHERE n <= 10 GROUP BY 1), c AS (SELECT query_id, l, m, round(len(list_intersect(l, m)) / len(list_distinct(list_concat(l, m))), 6) AS overlap, l[1] = m[1] AS same_first FROM a JOIN b USING (query_id))"


def _runs(t: Tables) -> DataFrame:
    rows = _searched(t)
    as_list = lambda d, c: F.transform(F.array_sort(F.collect_list(F.struct(d, "id"))), lambda x: x["id"]).alias(c)
    left = rows.filter("rank <= 10").groupBy("query_id").agg(as_list("rank", "l"))
    right = fusion.ranked(rows.withColumnRenamed("rank", "was"), ["query_id"], [F.col("was") + (F.col("id") % 5) * 3, F.col("id")], 10).groupBy("query_id").agg(as_list("rank", "m"))
    return left.join(right, "query_id").select("query_id", F.round(T.jaccard(F.col("l"), F.col("m")), 6).alias("overlap"), T.three_state(F.col("l")[0], F.col("m")[0]).alias("same_first"))


@query(f"WITH {_PAIRS} SELECT query_id, overlap, same_first FROM c")
def conformance_pairs(t: Tables) -> DataFrame:
    return _runs(t)


@query(f"""WITH {_PAIRS}, o AS (SELECT overlap, row_number() OVER (ORDER BY overlap) AS i, count(*) OVER () AS n FROM c), p AS (SELECT *, 0.95 * (n + 1) AS pos, greatest(1, least(floor(0.95 * (n + 1)), n - 1)) AS j FROM o)
SELECT count(*) AS n, round(avg(overlap), 6) AS mean_overlap, (SELECT round(avg(CAST(same_first AS INT)), 6) FROM c) AS match_rate, round(CASE WHEN max(n) = 1 THEN max(overlap) ELSE max(overlap) FILTER (i = j) + (max(overlap) FILTER (i = j + 1) - max(overlap) FILTER (i = j)) * (max(pos) - max(j)) END, 6) AS p95 FROM p""")
def conformance(t: Tables) -> DataFrame:
    runs = _runs(t)
    p95 = M.exclusive_quantile(runs.withColumn("g", F.lit(1)), ["g"], "overlap", 0.95)
    agg = runs.agg(F.count("*").alias("n"), F.round(F.avg("overlap"), 6).alias("mean_overlap"), F.round(F.avg(F.col("same_first").cast("int")), 6).alias("match_rate")).withColumn("g", F.lit(1))
    return agg.join(p95, "g", "left").select("n", "mean_overlap", "match_rate", F.round("quantile", 6).alias("p95"))


@query(f"""WITH {_REL}, e AS (SELECT query_id, bool_or(relevant) AS pool, bool_or(relevant AND rank <= 20) AS fused, bool_or(relevant AND rank <= 5) AS selected FROM r GROUP BY query_id)
SELECT CASE WHEN NOT pool THEN 'absent' WHEN NOT fused THEN 'fused' WHEN NOT selected THEN 'selected' ELSE 'ok' END AS verdict, count(*) AS n FROM e GROUP BY 1""")
def loss_attribution(t: Tables) -> DataFrame:
    rel = F.col("relevant")
    e = _relevant(t).groupBy("query_id").agg(F.bool_or(rel).alias("pool"), F.bool_or(rel & (F.col("rank") <= 20)).alias("fused"), F.bool_or(rel & (F.col("rank") <= 5)).alias("selected"))
    return e.groupBy(M.furthest_failing([(c, F.col(c)) for c in ("pool", "fused", "selected")]).alias("verdict")).agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT user_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS cost, event_type AS unit FROM events)
SELECT user_id, count(*) AS n, round(CASE WHEN bool_and(cost IS NOT NULL) THEN sum(cost) END, 4) AS total_cost, CASE WHEN count(DISTINCT unit) = 1 THEN min(unit) ELSE 'mixed' END AS unit, bool_and(cost IS NOT NULL) AS complete FROM x GROUP BY user_id""")
def cost_rollup(t: Tables) -> DataFrame:
    x = t.events.select("user_id", F.when(F.col("event_type") != "error", F.col("value")).alias("cost"), F.col("event_type").alias("unit"))
    complete = F.bool_and(F.col("cost").isNotNull())
    return x.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.when(complete, F.sum("cost")), 4).alias("total_cost"), F.when(F.countDistinct("unit") == 1, F.min("unit")).otherwise("mixed").alias("unit"), complete.alias("complete"))


@query("""SELECT o_orderpriority AS item, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'completed' WHEN bool_or(o_orderstatus = 'F') THEN 'partial' ELSE 'failed' END AS status, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) AS n FROM orders GROUP BY 1""")
def run_status(t: Tables) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    return t.orders.groupBy(F.col("o_orderpriority").alias("item")).agg(F.when(F.bool_and(done), "completed").when(F.bool_or(done), "partial").otherwise("failed").alias("status"), F.count_if(done).alias("done"), F.count("*").alias("n"))
