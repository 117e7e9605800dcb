"""Observability, data quality and usage over events, orders and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import observe as O
from weftline.operators import quality as Q
from weftline.plans.common import Tables, query


@query("SELECT event_type AS stage, count(*) AS n, round(quantile_cont(greatest(value, 0) / 1000, 0.5), 6) AS p50, round(quantile_cont(greatest(value, 0) / 1000, 0.95), 6) AS p95 FROM events GROUP BY 1")
def trace_quantiles(t: Tables) -> DataFrame:
    return O.stage_quantiles(t.events.withColumnRenamed("event_type", "stage"), "stage", "value")


@query("SELECT event_type AS stage, CASE WHEN value > 50 THEN 'slow' ELSE 'ok' END AS status, count(*) AS n, count(DISTINCT user_id) AS turns FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY ALL")
def trace_counts(t: Tables) -> DataFrame:
    newest = t.events.agg(F.max("ts").alias("newest"))
    recent = t.events.crossJoin(F.broadcast(newest)).filter("ts > newest - INTERVAL 24 HOUR")
    return recent.groupBy(F.col("event_type").alias("stage"), F.when(F.col("value") > 50, "slow").otherwise("ok").alias("status")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("turns"))


@query("SELECT 'orders' AS name, CAST(epoch(max(o_orderdate)) AS BIGINT) AS newest, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', CAST(epoch(max(l_shipdate)) AS BIGINT), count(*) FROM lineitem UNION ALL SELECT 'events', CAST(epoch(date_trunc('second', max(ts))) AS BIGINT), count(*) FROM events")
def freshness(t: Tables) -> DataFrame:
    one = lambda df, name, c: df.agg(F.lit(name).alias("name"), F.unix_timestamp(F.max(c).cast("timestamp")).alias("newest"), F.count("*").alias("n"))
    return one(t.orders, "orders", "o_orderdate").unionByName(one(t.lineitem, "lineitem", "l_shipdate")).unionByName(one(t.events, "events", "ts"))


@query("""WITH s AS (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS ids, count(*) FILTER (trim(coalesce(o_orderpriority, '')) = '') AS blank, CAST(datediff('day', CAST(max(o_orderdate) AS DATE), DATE '2030-01-01') AS DOUBLE) AS age FROM orders),
m AS (SELECT count(*) AS missing FROM (SELECT DISTINCT l_orderkey FROM lineitem) l ANTI JOIN orders ON l_orderkey = o_orderkey)
SELECT 'min_rows' AS gate, CAST(n AS DOUBLE) AS observed, CASE WHEN n >= ceil(0.95 * ids) THEN 'pass' ELSE 'fail' END AS status FROM s UNION ALL SELECT 'unique', CAST(n - ids AS DOUBLE), CASE WHEN n = ids THEN 'pass' ELSE 'fail' END FROM s
UNION ALL SELECT 'blank', CAST(blank AS DOUBLE), CASE WHEN blank = 0 THEN 'pass' ELSE 'fail' END FROM s UNION ALL SELECT 'age_days', age, CASE WHEN age <= 365 THEN 'pass' ELSE 'fail' END FROM s UNION ALL SELECT 'coverage', CAST(missing AS DOUBLE), CASE WHEN missing = 0 THEN 'pass' ELSE 'fail' END FROM m""")
def quality_gates(t: Tables) -> DataFrame:
    s = Q.snapshot(t.orders, "o_orderkey", ["o_orderpriority"], "o_orderdate")
    missing = Q.orphans(t.lineitem.select("l_orderkey").distinct(), "l_orderkey", t.orders, "o_orderkey").agg(F.count("*").alias("missing"))
    age = F.datediff(F.lit("2030-01-01").cast("date"), F.col("newest").cast("date"))
    c = F.col
    return Q.gates(s.crossJoin(missing), [Q.gate("min_rows", c("rows"), c("rows") >= F.ceil(0.95 * c("ids"))), Q.gate("unique", c("rows") - c("ids"), c("rows") == c("ids")), Q.gate("blank", c("blank_o_orderpriority"), c("blank_o_orderpriority") == 0), Q.gate("age_days", age, age <= 365), Q.gate("coverage", c("missing"), c("missing") == 0)])


@query("""SELECT lang, count(*) AS total, count(quality) AS filled, count(*) FILTER (quality IS NULL AND trim(coalesce(text, '')) <> '') AS missing_with_text, count(*) FILTER (trim(coalesce(text, '')) = '') AS empty_text, round(100.0 * count(quality) / count(*), 2) AS pct,
CASE WHEN 100.0 * count(quality) / count(*) < 45 THEN 'fail' ELSE 'pass' END AS verdict FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def coverage_audit(t: Tables) -> DataFrame:
    g = Q.coverage(t.documents.join(t.labels, "doc_id", "left"), ["lang"], F.col("quality"), F.col("text"))
    return g.withColumn("verdict", F.when(100.0 * F.col("filled") / F.col("total") < 45, "fail").otherwise("pass"))


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL AND trim(coalesce(text, '')) <> '' ORDER BY doc_id LIMIT 100")
def missing_rows(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left").filter(F.col("quality").isNull() & ~T.is_blank(F.col("text"))).select("doc_id").orderBy("doc_id").limit(100)


@query("SELECT 'orders' AS parent, count(*) AS orphans FROM lineitem ANTI JOIN (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderkey % 10 > 0) USING (l_orderkey) UNION ALL SELECT 'part', count(*) FROM lineitem ANTI JOIN (SELECT p_partkey AS l_partkey FROM part) USING (l_partkey)")
def integrity_antijoin(t: Tables) -> DataFrame:
    a = Q.orphans(t.lineitem, "l_orderkey", t.orders.filter("o_orderkey % 10 > 0"), "o_orderkey").agg(F.lit("orders").alias("parent"), F.count("*").alias("orphans"))
    return a.unionByName(Q.orphans(t.lineitem, "l_partkey", t.part, "p_partkey").agg(F.lit("part").alias("parent"), F.count("*").alias("orphans")))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_key(t: Tables) -> DataFrame:
    return O.latest(t.events, ["user_id", "event_type"], [F.col("ts").desc_nulls_last(), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def lateral_topn(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(w).alias("n")).filter("n <= 3")


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def daily_usage(t: Tables) -> DataFrame:
    return t.events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT CAST(isoyear(ts) AS INT) AS year, CAST(week(ts) AS INT) AS week, count(DISTINCT user_id) AS users, count(*) AS turns FROM events GROUP BY ALL")
def weekly_retention(t: Tables) -> DataFrame:
    return t.events.groupBy(F.extract(F.lit("YEAROFWEEK"), "ts").cast("int").alias("year"), F.weekofyear("ts").alias("week")).agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("turns"))


@query("SELECT user_id, count(*) AS n, arg_min(event_type, (ts, event_id)) AS first_type FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 15")
def top_sessions(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type")).orderBy(F.desc("n"), "user_id").limit(15)


@query("WITH p AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') SELECT count(*) AS events, count(DISTINCT e.user_id) AS users, count(*) FILTER (p.user_id IS NOT NULL) AS adopted_events, count(DISTINCT p.user_id) AS adopters, round(count(DISTINCT p.user_id) / count(DISTINCT e.user_id), 6) AS rate FROM events e LEFT JOIN p USING (user_id)")
def adoption(t: Tables) -> DataFrame:
    buyers = t.events.filter("event_type = 'purchase'").select("user_id").distinct().withColumn("adopter", F.col("user_id"))
    return t.events.join(buyers, "user_id", "left").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.count("adopter").alias("adopted_events"), F.countDistinct("adopter").alias("adopters"), F.round(F.countDistinct("adopter") / F.countDistinct("user_id"), 6).alias("rate"))


@query("SELECT count(*) AS n, round(avg(value), 4) AS mean_value, count(DISTINCT user_id) AS sessions, round(count(*) FILTER (event_type = 'purchase') / count(*), 6) AS purchase_rate, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS error_rate FROM events")
def kpi_panel(t: Tables) -> DataFrame:
    return t.events.agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value"), F.countDistinct("user_id").alias("sessions"), F.round(F.count_if(F.col("event_type") == "purchase") / F.count("*"), 6).alias("purchase_rate"), F.round(F.avg((F.col("event_type") == "error").cast("double")), 6).alias("error_rate"))


@query("WITH g AS (SELECT event_type, median(value) FILTER (value > 0) AS med, min(value) AS lo, max(value) AS hi, sum(value) AS total FROM events GROUP BY event_type) SELECT event_type, round(med, 4) AS med, lo, hi, round(100 * total / sum(total) OVER (), 4) AS share FROM g")
def latency_panel(t: Tables) -> DataFrame:
    """Median of positive values, extremes and share of the total by stage; values are ranked by range, no stage is one task's."""
    from weftline.operators.ranking import values_at

    half = (F.col("n") + 1) / 2
    middle = values_at(t.events.filter("value > 0"), ["event_type"], "value", {"below": F.floor(half), "above": F.ceil(half)})
    g = t.events.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("value").alias("total"))
    panel = g.join(middle, "event_type", "left")
    share = F.round(100 * F.col("total") / F.sum("total").over(Window.partitionBy()), 4)
    return panel.select("event_type", F.round((F.col("below") + F.col("above")) / 2, 4).alias("med"), "lo", "hi", share.alias("share"))


@query("SELECT token, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS token FROM benchmark) WHERE length(token) > 3 GROUP BY token ORDER BY n DESC, token LIMIT 10")
def reasons_topn(t: Tables) -> DataFrame:
    return t.benchmark.select(F.explode(F.split(F.lower("text"), " ")).alias("token")).filter("length(token) > 3").groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(10)


@query("SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'es') AS es, count(*) AS total FROM documents GROUP BY source")
def tag_matrix(t: Tables) -> DataFrame:
    langs = ["en", "de", "fr", "es"]
    wide = t.documents.groupBy("source").pivot("lang", langs).count().na.fill(0)
    return wide.withColumn("total", sum((F.col(x) for x in langs), F.lit(0)).cast("long"))


@query("SELECT event_type, count(*) AS total, max(c) AS most FROM (SELECT user_id, event_type, count(*) OVER (PARTITION BY user_id, event_type) AS c FROM events) GROUP BY event_type")
def distribution_merge(t: Tables) -> DataFrame:
    maps = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("d"))
    return maps.select(F.explode("d").alias("event_type", "n")).groupBy("event_type").agg(F.sum("n").alias("total"), F.max("n").alias("most"))


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) SELECT a.conv_id, a.turn, count(b.turn) AS n_before, string_agg(b.role, ',' ORDER BY b.turn) AS roles FROM o a LEFT JOIN o b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.n <= 4 WHERE a.role = 'user' GROUP BY a.conv_id, a.turn""")
def followup_history(t: Tables) -> DataFrame:
    """The first four turns of a conversation, those before the turn."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    first = t.conversations.withColumn("n", n).filter("n <= 4").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("first"))
    rows = t.conversations.filter("role = 'user'").select("conv_id", "turn").join(first, "conv_id")
    before = rows.select("conv_id", "turn", F.filter("first", lambda x: x["turn"] < F.col("turn")).alias("b"))
    return before.select("conv_id", "turn", F.size("b").cast("long").alias("n_before"), F.nullif(F.array_join(F.transform("b", lambda x: x["role"]), ","), F.lit("")).alias("roles"))


@query("""WITH x AS (SELECT lang, CASE WHEN doc_id % 3 > 0 THEN text END AS target, CASE WHEN doc_id % 5 > 0 THEN source ELSE ' ' END AS origin FROM documents) SELECT lang, count(*) AS total, count(*) FILTER (trim(coalesce(target, '')) = '') AS empty_target, count(*) FILTER (trim(coalesce(target, '')) = '' AND trim(coalesce(origin, '')) <> '') AS fillable FROM x GROUP BY lang""")
def text_audit(t: Tables) -> DataFrame:
    """Rows, those without the target text, and those of them that could be filled from another column."""
    k = F.col("doc_id")
    rows = t.documents.select("lang", F.when(k % 3 > 0, F.col("text")).alias("target"), F.when(k % 5 > 0, F.col("source")).otherwise(" ").alias("origin"))
    empty = T.is_blank(F.col("target"))
    return rows.groupBy("lang").agg(F.count("*").alias("total"), F.count_if(empty).alias("empty_target"), F.count_if(empty & ~T.is_blank(F.col("origin"))).alias("fillable"))


@query("""WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), l AS (SELECT 'events_total' AS name, 'events_total{stage="' || event_type || '"} ' || n AS line FROM c),
o AS (SELECT name, line, row_number() OVER (ORDER BY line) + 1 AS line_no FROM l) SELECT * FROM (SELECT name, line_no, line FROM o UNION ALL SELECT 'events_total', 0, '# HELP events_total Events by stage.' UNION ALL SELECT 'events_total', 1, '# TYPE events_total gauge')""")
def prometheus_text(t: Tables) -> DataFrame:
    samples = t.events.groupBy("event_type").agg(F.count("*").cast("double").alias("value")).select(F.lit("events_total").alias("name"), F.lit("Events by stage.").alias("help"), O.label_text([("stage", F.col("event_type"))]).alias("labels"), "value")
    return O.exposition(samples)


@query("WITH d AS (SELECT DISTINCT lang FROM documents), s AS (SELECT DISTINCT source FROM documents), c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) SELECT lang, source, coalesce(n, 0) AS n, coalesce(n, 0) > 0 AS available FROM d CROSS JOIN s LEFT JOIN c USING (lang, source)")
def dense_grid(t: Tables) -> DataFrame:
    grid = t.documents.select("lang").distinct().crossJoin(t.documents.select("source").distinct())
    counts = t.documents.groupBy("lang", "source").agg(F.count("*").alias("n"))
    return grid.join(counts, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) > 0).alias("available"))


@query("SELECT user_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS negatives, max(ts) FILTER (event_type = 'error') AS newest FROM events GROUP BY user_id HAVING sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) > 0 ORDER BY newest DESC, user_id LIMIT 20")
def negative_queue(t: Tables) -> DataFrame:
    bad = t.events.filter("event_type = 'error'")
    return bad.groupBy("user_id").agg(F.count("*").alias("negatives"), F.max("ts").alias("newest")).orderBy(F.desc("newest"), "user_id").limit(20)


@query("""WITH RECURSIVE e AS (SELECT user_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, n, event_id, s AS opened, 1 AS used, true AS allowed FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, e.event_id, CASE WHEN e.s >= opened + 21600 THEN e.s ELSE opened END, CASE WHEN e.s >= opened + 21600 THEN 1 WHEN used < 2 THEN used + 1 ELSE used END, e.s >= opened + 21600 OR used < 2 FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, event_id, allowed FROM f""")
def rate_limit(t: Tables) -> DataFrame:
    from weftline.streaming.limits import rate_limit as limit

    return limit(t.events.select("user_id", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"), "ts"), most=2, seconds=21600)


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_trace_window(t: Tables) -> DataFrame:
    from weftline.streaming.traces import windowed_counts

    return windowed_counts(t._spark, f"{t._dir}/events.parquet")


@query("""WITH h AS (SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL), m AS (SELECT max(hour) - 2 AS passed FROM h),
e AS (SELECT DISTINCT event_type, hour + k AS until FROM h, (SELECT unnest(range(1, 25)) AS k), m WHERE hour + k <= passed)
SELECT e.event_type, until, CAST(sum(n) AS BIGINT) AS n, round(sum(total), 4) AS total FROM e JOIN h ON e.event_type = h.event_type AND hour BETWEEN until - 24 AND until - 1 GROUP BY ALL""")
def stream_look_back(t: Tables) -> DataFrame:
    """Events and values of the last 24 hours by type, at each full hour but the last two, run as a stream to its end."""
    from weftline.operators.scratch import Scratch
    from weftline.streaming import lookback, traces

    stream = lookback.look_back(traces.read_events(t._spark, f"{t._dir}/events.parquet"))
    return lookback.run(stream, Scratch(t._spark, "lookback").root).withColumn("total", F.round("total", 4))


@query("""WITH RECURSIVE e AS (SELECT user_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s, event_id, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('second', ts), event_id) AS n FROM events),
f AS (SELECT user_id, n, event_id, s AS opened, 1 AS used, true AS allowed FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, e.event_id, CASE WHEN e.s >= opened + 21600 THEN e.s ELSE opened END, CASE WHEN e.s >= opened + 21600 THEN 1 WHEN used < 2 THEN used + 1 ELSE used END, e.s >= opened + 21600 OR used < 2 FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, event_id, allowed FROM f""")
def stream_rate_limit(t: Tables) -> DataFrame:
    from weftline.operators.scratch import Scratch
    from weftline.streaming import lookback, traces

    stream = lookback.limited(traces.read_events(t._spark, f"{t._dir}/events.parquet"), most=2, seconds=21600)
    return lookback.run(stream, Scratch(t._spark, "limit").root)
