"""Queries over graphs of versions, made from the orders of customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import versions as V
from weftline.plans.common import Tables, query


def _links(t: Tables) -> DataFrame:
    """An order is a version of its customer's order before; urgent ones are of none. The first orders of some customers name their
    last, and some orders name a second one."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = t.orders.select(F.col("o_orderkey").alias("version"), "o_custkey", "o_orderpriority", F.lag("o_orderkey").over(w).alias("before"), F.max("o_orderkey").over(Window.partitionBy("o_custkey")).alias("newest"))
    round_trip = (F.col("o_custkey") % 50 == 0) & F.col("before").isNull()
    one = o.select("version", F.when(round_trip, F.col("newest")).when(~F.col("o_orderpriority").startswith("1"), F.col("before")).alias("canonical"))
    return one.unionByName(o.filter("version % 101 = 0").select("version", (F.col("version") + 1).alias("canonical")))


_FOUND = """o AS (SELECT o_orderkey AS version, o_custkey, o_orderpriority, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, max(o_orderkey) OVER (PARTITION BY o_custkey) AS newest FROM orders),
l AS (SELECT version, CASE WHEN o_custkey % 50 = 0 AND before IS NULL THEN newest WHEN o_orderpriority NOT LIKE '1%' THEN before END AS canonical FROM o UNION ALL SELECT version, version + 1 FROM o WHERE version % 101 = 0),
n AS (SELECT version, min(canonical) AS target, max(canonical) AS other FROM l WHERE canonical IS NOT NULL GROUP BY version), e AS (SELECT version, target FROM n WHERE target = other AND target <> version),
walk AS (SELECT version, target, CAST(1 AS BIGINT) AS hops FROM e UNION ALL SELECT walk.version, e.target, hops + 1 FROM walk JOIN e ON walk.target = e.version WHERE hops < 200),
ends AS (SELECT * FROM walk WHERE target NOT IN (SELECT version FROM e)),
found AS (SELECT version, ends.target AS canonical, hops, CASE WHEN ends.target IS NULL THEN 'cycle' END AS error FROM e LEFT JOIN ends USING (version) UNION ALL SELECT version, version, 0, NULL FROM n WHERE target = other AND target = version UNION ALL SELECT version, NULL, NULL, 'contradiction' FROM n WHERE target <> other)"""


@query(f"WITH RECURSIVE {_FOUND} SELECT * FROM found")
def version_canonical(t: Tables) -> DataFrame:
    return V.canonical(_links(t))


@query(f"WITH RECURSIVE {_FOUND} SELECT l_linenumber, coalesce(canonical, l_orderkey) AS l_orderkey, count(*) AS n, count(*) FILTER (canonical <> l_orderkey) AS n_replaced FROM lineitem LEFT JOIN found ON l_orderkey = version GROUP BY 1, 2")
def contents_canonical(t: Tables) -> DataFrame:
    """Entries of tables of contents with the canonical versions of what they name."""
    rows = V.replaced(t.lineitem.select("l_linenumber", "l_orderkey"), V.canonical(_links(t)), "l_orderkey")
    return rows.groupBy("l_linenumber", "l_orderkey").agg(F.count("*").alias("n"), F.count_if("replaced").alias("n_replaced"))
