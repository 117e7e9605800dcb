"""Traces and metrics: grouped counts, quantiles, latest rows, exposition text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.ranking import values_at


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__n = 1").drop("__n")


def stage_quantiles(df: DataFrame, stage: str, ms: str) -> DataFrame:
    """Exact p50 and p95 of seconds, negative durations as 0, between two values by their distance."""
    rows = df.select(stage, (F.greatest(F.col(ms), F.lit(0.0)) / 1000).alias("s"))
    at = {q: q * (F.col("n") - 1) for q in (0.5, 0.95)}
    picks = {f"{end}{q}": f(p).cast("long") + 1 for q, p in at.items() for end, f in (("lo", F.floor), ("hi", F.ceil))}
    x = values_at(rows, [stage], "s", picks)
    between = {q: F.when(F.floor(p) == p, F.col(f"`lo{q}`")).otherwise((F.ceil(p) - p) * F.col(f"`lo{q}`") + (p - F.floor(p)) * F.col(f"`hi{q}`")) for q, p in at.items()}
    counts = df.groupBy(stage).agg(F.count("*").alias("__n"))
    return counts.join(x, stage, "left").select(stage, F.col("__n").alias("n"), F.round(between[0.5], 6).alias("p50"), F.round(between[0.95], 6).alias("p95"))


def env_label(c: Column, default: str = "unknown") -> Column:
    """Lower case, blanks to underscores, a default for blanks."""
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(F.trim(c)), "\\s+", "_"), F.lit("")), F.lit(default))


def label_text(labels: list[tuple[str, Column]]) -> Column:
    """{a="x",b="y"} with names sorted and values escaped."""
    esc = lambda v: F.replace(F.replace(F.replace(v.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    parts = [F.concat(F.lit(f'{n}="'), esc(v), F.lit('"')) for n, v in sorted(labels, key=lambda x: x[0])]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def exposition(samples: DataFrame) -> DataFrame:
    """name, line_no, line: HELP and TYPE once a metric, then its samples; samples: name, help, labels (text), value (double)."""
    number = F.when(F.col("value") == F.floor("value"), F.format_string("%d", F.col("value").cast("long"))).otherwise(F.col("value").cast("string"))
    body = samples.groupBy("name").agg(F.first("help").alias("help"), F.array_sort(F.collect_list(F.concat(F.col("name"), F.col("labels"), F.lit(" "), number))).alias("lines"))
    text = F.concat(F.array(F.concat(F.lit("# HELP "), F.col("name"), F.lit(" "), F.col("help")), F.concat(F.lit("# TYPE "), F.col("name"), F.lit(" gauge"))), F.col("lines"))
    return body.select("name", F.posexplode(text).alias("line_no", "line"))
