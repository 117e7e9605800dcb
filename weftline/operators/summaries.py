"""Summaries for dashboards and reports: counts by column, present values, metric rows, gaps in a dictionary, reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import values as V


def count_by(rows: DataFrame, column: str, blank: str) -> DataFrame:
    """value, n: blank and null values under the name ``blank``."""
    return rows.groupBy(F.coalesce(F.nullif(F.trim(F.col(column).cast("string")), F.lit("")), F.lit(blank)).alias("value")).agg(F.count("*").alias("n"))


def present(rows: DataFrame, columns: list[str]) -> DataFrame:
    """name, present, total of each column, in one pass."""
    one = rows.agg(F.count("*").alias("total"), *[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"c{i}").alias("present")) for i, c in enumerate(columns)])
    return one.select(F.explode(pairs).alias("p"), "total").select("p.name", "p.present", "total")


def children_by(parents: DataFrame, children: DataFrame, key: str, by: str, name: str) -> DataFrame:
    """by, number of children of its parents (0 if none); children are counted before they are joined."""
    counts = children.groupBy(key).agg(F.count("*").alias("__n"))
    return parents.select(key, by).join(counts, key, "left").groupBy(by).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias(name))


def metric_rows(runs: DataFrame, keys: list[str], metrics: list[str], codes: Mapping[str, int], status: str) -> DataFrame:
    """keys, metric, value: one row for each listed metric that is a finite number, and one for the status as a code (-1: unknown)."""
    code = F.coalesce(*[F.when(F.col(status) == k, F.lit(float(v))) for k, v in codes.items()], F.lit(-1.0))
    each = F.array(F.struct(F.lit("status").alias("metric"), code.alias("value")), *[F.struct(F.lit(m).alias("metric"), V.finite(F.col(m)).alias("value")) for m in metrics])
    return runs.select(*keys, F.explode(each).alias("m")).select(*keys, "m.metric", "m.value").filter("value is not null")


def spread(rows: DataFrame, by: str, value: Column, refused: Column) -> DataFrame:
    """by, n, mean, deviation (of the sample, null of one row), refusal_rate."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("deviation"), F.round(F.avg(refused.cast("int")), 6).alias("refusal_rate"))


def unknown_terms(texts: DataFrame, pattern: str, known: DataFrame, least: int) -> DataFrame:
    """term, n, n_texts of the matches of ``pattern`` in texts (id, text) that the dictionary (term) doesn't have."""
    each = texts.select("id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("term")).groupBy("term", "id").agg(F.count("*").alias("k"))
    counts = each.groupBy("term").agg(F.sum("k").alias("n"), F.count("*").alias("n_texts")).filter(F.col("n") >= least)
    return counts.join(known.select("term").distinct(), "term", "left_anti")


def known_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """id, term, meaning of the dictionary's terms (one word each, case matters) that occur in texts (id, text)."""
    words = texts.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("\\w+"), F.lit(0)))).alias("term"))
    return words.join(terms, "term").select("id", "term", "meaning")


def report_rows(checks: DataFrame, fields: list[str], failing: str) -> DataFrame:
    """check, line: a markdown table row for each failing check, with | and line breaks escaped."""
    cell = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return checks.filter(failing).select("check", F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in fields]), F.lit(" |")).alias("line"))
