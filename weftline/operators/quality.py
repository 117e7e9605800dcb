"""Audits of tables: coverage, blanks, freshness, integrity, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import is_blank


def coverage(df: DataFrame, by: list[str], vector: Column, text: Column) -> DataFrame:
    """total, filled, missing_with_text, empty_text, pct (2 decimals) of a target column by group."""
    g = df.groupBy(*by).agg(F.count("*").alias("total"), F.count(vector).alias("filled"), F.count_if(vector.isNull() & ~is_blank(text)).alias("missing_with_text"), F.count_if(is_blank(text)).alias("empty_text"))
    return g.withColumn("pct", F.round(100.0 * F.col("filled") / F.nullif("total", F.lit(0)), 2))


def snapshot(df: DataFrame, id_col: str, text_cols: list[str], ts: str | None) -> DataFrame:
    """One row: rows, distinct ids, blanks of each column, newest time; one pass."""
    return df.agg(F.count("*").alias("rows"), F.countDistinct(id_col).alias("ids"), *[F.count_if(is_blank(F.col(c))).alias(f"blank_{c}") for c in text_cols], *([F.max(ts).alias("newest")] if ts else []))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key is not null and has no parent."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def gate(name: str, observed: Column, passed: Column) -> Column:
    return F.struct(F.lit(name).alias("gate"), observed.cast("double").alias("observed"), F.when(passed, "pass").otherwise("fail").alias("status"))


def gates(row: DataFrame, checks: list[Column]) -> DataFrame:
    """One row a check: gate, observed, status."""
    return row.select(F.explode(F.array(*checks)).alias("c")).select("c.*")
