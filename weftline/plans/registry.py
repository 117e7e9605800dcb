"""Queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.plans import blocks, corpus, delta, deltaplans, evaluation, files, joins, observability, payloads, references, retrieval, sheets, summaries, values, versions  # noqa: F401  they register their queries
from weftline.plans.common import ORACLES, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracles() -> dict[str, str]:
    return ORACLES


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["cross_source_rrf"](spark, sf_dir)
