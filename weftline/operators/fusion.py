"""Ranked lists: fusion, pair merging, section aggregation, reranking, diversity, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF = 60


def ranked(df: DataFrame, by: list[str], order: list[Column], k: int | None = None, name: str = "rank") -> DataFrame:
    """df with a dense 1-based position within ``by``, cut at k."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if k is None else out.filter(F.col(name) <= k)


def hybrid_rrf(semantic: DataFrame, lexical: DataFrame, fetch_k: int, alpha: float = 0.5) -> DataFrame:
    """Full outer fusion of two ranked lists (query_id, id, rank); a missing lane counts as rank fetch_k."""
    both = semantic.select("query_id", "id", F.col("rank").alias("semantic_rank")).join(lexical.select("query_id", "id", F.col("rank").alias("lexical_rank")), ["query_id", "id"], "full_outer")
    score = alpha / (RRF + F.coalesce("semantic_rank", F.lit(fetch_k))) + (1 - alpha) / (RRF + F.coalesce("lexical_rank", F.lit(fetch_k)))
    return ranked(both.withColumn("score", F.round(score, 9)), ["query_id"], [F.desc("score"), F.col("id")], fetch_k)


def cross_source_rrf(lanes: DataFrame, n_lanes: int) -> DataFrame:
    """Sum of 1 / (60 + rank) over lanes per (query_id, source, id), scaled by the ceiling of n_lanes first places.

    lanes: query_id, source, id, score, rank, lane ('chunk' or 'heading'). A lane that returned nothing still counts in n_lanes.
    """
    fused = lanes.groupBy("query_id", "source", "id").agg(F.sum(1 / (RRF + F.col("rank"))).alias("rrf"), F.max(F.when(F.col("lane") == "chunk", F.col("score"))).alias("chunk_score"), F.max(F.when(F.col("lane") == "heading", F.col("score"))).alias("heading_score"), F.array_join(F.array_sort(F.collect_set("lane")), "+").alias("path"))
    scaled = fused.withColumn("score", F.round(F.least(F.col("rrf") / F.lit(n_lanes / (RRF + 1)), F.lit(1.0)), 9)).drop("rrf")
    return ranked(scaled, ["query_id"], [F.desc("score"), F.desc(F.coalesce("heading_score", F.lit(0.0))), F.col("source"), F.col("id")])


def pair_dedup(df: DataFrame, pair: Column, k: int) -> DataFrame:
    """The better row of each pair (score, id), then the first k of each query."""
    best = ranked(df.withColumn("pair", pair), ["query_id", "pair"], [F.desc("score"), F.col("id")], 1, "__one").drop("__one")
    return ranked(best, ["query_id"], [F.desc("score"), F.col("id")], k)


def section_aggregate(chunks: DataFrame, section: Column) -> DataFrame:
    """Per query and section .5 max + .3 mean + .2 (chunks / most chunks of a section); the best chunk stands for it."""
    each = chunks.withColumn("section", section).groupBy("query_id", "section").agg(F.max("score").alias("top"), F.avg("score").alias("mean"), F.count("*").alias("n_chunks"), F.min_by("id", F.struct(-F.col("score"), F.col("id"))).alias("best_chunk"))
    most = F.max("n_chunks").over(Window.partitionBy("query_id"))
    scored = each.withColumn("score", F.round(0.5 * F.col("top") + 0.3 * F.col("mean") + 0.2 * F.col("n_chunks") / most, 11)).drop("top", "mean")
    return ranked(scored, ["query_id"], [F.desc("score"), F.col("section")])


def rerank_cut(df: DataFrame, rerank_score: Column, k: int) -> DataFrame:
    """Order by a given score, ties and nulls (identity order: 1 - 0.001 i) by former rank."""
    return ranked(df.withColumn("rerank_score", F.round(F.coalesce(rerank_score, 1 - (F.col("rank") - 1) * 0.001), 6)).withColumnRenamed("rank", "first_rank"), ["query_id"], [F.desc("rerank_score"), F.col("first_rank")], k)


def publisher_diversity(df: DataFrame, n: int) -> DataFrame:
    """The n best rows whose publisher is not the best row's."""
    lead = F.min_by("publisher", F.col("rank")).over(Window.partitionBy("query_id"))
    return ranked(df.withColumn("lead", lead).filter(F.col("publisher") != F.col("lead")), ["query_id"], [F.col("rank")], n, "place")


def selector_topup(ranked_rows: DataFrame, selected: Column, floor: int) -> DataFrame:
    """Per query: chosen positions (0-based, distinct, in range, in order), topped up to ``floor`` from the front.

    selected null: parse failure, the first five; empty: all rejected.
    """
    n = F.col("n")
    groups = ranked_rows.groupBy("query_id").agg(F.count("*").cast("int").alias("n")).withColumn("selected", selected)
    valid = F.array_distinct(F.filter("selected", lambda i: (i >= 0) & (i < n)))
    everything = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    topped = F.slice(F.concat(valid, F.array_except(everything, valid)), 1, F.greatest(F.size(valid), F.lit(floor)))
    kept = F.when(F.col("selected").isNull(), F.slice(everything, 1, 5)).when(F.size("selected") == 0, F.array().cast("array<int>")).otherwise(topped)
    return groups.select("query_id", "n", kept.alias("kept"), (F.col("selected").isNotNull() & (F.size("selected") == 0)).alias("all_rejected"))
