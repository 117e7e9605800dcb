"""Context packing under a token budget. A query has at most a few dozen candidate sections, so each is one row's array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sections(df: DataFrame) -> DataFrame:
    return df.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "publisher", "tokens", "score"))).alias("sections"))


def greedy(sections: Column, budget: Column) -> Column:
    """struct<ids, used>: sections in order, each taken if it still fits; later smaller ones may fit where one did not."""

    def step(acc: Column, s: Column) -> Column:
        fits = acc["used"] + s["tokens"] <= budget
        return F.when(fits, F.struct(F.array_append(acc["ids"], s["id"]).alias("ids"), (acc["used"] + s["tokens"]).alias("used"))).otherwise(acc)

    return F.aggregate(sections, F.struct(F.array().cast("array<bigint>").alias("ids"), F.lit(0).cast("long").alias("used")), step)


def token_budget(df: DataFrame, budget: int) -> DataFrame:
    """query_id, ids, used; df: query_id, rank, id, publisher, tokens, score."""
    packed = _sections(df).withColumn("p", greedy(F.col("sections"), F.lit(budget).cast("long")))
    return packed.select("query_id", "p.ids", "p.used")


def pack_context(df: DataFrame, budget: int, whole_budget: int, max_whole: int, extra: int) -> DataFrame:
    """query_id, ids (in final order), used, whole (short sections taken first), added (other publishers, beyond the budget).

    First up to max_whole sections of at most whole_budget tokens; then greedily the rest; then up to ``extra`` sections of
    publishers other than the best one's. Order: by score, then rank; the whole ones come last among equals.
    """
    base = _sections(df)
    whole = F.slice(F.filter("sections", lambda s: s["tokens"] <= whole_budget), 1, max_whole)
    step1 = base.withColumn("whole", F.transform(whole, lambda s: s["id"])).withColumn("used1", F.aggregate(whole, F.lit(0).cast("long"), lambda a, s: a + s["tokens"]))
    rest = F.filter("sections", lambda s: ~F.array_contains(F.col("whole"), s["id"]))
    step2 = step1.withColumn("p", greedy(rest, F.lit(budget).cast("long") - F.col("used1")))
    taken = F.concat("whole", "p.ids")
    step3 = step2.withColumn("taken", taken).withColumn("added", F.slice(F.transform(F.filter("sections", lambda s: (s["publisher"] != F.col("sections")[0]["publisher"]) & ~F.array_contains(F.col("taken"), s["id"])), lambda s: s["id"]), 1, extra))
    chosen = F.filter("sections", lambda s: F.array_contains(F.concat("taken", "added"), s["id"]))
    ordered = F.array_sort(F.transform(chosen, lambda s: F.struct((-s["score"]).alias("a"), F.array_contains(F.col("whole"), s["id"]).cast("int").alias("b"), s["rank"].alias("c"), s["id"].alias("id"))))
    return step3.select("query_id", F.transform(ordered, lambda s: s["id"]).alias("ids"), (F.col("used1") + F.col("p.used")).alias("used"), "whole", "added")


def inject_references(packed: DataFrame, references: DataFrame, budget: int) -> DataFrame:
    """packed (query_id, ids, added, used and others) with ``with_refs`` (ids whose references go along) and ``refs_used``.

    references: id, tokens (of a section's references, formatted). They have a budget of their own: sections are gone through as they
    are ordered, but those added for other publishers last, and a section's references are taken whole if they still fit. ``used``
    grows by them.
    """
    each = packed.select("query_id", "added", F.posexplode("ids").alias("pos", "id")).join(references.filter("tokens > 0").select("id", "tokens"), "id")
    place = F.struct(F.array_contains("added", F.col("id")).alias("late"), "pos", "id", F.col("tokens").cast("long").alias("tokens"))
    fold = each.groupBy("query_id").agg(F.array_sort(F.collect_list(place)).alias("sections")).select("query_id", greedy(F.col("sections"), F.lit(budget).cast("long")).alias("p"))
    joined = packed.join(fold, "query_id", "left")
    taken = F.coalesce("p.used", F.lit(0).cast("long"))
    kept = F.coalesce("p.ids", F.array().cast("array<bigint>"))
    return joined.select(*[(F.col("used") + taken).alias("used") if c == "used" else F.col(c) for c in packed.columns], kept.alias("with_refs"), taken.alias("refs_used"))
