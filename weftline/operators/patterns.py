"""Where expected documents get lost: patterns looked for in what each stage of a run let through."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T

#: Stages in order, each with what it means for a pattern to get no further.
STAGES = {"retrieval": "lost_in_rerank", "rerank": "lost_in_aggregation", "context": "rejected_by_selector", "kept": "lost_in_context", "sources": "ok"}
ABSENT, UNJUDGED = "absent", "not_evaluated"


def needles(patterns: DataFrame) -> DataFrame:
    """run_id, pattern, needle of patterns (run_id, pattern): 'A|B' is A or B, each folded; blank alternatives are none."""
    each = patterns.filter("pattern is not null").distinct().select("run_id", "pattern", F.explode(F.split("pattern", r"\|")).alias("needle"))
    return each.withColumn("needle", F.trim(T.fold_letters(F.col("needle")))).filter("needle <> ''")


def pattern_loss(patterns: DataFrame, passed: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """run_id, pattern, verdict, first_rank, overall of the patterns of each run.

    patterns: run_id, pattern; all patterns of a run are wanted, the alternatives of one ('A|B') in any row. passed: run_id, stage
    (of STAGES), rank, text: what each stage let through. A pattern's verdict follows from the last stage that has a row with one of
    its alternatives, whatever earlier ones have; first_rank is its first place in retrieval. overall is ok if all patterns of the
    run are, else the verdict of the failing one that got furthest. runs (run_id) without patterns are not_evaluated.

    Patterns meet the rows of their own run only, and each text is folded once.
    """
    wanted = needles(patterns)
    order = {s: i + 1 for i, s in enumerate(STAGES)}
    number = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])[F.col("stage")]
    rows = passed.select("run_id", number.alias("stage"), "rank", T.fold_letters(F.coalesce("text", F.lit(""))).alias("text")).filter("stage is not null")
    hits = wanted.join(rows, "run_id").filter(F.contains("text", "needle")).groupBy("run_id", "pattern").agg(F.max("stage").alias("far"), F.min(F.when(F.col("stage") == 1, F.col("rank"))).alias("first_rank"))
    judged = wanted.select("run_id", "pattern").distinct().join(hits, ["run_id", "pattern"], "left").withColumn("far", F.coalesce("far", F.lit(0)))
    names = F.array(*[F.lit(x) for x in (ABSENT, *STAGES.values())])
    last = len(STAGES)
    furthest = F.max(F.when(F.col("far") < last, F.col("far"))).over(Window.partitionBy("run_id"))
    out = judged.select("run_id", "pattern", F.get(names, F.col("far")).alias("verdict"), "first_rank", F.get(names, F.coalesce(furthest, F.lit(last))).alias("overall"))
    if runs is None:
        return out
    rest = runs.select("run_id").distinct().join(wanted, "run_id", "left_anti")
    none = lambda kind: F.lit(None).cast(kind)
    return out.unionByName(rest.select("run_id", none("string").alias("pattern"), F.lit(UNJUDGED).alias("verdict"), none(out.schema["first_rank"].dataType).alias("first_rank"), F.lit(UNJUDGED).alias("overall")))
