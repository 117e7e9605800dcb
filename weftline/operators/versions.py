"""Canonical versions: a graph in which each version names the one that it is a version of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.scratch import Scratch


def canonical(links: DataFrame) -> DataFrame:
    """version, canonical, hops, error of every version in links (version, canonical).

    Links are followed to their end by pointer jumping: in each round every version takes over what its present target points to,
    so that chains of n links take log2(n) rounds, each written to the shared folder. A version that names several others is a
    ``contradiction``: it isn't followed, and others end there. Those that lead into a ``cycle`` are what is left when a round
    settles no version. Both have no canonical. A version that names itself is its own; nulls on either side are left out.
    """
    scratch = Scratch(links.sparkSession, "versions")
    named = links.filter("version is not null and canonical is not null").groupBy("version").agg(F.min("canonical").alias("target"), F.max("canonical").alias("other"))
    named = scratch.save(named, "links")
    wrong = named.filter("target <> other").select("version")
    moves = scratch.save(named.filter("target = other and target <> version").select("version", "target", F.lit(1).cast("long").alias("hops")), "round0")
    sources = moves.select(F.col("version").alias("target"))
    last, left, i = None, moves.join(sources, "target", "left_semi").count(), 0
    while left and left != last:
        ahead = moves.select(F.col("version").alias("target"), F.col("target").alias("__t"), F.col("hops").alias("__h"))
        moved = moves.join(ahead, "target", "left").select("version", F.coalesce("__t", "target").alias("target"), (F.col("hops") + F.coalesce("__h", F.lit(0))).alias("hops"))
        before, i = f"round{i}", i + 1
        moves = scratch.save(moved, f"round{i}")
        if i > 1:
            scratch.drop(before)
        last, left = left, moves.join(sources, "target", "left_semi").count()
    ended = moves.join(sources.withColumn("__open", F.lit(True)), "target", "left")
    cycle = F.col("__open").isNotNull()
    found = ended.select("version", F.when(~cycle, F.col("target")).alias("canonical"), F.when(~cycle, F.col("hops")).alias("hops"), F.when(cycle, "cycle").alias("error"))
    none = F.lit(None).cast("long")
    own = named.filter("target = other and target = version").select("version", F.col("version").alias("canonical"), F.lit(0).cast("long").alias("hops"), F.lit(None).cast("string").alias("error"))
    return found.unionByName(own).unionByName(wrong.select("version", F.lit(None).cast(links.schema["canonical"].dataType).alias("canonical"), none.alias("hops"), F.lit("contradiction").alias("error")))


def replaced(entries: DataFrame, versions: DataFrame, column: str) -> DataFrame:
    """entries with ``column`` replaced by its canonical version where it has one, and ``replaced``: whether it changed."""
    known = versions.filter("canonical is not null").select(F.col("version").alias(column), F.col("canonical").alias("__c"))
    joined = entries.join(known, column, "left")
    new = F.coalesce("__c", column)
    return joined.select(*[new.alias(c) if c == column else F.col(c) for c in entries.columns], F.coalesce(F.col("__c") != F.col(column), F.lit(False)).alias("replaced"))
