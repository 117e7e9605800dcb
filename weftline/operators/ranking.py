"""Places in a total order, and other choices of rows, without a partition that holds all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def places(rows: DataFrame, by: list[str], name: str, first: int = 1) -> DataFrame:
    """rows with their place in the order of ``by``.

    Rows are dealt by range; each partition numbers its own, and the counts of the partitions before it are added (one row a
    partition, so the last step is small whatever the table).
    """
    dealt = rows.repartitionByRange(*by).withColumn("__part", F.spark_partition_id())
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*by))
    return dealt.withColumn("__own", own).join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + F.col("__own") + (first - 1)).cast("long")).drop("__part", "__own", "__before")


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order; one pass of partial aggregates, no sort of a key's rows."""
    plain = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*plain), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def sample_rows(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows at random, the same for one seed: those with the least hashes of seed and key."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def values_at(rows: DataFrame, by: list[str], value: str, picks: dict[str, Column]) -> DataFrame:
    """by, n (values that aren't null) and, for each pick (a 1-based rank as a function of n), the value of that rank.

    Exact, and no task holds a group: values are counted, dealt by range and summed up within each part; what comes before a
    part is a sum over the parts.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    dealt = counts.repartitionByRange(*by, "__v").withColumn("__part", F.spark_partition_id())
    parts = dealt.groupBy(*by, "__part").agg(F.sum("__c").alias("__s"))
    group = Window.partitionBy(*by)
    parts = parts.withColumn("__before", F.sum("__s").over(group.orderBy("__part")) - F.col("__s")).withColumn("n", F.sum("__s").over(group)).drop("__s")
    last = F.sum("__c").over(Window.partitionBy(*by, "__part").orderBy("__v"))
    placed = dealt.withColumn("__last", last).join(parts, [*by, "__part"]).withColumn("__last", F.col("__last") + F.col("__before"))
    inside = lambda rank: (rank <= F.col("__last")) & (rank > F.col("__last") - F.col("__c"))
    return placed.groupBy(*by).agg(F.first("n").alias("n"), *[F.max(F.when(inside(rank), F.col("__v"))).alias(name) for name, rank in picks.items()])
