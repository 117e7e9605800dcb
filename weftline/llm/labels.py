"""Training rows of a labels table: a bounded sample that leaves the held-out fifth alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound on the labelled rows that a model here is fitted on.
MAX_LABELLED = 20_000


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is a multiple of 5; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def training_rows(labels: DataFrame, label: str, bound: int = MAX_LABELLED) -> DataFrame:
    """doc_id, y of about ``bound`` labelled rows at most, chosen by a hash of the id; an id labelled twice counts as 1 if any says so."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    share = min(1.0, bound / max(1, known.count()))
    return known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
