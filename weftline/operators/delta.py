"""Keeping a corpus in step with a manifest. Tables are copy-on-write: each function returns the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reconcile(manifest: DataFrame, corpus: DataFrame) -> DataFrame:
    """uid, action of a full outer join by uid.

    manifest: uid, content_hash, abrogated, protected; corpus: uid, content_hash, n_chunks. new, changed (hash differs or is
    unknown, or no chunks), unchanged, remove_abrogated, acknowledged (abrogated, not in the corpus), protected, stale; with
    an empty manifest every corpus row is weak_stale.
    """
    m = manifest.select("uid", F.col("content_hash").alias("new_hash"), "abrogated", "protected", F.lit(True).alias("listed"))
    c = corpus.select("uid", F.col("content_hash").alias("old_hash"), "n_chunks", F.lit(True).alias("stored"))
    empty = manifest.isEmpty()
    listed, stored = F.col("listed").isNotNull(), F.col("stored").isNotNull()
    same = F.col("new_hash").isNotNull() & F.col("new_hash").eqNullSafe(F.col("old_hash")) & (F.col("n_chunks") > 0)
    action = (
        F.when(listed & F.col("protected"), "protected")
        .when(listed & F.col("abrogated"), F.when(stored, "remove_abrogated").otherwise("acknowledged"))
        .when(listed & ~stored, "new")
        .when(listed, F.when(same, "unchanged").otherwise("changed"))
        .otherwise("weak_stale" if empty else "stale")
    )
    return m.join(c, "uid", "full_outer").select("uid", action.alias("action"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep_on_null: list[str] = (), keep_old: list[str] = ()) -> DataFrame:
    """new over old by key. Columns in keep_on_null keep the old value where the new one is null; those in keep_old keep any old value."""
    rest = [c for c in old.columns if c not in key]
    o = old.select(*key, F.struct(*rest).alias("o"))
    n = new.select(*key, F.struct(*rest).alias("n"))

    def pick(c: str) -> Column:
        if c in keep_old:
            return F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))
        if c in keep_on_null:
            return F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
        return F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return o.join(n, key, "full_outer").select(*key, *[pick(c).alias(c) for c in rest])


def cascade_delete(parents: DataFrame, children: DataFrame, key: str, child_key: str, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the ids in ``gone`` (a column named as key)."""
    ids = gone.select(key).distinct()
    return parents.join(ids, key, "left_anti"), children.join(ids.withColumnRenamed(key, child_key), child_key, "left_anti")


def keep_only(df: DataFrame, key: str, keep: DataFrame) -> DataFrame:
    """Rows whose key is in ``keep``; an empty keep list is refused."""
    if keep.isEmpty():
        raise ValueError("an empty list would delete everything")
    return df.join(keep.select(key).distinct(), key, "left_semi")


def occurrence(df: DataFrame, key: list[str], order: list[Column], name: str = "occurrence") -> DataFrame:
    """How many rows of the same key come before each row."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)


def precedence(df: DataFrame, key: list[str], rank: Column, order: list[Column]) -> DataFrame:
    """The row of highest rank of each key, first in order among equals."""
    w = Window.partitionBy(*key).orderBy(rank.desc(), *order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def by_source(df: DataFrame, key: str, rank: Column, order: list[Column], content: str) -> DataFrame:
    """key, the row of the best source (highest rank, last in order among equals), and contradicts: another row of that source
    and key has other content."""
    rest = [c for c in df.columns if c != key]
    g = df.groupBy(key, rank.alias("__rank")).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"), (F.count_distinct(content) > 1).alias("contradicts"))
    return g.groupBy(key).agg(F.max_by(F.struct("r", "contradicts"), "__rank").alias("x")).select(key, "x.r.*", "x.contradicts")


def validate(df: DataFrame, checks: dict[str, Column], key: str, order: list[Column]) -> DataFrame:
    """df with ``errors``: names of failed checks, and 'duplicate' for all but the first row of a key."""
    again = F.row_number().over(Window.partitionBy(key).orderBy(*order)) > 1
    names = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items()]
    return df.withColumn("errors", F.array_compact(F.array(*names, F.when(again & F.col(key).isNotNull(), F.lit("duplicate")))))


def snapshot(ids: DataFrame, bits: int = 16) -> DataFrame:
    """name, n, lo, hi, vectors, mark of each table in ids (name, id long, filled boolean: has the row its vector?).

    mark has two levels, so that no task holds more than the ids of one range of 2^bits: of each range the md5 of its ids in
    order, one a line; then the md5 of the lines range:count:md5 in order of the ranges (id >> bits).
    """
    lines = lambda c: F.array_join(c, "\n")
    part = ids.groupBy("name", F.shiftright("id", bits).alias("part")).agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.sum(F.col("filled").cast("long")).alias("vectors"), F.md5(lines(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")))).alias("mark"))
    marks = F.transform(F.array_sort(F.collect_list(F.struct("part", "n", "mark"))), lambda x: F.concat_ws(":", x["part"].cast("string"), x["n"].cast("string"), x["mark"]))
    return part.groupBy("name").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("vectors").alias("vectors"), F.md5(lines(marks)).alias("mark"))


def least_of(df: DataFrame, by: str, value: str, n: int, deal: int = 64) -> DataFrame:
    """by, least: the n least values of each group in order. Each of ``deal`` parts of a group gives its n least first."""
    part = F.pmod(F.xxhash64(value), F.lit(deal)).cast("int")
    first = df.withColumn("__p", part).withColumn("__n", F.row_number().over(Window.partitionBy(by, "__p").orderBy(value))).filter(F.col("__n") <= n)
    return first.groupBy(by).agg(F.slice(F.array_sort(F.collect_list(value)), 1, n).alias("least"))
