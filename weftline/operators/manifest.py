"""Manifests of files to keep in a corpus: validation of their rows, and the plan that follows from checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest_rows(records: DataFrame, corpus: str) -> DataFrame:
    """record_id, uid, status, errors of the rows of one corpus; a row is valid if errors is empty.

    records: record_id, source_corpus, uid, title, storage_key, repealed (blank, 'non' or 'oui'). Rows of other corpora are
    left out. The first valid row of a uid (letter case aside) wins; later ones are 'uid_duplicate'. Each reason is given.
    """
    clean = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    flag = F.lower(clean("repealed"))
    rows = records.filter(F.lower(clean("source_corpus")) == corpus.strip().lower()).select("record_id", clean("uid").alias("uid"), F.upper(clean("uid")).alias("folded"), F.when(flag == "oui", "repealed").when(flag.isin("", "non"), "in_force").alias("status"), (clean("title") == "").alias("untitled"), (clean("storage_key") == "").alias("unstored"))
    sound = (F.col("uid") != "") & ~F.col("untitled") & ~F.col("unstored") & F.col("status").isNotNull()
    first = rows.filter(sound).groupBy("folded").agg(F.min("record_id").alias("winner"))
    again = F.col("winner").isNotNull() & (F.col("winner") < F.col("record_id"))
    reasons = [F.when(F.col("uid") == "", "uid_empty"), F.when(again, "uid_duplicate"), F.when(F.col("untitled"), "title_empty"), F.when(F.col("unstored"), "storage_key_empty"), F.when(F.col("status").isNull(), "repealed_invalid")]
    return rows.join(first, "folded", "left").select("record_id", "uid", "status", F.array_compact(F.array(*reasons)).alias("errors"))


def checksum_plan(expected: DataFrame, current: DataFrame, retry_empty: bool = True, force: bool = False) -> DataFrame:
    """uid, action: ingest, unchanged, or delete for what the corpus has and the manifest lacks.

    expected: uid, checksum (null: not fetched), protected (its file could not be fetched: never deleted, and not ingested if
    only so listed), listed; current: uid, checksum, n_chunks, complete. retry_empty takes documents without chunks again.
    """
    e = expected.select("uid", F.col("checksum").alias("new"), "listed", "protected")
    c = current.select("uid", F.col("checksum").alias("old"), "n_chunks", F.coalesce("complete", F.lit(True)).alias("complete"), F.lit(True).alias("stored"))
    filled = F.lit(not retry_empty) | (F.coalesce("n_chunks", F.lit(0)) > 0)
    same = F.coalesce(F.lit(not force) & F.col("stored") & (F.col("new") == F.col("old")) & filled & F.col("complete"), F.lit(False))
    listed, safe = F.coalesce("listed", F.lit(False)), F.coalesce("protected", F.lit(False))
    action = F.when(listed, F.when(same, "unchanged").otherwise("ingest")).when(F.col("stored") & ~safe, "delete")
    return e.join(c, "uid", "full_outer").select("uid", action.alias("action")).filter("action is not null")
