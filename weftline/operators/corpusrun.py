"""A run over a corpus of files: hash all of them, parse only what is new or changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.manifest import checksum_plan
from weftline.operators.scratch import Scratch


def _key(c: str = "uid") -> Column:
    return F.upper(F.trim(F.col(c)))


def corpus_run(manifest: DataFrame, files: DataFrame, documents: DataFrame, chunks: DataFrame, parse: Callable[[DataFrame], DataFrame], requested: DataFrame | None = None, force: bool = False) -> dict[str, DataFrame]:
    """'documents' and 'chunks' after the run, 'status' (uid, status, n_chunks) to write back, and 'run' (scope and counts).

    manifest: uid, in_force, valid; files: uid, content (null: it could not be fetched); documents: uid, checksum; chunks: uid,
    chunk_index, text; parse: a plan from rows (uid, content) to rows (uid, chunk_index, text, error). Ids are compared trimmed and
    in upper case; a manifest row is valid or in force if all rows of its id are.

    Only content is hashed of all files; rows that are in force, fetched, and new, changed or without chunks go on to parse. A
    document whose parsing fails, or gives nothing, stays as it was. What the manifest lacks, or no longer has in force, is removed
    with its chunks, but never what could not be fetched or was rejected. With ``requested`` (uid) only those are looked at and
    removed. Chunks without a document are swept on full runs whose manifest is not empty.

    Status: ok, unchanged, error, removed, or acknowledged (not in force and not stored).
    """
    scratch = Scratch(manifest.sparkSession, "corpusrun")
    rows = manifest.filter("uid is not null").groupBy(_key().alias("uid")).agg(F.min(F.coalesce("in_force", F.lit(False))).alias("in_force"), F.min(F.coalesce("valid", F.lit(False))).alias("valid"))
    stored = documents.select(_key().alias("uid"), "checksum")
    held = chunks.groupBy(_key().alias("uid")).agg(F.count("*").alias("n_chunks"))
    if requested is not None:
        wanted = requested.select(_key().alias("uid")).distinct()
        rows, scope = rows.join(wanted, "uid", "left_semi"), wanted
    hashes = files.groupBy(_key().alias("uid")).agg(F.min(F.sha2("content", 256)).alias("checksum"))
    listed = rows.join(hashes, "uid", "left").withColumn("failed", F.col("valid") & F.col("in_force") & F.col("checksum").isNull())
    expected = listed.filter("not valid or in_force").select("uid", "checksum", (F.col("valid") & ~F.col("failed")).alias("listed"), (~F.col("valid") | F.col("failed")).alias("protected"))
    plan = checksum_plan(expected, stored.join(held, "uid", "left").withColumn("complete", F.lit(True)), force=force)
    if requested is not None:
        plan = plan.join(scope, "uid", "left_semi")
    plan = scratch.save(plan, "plan")
    todo = plan.filter("action = 'ingest'").select("uid")
    fresh = files.filter("content is not null").withColumn("uid", _key()).dropDuplicates(["uid"]).select("uid", "content").join(todo, "uid", "left_semi")
    parsed = scratch.save(parse(fresh).select("uid", F.col("chunk_index").cast("int").alias("chunk_index"), "text", "error"), "parsed")
    outcome = todo.join(parsed.groupBy("uid").agg(F.count_if(F.col("error").isNotNull()).alias("errors"), F.count("*").alias("n")), "uid", "left")
    good = scratch.save(outcome.filter("errors = 0").select("uid", F.col("n").alias("n_chunks")).join(hashes, "uid"), "good")
    gone = plan.filter("action = 'delete'").select("uid")
    replaced = good.select("uid").union(gone)
    after = documents.withColumn("uid", _key()).join(replaced, "uid", "left_anti").select("uid", "checksum").unionByName(good.select("uid", "checksum"))
    kept = chunks.withColumn("uid", _key()).select("uid", F.col("chunk_index").cast("int").alias("chunk_index"), "text").join(replaced, "uid", "left_anti")
    if requested is None and not rows.isEmpty():
        kept = kept.join(after.select("uid"), "uid", "left_semi")
    parts = kept.unionByName(parsed.join(good.select("uid"), "uid", "left_semi").drop("error"))

    none = F.lit(None).cast("long")
    says = lambda df, status, n=none: df.select("uid", F.lit(status).alias("status"), n.alias("n_chunks"))
    broken = outcome.join(good.select("uid"), "uid", "left_anti").select("uid").union(listed.filter("not valid or failed").select("uid"))
    same = plan.filter("action = 'unchanged'").join(held, "uid", "left")
    absent = listed.filter("valid and not in_force").select("uid").join(stored.select("uid"), "uid", "left_anti")
    status = says(good, "ok", F.col("n_chunks")).unionByName(says(same, "unchanged", F.col("n_chunks"))).unionByName(says(broken, "error")).unionByName(says(gone, "removed")).unionByName(says(absent, "acknowledged"))
    run = status.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "unchanged", "error", "removed", "acknowledged")]).select(F.lit("full" if requested is None else "document").alias("scope"), "*")
    return {"documents": after, "chunks": parts, "status": status, "run": run}
