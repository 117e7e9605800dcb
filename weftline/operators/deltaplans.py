"""Plans and applications of a delta: scopes, followed contents, reuse, bundles, backfills, derived rows, logs with revisions.

Tables are copy-on-write, as in :mod:`weftline.operators.delta`: each function returns rows and writes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators.delta import reconcile


def scoped_plan(manifest: DataFrame, corpus: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """uid, action: ``reconcile`` with pending rows (listed, not published yet) and, given a scope (uid), all others out of it.

    manifest: as of reconcile, and pending, limbo. A pending row that is stored stays as it is, one that isn't is skipped; a row
    in limbo is never removed.
    """
    plan = reconcile(manifest.drop("pending", "limbo"), corpus).join(manifest.select("uid", "pending", "limbo"), "uid", "left").join(corpus.select("uid", F.lit(True).alias("stored")), "uid", "left")
    waiting = F.when(F.col("stored"), "pending_kept").otherwise("pending_skipped")
    action = F.when(F.coalesce("pending", F.lit(False)), waiting).when(F.coalesce("limbo", F.lit(False)) & F.col("action").isin("remove_abrogated", "stale"), "limbo_kept").otherwise(F.col("action"))
    if scope is not None:
        plan = plan.join(scope.select("uid", F.lit(True).alias("inside")).distinct(), "uid", "left")
        action = F.when(F.col("inside").isNull(), "out_of_scope").otherwise(action)
    return plan.select("uid", action.alias("action"))


def legal_plan(texts: DataFrame, contents: DataFrame, aliases: DataFrame, corpus: DataFrame, most_stale: float = 0.3) -> DataFrame:
    """uid, action for the articles of the listed texts.

    texts: text_id; contents: text_id, article_id, version (the articles that tables of contents name); aliases: alias, uid
    (an article's other names); corpus: article_id, text_id, version, n_chunks.

    Articles are known by their uid on both sides. new: named, not stored; changed: stored in another version or without
    chunks; unchanged; twin: one of several rows of an article that is stored under another of its names (the least name
    stays); stale: stored under a listed text that doesn't name it any more; foreign: stored under a text that isn't listed
    (never removed). If more than ``most_stale`` of a text's stored articles are stale, they are blocked_stale instead.
    """
    names = aliases.select("alias", F.col("uid").alias("canonical")).dropDuplicates(["alias"])

    def named(df: DataFrame) -> DataFrame:
        return df.join(names, df["article_id"] == names["alias"], "left").withColumn("uid", F.coalesce("canonical", "article_id")).drop("alias", "canonical")

    wanted = named(contents.join(texts.select("text_id").distinct(), "text_id", "left_semi")).groupBy("uid").agg(F.max("version").alias("new_version"), F.lit(True).alias("wanted"))
    stored = named(corpus.join(texts.select("text_id", F.lit(True).alias("listed")).distinct(), "text_id", "left"))
    rows = stored.join(wanted, "uid", "full_outer")
    first = F.min("article_id").over(Window.partitionBy("uid"))
    found = F.col("article_id").isNotNull()
    same = F.col("version").eqNullSafe(F.col("new_version")) & (F.col("n_chunks") > 0)
    action = F.when(~found, "new").when(F.col("article_id") != F.col("first"), "twin").when(F.col("wanted"), F.when(same, "unchanged").otherwise("changed")).when(F.col("listed"), "stale").otherwise("foreign")
    judged = rows.withColumn("first", first).withColumn("action", action)
    share = judged.filter(found).groupBy("text_id").agg(F.avg((F.col("action") == "stale").cast("int")).alias("share"))
    guarded = F.when((F.col("action") == "stale") & (F.col("share") > most_stale), "blocked_stale").otherwise(F.col("action"))
    return judged.join(share, "text_id", "left").select("uid", F.coalesce("article_id", "uid").alias("article_id"), guarded.alias("action"))


def reuse(documents: DataFrame, state: DataFrame, fingerprint: Column) -> DataFrame:
    """documents (uid, checksum) with ``reusable``: chunks that need not be made anew, 0 if any.

    state: uid, checksum, fingerprint, n_valid. Content, configuration and the chunks themselves must all be as before.
    Of several states of a document that agree the greatest n_valid counts.
    """
    keys = ["__k", "checksum", "__f"]
    s = state.select(F.upper(F.trim("uid")).alias("__k"), "checksum", F.col("fingerprint").alias("__f"), F.col("n_valid").alias("__n")).filter("checksum <> ''").groupBy(*keys).agg(F.max("__n").alias("__n"))
    keyed = documents.withColumn("__k", F.upper(F.trim("uid"))).withColumn("__f", fingerprint)
    return keyed.join(s, keys, "left").select(*documents.columns, F.coalesce("__n", F.lit(0)).alias("reusable"))


def replace_bundles(tables: dict[str, DataFrame], bundles: dict[str, DataFrame], key: str, ident: str) -> dict[str, DataFrame]:
    """The tables after whole documents came in: 'documents' (key, ident, ...) and tables of their parts (ident, ...).

    A document whose key is stored keeps its stored ident, and the parts that came with it are given that one; all of its old
    parts go, those of other documents stay.
    """
    stored = tables["documents"].groupBy(key).agg(F.min(ident).alias("__old"))
    realigned = bundles["documents"].join(stored, key, "left").withColumn("__new", F.coalesce("__old", ident))
    moves = realigned.select(F.col(ident), F.col("__new"))
    incoming = realigned.withColumn(ident, F.col("__new")).select(bundles["documents"].columns)
    out = {"documents": tables["documents"].join(incoming.select(key), key, "left_anti").unionByName(incoming)}
    for name, parts in tables.items():
        if name != "documents":
            fresh = bundles[name].join(moves, ident).withColumn(ident, F.col("__new")).select(parts.columns)
            out[name] = parts.join(incoming.select(ident), ident, "left_anti").unionByName(fresh)
    return out


def backfill(rows: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with the blank values of columns taken from source where that has some; ``filled`` counts them.

    Of several rows of a key in source the least value of each column is taken.
    """
    s = source.groupBy(key).agg(*[F.min(c).alias(f"__{c}") for c in columns])
    empty = lambda c: F.col(c).isNull() | ((F.trim(F.col(c)) == "") if dict(rows.dtypes)[c] == "string" else F.lit(False))
    can = {c: empty(c) & F.col(f"__{c}").isNotNull() for c in columns}
    joined = rows.join(s, key, "left").withColumn("filled", sum((w.cast("int") for w in can.values()), F.lit(0)))
    return joined.select(*[F.when(can[c], F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in can else F.col(c) for c in rows.columns], "filled")


def derived_plan(articles: DataFrame, derived: DataFrame) -> DataFrame:
    """cid, action of rows made from articles (cid, variant): create, refresh (another variant), keep, and remove of derived
    rows (cid, variant) whose article is gone."""
    both = articles.select("cid", F.col("variant").alias("want"), F.lit(True).alias("a")).join(derived.select("cid", F.col("variant").alias("have"), F.lit(True).alias("d")), "cid", "full_outer")
    action = F.when(F.col("d").isNull(), "create").when(F.col("a").isNull(), "remove").when(F.col("want").eqNullSafe(F.col("have")), "keep").otherwise("refresh")
    return both.select("cid", action.alias("action"))


def apply_plan(corpus: DataFrame, plan: DataFrame, incoming: DataFrame, full: bool) -> tuple[DataFrame, DataFrame]:
    """The corpus (uid, ...) after a plan (uid, action) and the status of each uid.

    new and changed rows come from ``incoming`` (columns of corpus); where it has none the uid has failed, and what is stored of
    it stays. remove and remove_abrogated rows go, stale ones on full runs only.
    """
    gone = ["remove", "remove_abrogated", *(["stale"] if full else [])]
    arrived = incoming.select("uid", F.lit(True).alias("arrived")).distinct()
    wants = F.col("action").isin("new", "changed")
    status = F.when(wants & F.col("arrived").isNull(), "failed").when(wants, "ingested").when(F.col("action").isin(gone), "removed").otherwise("kept")
    judged = plan.join(arrived, "uid", "left").select("uid", "action", status.alias("status"))
    out = judged.filter(F.col("status").isin("ingested", "removed")).select("uid")
    fresh = incoming.join(judged.filter("status = 'ingested'").select("uid"), "uid", "left_semi")
    return corpus.join(out, "uid", "left_anti").unionByName(fresh.select(corpus.columns)), judged


def revise(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The log after changes (key, expected, revision, value) to current (key, revision, value), one change a key.

    A change is taken if it expects the stored revision (null: none stored). rows: key, revision, value, state: current,
    superseded (kept for the audit) or rejected.
    """
    c = current.select(key, F.col("revision").alias("r"), F.col("value").alias("v"))
    both = c.join(changes, key, "full_outer")
    asked = F.coalesce("revision", F.lit(None)).isNotNull()
    taken = asked & F.col("expected").eqNullSafe(F.col("r"))
    row = lambda rev, value, state: F.struct(rev.alias("revision"), value.alias("value"), F.lit(state).alias("state"))
    stored = F.when(F.col("r").isNotNull(), F.when(taken, row(F.col("r"), F.col("v"), "superseded")).otherwise(row(F.col("r"), F.col("v"), "current")))
    change = F.when(asked, F.when(taken, row(F.col("revision"), F.col("value"), "current")).otherwise(row(F.col("revision"), F.col("value"), "rejected")))
    return both.select(key, F.explode(F.array_compact(F.array(stored, change))).alias("x")).select(key, "x.*")


def trace_events(events: DataFrame, columns: list[str]) -> DataFrame:
    """events with chunk_ids and tables: the sorted distinct ids and tables of the chunks in its lists of structs (id, table)."""
    every = F.filter(F.flatten(F.array(*[F.coalesce(F.col(c), F.expr("array()").cast("array<struct<id:string,table:string>>")) for c in columns])), lambda x: ~T.is_blank(x["id"]))
    pick = lambda f: F.array_sort(F.array_compact(F.array_distinct(F.transform(every, lambda x: x[f]))))
    return events.withColumn("chunk_ids", pick("id")).withColumn("tables", pick("table"))


def payload_rows(payloads: DataFrame, schema: str, required: list[str], aliases: DataFrame) -> DataFrame:
    """Rows of JSON payloads (payload_id, payload): fields by schema, id in upper case and under its chronicle's name (aliases:
    alias, uid), and errors: required fields that are blank."""
    p = F.from_json("payload", schema)
    wide = payloads.select("payload_id", p.alias("p")).select("payload_id", "p.*").withColumn("id", F.upper(F.trim("id")))
    errors = F.array_compact(F.array(*[F.when(T.is_blank(F.col(c).cast("string")), F.lit(c)) for c in required]))
    known = aliases.select(F.upper("alias").alias("id"), F.col("uid").alias("__uid")).dropDuplicates(["id"])
    return wide.withColumn("errors", errors).join(known, "id", "left").withColumn("id", F.coalesce("__uid", "id")).drop("__uid")
