"""Legal references of documents as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import refs as R
from weftline.operators.fusion import ranked
from weftline.operators.ranking import first_by


def references(docs: DataFrame, host: str) -> DataFrame:
    """doc_id, ref, place of the references in docs (doc_id, text; one row an id) and of the titles of links to host.

    Texts are scanned once for all kinds and once for links. References come in the order of their kinds, then as they stand in
    the text; equal ones but for case, blanks and dots count once. Time is linear in the number of references. Null texts have none.
    """
    last = len(R.KINDS)
    hits = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(R.ANY_KIND), F.lit(0))).alias("at", "found"))
    cited = hits.select("doc_id", "at", F.explode(R.kinds_in(F.col("found"))).alias("x")).select("doc_id", "x.kind", "at", "x.ref")
    links = docs.select("doc_id", F.posexplode(R.link_list(F.col("text"), host)).alias("at", "x")).select("doc_id", F.lit(last).alias("kind"), "at", F.col("x.title").alias("ref"))
    rows = cited.unionByName(links).withColumn("ref", F.trim("ref")).filter("ref <> ''").withColumn("key", F.regexp_replace(F.lower("ref"), "[ .]", ""))
    once = first_by(rows, ["doc_id", "key"], [F.col("kind"), F.col("at")])
    return ranked(once, ["doc_id"], [F.col("kind"), F.col("at")], name="place").select("doc_id", "ref", F.col("place").cast("long").alias("place"))


def links(docs: DataFrame, host: str) -> DataFrame:
    """doc_id, title, url of the markdown links to host in docs (doc_id, text), each url of a document once, as first found."""
    rows = docs.select("doc_id", F.posexplode(R.link_list(F.col("text"), host)).alias("at", "x")).select("doc_id", "at", "x.title", "x.url")
    return first_by(rows, ["doc_id", "url"], [F.col("at")]).select("doc_id", "title", "url")
