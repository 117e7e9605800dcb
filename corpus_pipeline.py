"""A corpus pipeline of five stages, each written as Parquet and read back before the next.

toxicity drops what its model rejects; near_dedup keeps the least document of each group of near-duplicates (five-word
shingles, similarity 0.8); decontamination drops documents in which benchmark windows cover a twentieth of the words; pii
puts format-preserving pseudonyms for personal data; packing packs what is left into sequences.

An empty table goes through all stages as an empty table. Columns beside doc_id and text, whatever their names, go along
untouched up to packing (but n_chars, see pii). Texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.decontaminate import drop_contaminated
from weftline.llm.minhash import near_duplicates
from weftline.llm.packing import pack
from weftline.llm.pii import pseudonymise, session_key
from weftline.llm.scratch import Scratch
from weftline.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below 0.5, each row by itself: null and empty texts score 0 and stay, equal rows share their fate."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group, all its rows. Null and wordless texts and rows with a null id are in no group and stay."""
    copies = near_duplicates(docs, size=5, percent=80).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of which less than a twentieth of the words is in benchmark windows; null and wordless ones stay."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, texts under pseudonyms and n_chars, where there is such a column, counted anew; a null text stays null."""
    new = pseudonymise(docs, session_key(spark))
    size = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return new.select(*[size.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece; a null text is one piece of the end id alone, each of equal rows is packed by itself."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]

#: SQL can't express the stages that fit models, hash with Feistel networks or tokenise; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
