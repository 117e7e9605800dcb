"""Texts beyond what one numpy pass holds, between short ones, through every operator that reads documents."""

import random

from pyspark.sql import functions as F

from weftline.functions import scan
from weftline.llm.decontaminate import decontaminate
from weftline.llm.minhash import near_duplicates
from weftline.llm.packing import pack, tokenizer_path
from weftline.llm.quality_gam import quality_scores
from weftline.llm.quality_rules import quality_rules
from weftline.llm.rlz_dedup import rlz_dedup
from weftline.llm.suffix_dedup import suffix_array_dedup
from weftline.llm.toxicity import toxicity_scores


def test_long_texts(spark):
    rng = random.Random(8)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(320_000)]
    text = " ".join(words)
    assert len(text) > scan.SLICE_BYTES
    rows = [(1, text, "s"), (2, "a short one", "s"), (3, f"new {text}", "s"), (4, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2).withColumn("block", F.lit("clash")).withColumn("cid", F.lit(0))

    cut = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_array_dedup(df).collect()}
    assert cut == {1: (len(text), 0), 2: (11, 0), 3: (len(text) + 4, len(text)), 4: (0, 0)}
    gone = {r.doc_id: (r.n_words, r.n_removed) for r in rlz_dedup(df).collect()}
    assert gone == {1: (len(words), 0), 2: (3, 0), 3: (len(words) + 1, len(words)), 4: (0, 0)}
    rules = {r.doc_id: r.n_words for r in quality_rules(df).collect()}
    assert rules == {1: len(words), 2: 3, 3: len(words) + 1, 4: 0}
    test = spark.createDataFrame([(9, " ".join(words[1000:1040]))], "item_id long, text string")
    hit = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate(df, test).collect()}
    assert hit == {1: (40, 1), 2: (0, 0), 3: (40, 1), 4: (0, 0)}
    near = {r.doc_id: r.component_id for r in near_duplicates(df).collect()}
    assert near == {1: 1, 2: 2, 3: 1, 4: 4}
    from tokenizers import Tokenizer

    want = len(Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids) + 1
    pieces = pack(df).filter("doc_id = 1").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).first()
    assert (pieces.n, pieces["all"]) == (want, want)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality_scores(df, labels).filter("score between 0 and 1").count() == 4
    assert toxicity_scores(df, labels).filter("score between 0 and 1").count() == 4
