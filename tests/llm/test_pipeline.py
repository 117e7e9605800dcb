"""The pipeline's stages, each held against its operator's contract on what it was given."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F
from test_dedup import components
from test_pii import KEY, twin

import corpus_pipeline
from weftline.llm import queries
from weftline.llm.toxicity import toxicity_scores

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
        if name != "packing":
            assert docs.columns == inputs["toxicity"].columns
            assert docs.select("doc_id").exceptAll(inputs[name].select("doc_id")).isEmpty()
    pieces = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("want"))
    assert pieces.filter("n <> want").isEmpty()
    assert pieces.count() == inputs["packing"].count()
    assert inputs["decontamination"].count() <= inputs["near_dedup"].count() <= inputs["toxicity"].count()
    assert inputs["packing"].filter("n_chars <> length(text)").isEmpty()


def test_run_gives_pieces(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    r = con.execute(queries.ORACLES[name])
    names = [c[0] for c in r.description]
    assert got == sorted(repr(tuple(x[names.index(c)] for c in columns)) for x in r.fetchall())


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n int, component_id string, Score double, cid long"


def odd(spark, sf):
    """Documents of sf with copies, near copies, contaminated and private ones, nulls, repeats, a long text and clashing columns."""
    r = random.Random(7)
    docs = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(120).collect()]
    item = max((x.text for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()), key=len)
    words = [f"mot{i}" for i in range(400)]
    near = [r.choice(words) for _ in range(200)]
    more = [(9001, " ".join(near)), (9002, " ".join(near[:-1] + ["autre"])), (9003, f"{item} fin"), (9004, "appel +33 612 345 678 le 03/04/2021 ou 04/25/2021"), (9005, None), (9006, ""), (9007, " \n"), (9008, "x"), (9008, "x"), (None, " ".join(near)), (None, None), (9009, " ".join(r.choice(words) for _ in range(60_000)))]
    rows = docs + [(i, t, "fr", None, len(t) if t is not None else None) for i, t in more]
    return spark.createDataFrame([(*x, "kept", 3, "c", 0.5, 1) for x in rows], SCHEMA).repartition(3)


def test_stages_against_twins(spark):
    spark.conf.set("spark.weftline.pii.secret", KEY)
    docs = odd(spark, SF)
    stages, rows, after = dict(corpus_pipeline.STAGES), lambda df: sorted((tuple(x) for x in df.collect()), key=repr), {}
    for name in ("toxicity", "near_dedup", "decontamination", "pii"):
        after[name] = (docs, spark.createDataFrame(stages[name](spark, docs, SF).collect(), docs.schema))
        docs = after[name][1]
    given, left = after["toxicity"]
    scores = toxicity_scores(given, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1").select("doc_id", F.lit(True).alias("bad")).distinct()
    assert rows(left) == rows(given.join(scores, "doc_id", "left_anti").select(given.columns))

    given, left = after["near_dedup"]
    known = {x.doc_id: x.text for x in given.filter("doc_id is not null").collect()}
    copies = {d for d, _, least, kept in components(sorted(known.items()), 5, 80) if not kept}
    assert rows(left) == sorted((tuple(x) for x in given.collect() if x.doc_id not in copies), key=repr) and 9002 in copies

    given, left = after["decontamination"]
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = cut(x.text)
        for i in range(max(0, len(w) - 12) if len(w) >= 13 else min(1, len(w))):
            windows.setdefault(min(13, len(w)), set()).add(tuple(w[i : i + 13]))
    def dirty(text):
        w = cut(text)
        hit = {p for size, found in windows.items() for i in range(len(w) - size + 1) if tuple(w[i : i + size]) in found for p in range(i, i + size)}
        return bool(hit) and 20 * len(hit) >= len(w)
    assert rows(left) == sorted((tuple(x) for x in given.collect() if not dirty(x.text)), key=repr) and 9003 not in {x.doc_id for x in left.collect()}

    given, left = after["pii"]
    renewed = [(x.doc_id, twin(x.text)[0], *x[2:4], len(twin(x.text)[0]) if x.text is not None else None, *x[5:]) for x in given.collect()]
    assert rows(left) == sorted(renewed, key=repr)

    pieces = stages["packing"](spark, left, SF).collect()
    assert sum(p.start == 0 for p in pieces) == left.count() and sum(p.length for p in pieces if p.doc_id is None) >= 2
    spark.conf.unset("spark.weftline.pii.secret")


def test_stages_on_an_empty_table(spark):
    docs = odd(spark, SF).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
