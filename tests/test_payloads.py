"""Payload and manifest operators on literals: odd cases that the oracle queries don't reach."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import manifest as M
from weftline.operators import payloads as P


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_annotate_images(spark):
    df = spark.createDataFrame([(1, "![](a)![x]( b )\n![y](c)![](d) $1 \\"), (2, ""), (3, None), (4, "![](a)")], "id int, text string")
    notes = F.create_map(F.lit("a"), F.struct(F.lit("decorative").alias("kind"), F.lit("said").alias("description")), F.lit("b"), F.struct(F.lit("informative").alias("kind"), F.lit("$0 \\1").alias("description")), F.lit("c"), F.struct(F.lit("informative").alias("kind"), F.lit("").alias("description")))
    assert rows(df.withColumn("out", P.annotate_images(F.col("text"), notes)), "id", "out") == [(1, "[Illustration — $0 \\1]\n![y](c)![](d) $1 \\"), (2, ""), (3, None), (4, "")]


def test_renumber_citations(spark):
    answers = spark.createDataFrame([(1, "a [1] b [4] c [2][1] d [7]"), (2, "no hits [1]"), (3, None)], "answer_id long, answer string")
    hits = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "y"), (1, 4, "x"), (1, 4, "x"), (3, 1, "z")], "answer_id long, position int, key string")
    assert rows(P.renumber_citations(answers, hits), "answer_id", "answer", "n_sources") == [(1, "a [1] b [1] c [2][1] d [7]", 2), (2, "no hits [1]", 0), (3, None, 1)]


def test_batches(spark):
    df = spark.sql("""SELECT 1L AS document_id, 0 AS batch, array(named_struct('index', 2, 'markdown', '![](i)', 'images', array('i', ''))) AS pages, 1 AS pages_processed, 5 AS doc_size_bytes
        UNION ALL SELECT 1L, 1, array(named_struct('index', cast(null AS int), 'markdown', cast(null AS string), 'images', cast(null AS array<string>))), cast(null AS int), 9
        UNION ALL SELECT 2L, 0, cast(null AS array<struct<index:int,markdown:string,images:array<string>>>), cast(null AS int), cast(null AS int)""")
    assert rows(P.batch_pages(df), "document_id", "batch", "markdown", "images") == [(1, 0, "![](page-0002-i)", ["page-0002-i", ""]), (1, 1, "", [])]
    assert rows(P.batch_totals(df), "document_id", "n_pages", "pages_processed", "doc_size_bytes") == [(1, 2, 1, 9), (2, 0, 0, 0)]


def test_contents_articles(spark):
    nested = '{"a": [{"id": "LEGIARTI1", "cid": "LEGIARTI0", "etat": "ABROGE"}, {"b": {"id": "LEGIARTI2", "cid": "LEGIARTI0", "etat": "vigueur", "num": 3, "sub": [{"id": "JORFARTI9", "etat": "X"}]}}, {"id": "LEGIARTI4", "cid": "LEGIARTI0", "etat": "VIGUEUR"}], "id": "LEGITEXT"}'
    df = spark.createDataFrame([("p", nested), ("bad", "{"), ("none", None), ("flat", "3")], "payload_id string, payload string")
    found = rows(P.contents_articles(df), "payload_id", "cid", "state", "number", "version_id", "aliases")
    assert found == [("p", "JORFARTI9", "X", None, "JORFARTI9", ["JORFARTI9"]), ("p", "LEGIARTI0", "vigueur", "3", "LEGIARTI2", ["LEGIARTI0", "LEGIARTI1", "LEGIARTI2", "LEGIARTI4"])]


def test_versions_of_an_article_leave_the_walk_as_one_row():
    nodes = [{"id": f"LEGIARTI{i}", "cid": "LEGIARTI0", "etat": "VIGUEUR" if i in (700, 800) else "ABROGE", "num": i} for i in range(1, 1001)]
    found = P._articles(json.dumps({"a": nodes[:400], "b": [{"c": nodes[400:]}]}), ("LEGIARTI",))
    assert len(list(found)) == 1 and found["LEGIARTI0"][:5] == [True, 699, "LEGIARTI700", "VIGUEUR", "700"] and len(found["LEGIARTI0"][5]) == 1001


def test_payloads_of_one_id_are_merged(spark):
    article = lambda n, state, cid="LEGIARTI0": {"id": f"LEGIARTI{n}", "cid": cid, "etat": state, "num": n}
    data = [("p", [article(3, "X"), article(4, "X")]), ("p", [article(5, "X"), article(6, "vigueur"), article(7, "VIGUEUR")]), ("p", [article(9, "X", "JORFARTI1")]), ("p", [article(8, "VIGUEUR")]), ("q", [article(1, "X"), article(2, "X")]), ("q", [article(3, "X")]), (None, [article(1, "X", "")]), (None, [article(1, "X", "")])]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in data], "payload_id string, payload string").repartition(5)
    found = {tuple(r[:5]) + (tuple(r.aliases),) for r in P.contents_articles(df).select("payload_id", "cid", "state", "number", "version_id", "aliases").collect()}
    ids = lambda *n: tuple(f"LEGIARTI{i}" for i in n)
    assert found == {("p", "LEGIARTI0", "VIGUEUR", "8", "LEGIARTI8", ids(0, 3, 4, 5, 6, 7, 8)), ("p", "JORFARTI1", "X", "9", "LEGIARTI9", ("JORFARTI1", "LEGIARTI9")), ("q", "LEGIARTI0", "X", "2", "LEGIARTI2", ids(0, 1, 2, 3)), (None, "LEGIARTI1", "X", "1", "LEGIARTI1", ids(1))}


def test_manifest_rows(spark):
    data = [(1, "Main", "A", "", "k", ""), (2, " main ", "a", "t", "k", "NON"), (3, "main", "A ", "t", "k", "oui"), (4, "main", None, None, None, "x"), (5, "other", "q", "t", "k", ""), (6, None, "q", "t", "k", "")]
    df = spark.createDataFrame(data, "record_id int, source_corpus string, uid string, title string, storage_key string, repealed string")
    assert rows(M.manifest_rows(df, "main"), "record_id", "status", "errors") == [(1, "in_force", ["title_empty"]), (2, "in_force", []), (3, "repealed", ["uid_duplicate"]), (4, None, ["uid_empty", "title_empty", "storage_key_empty", "repealed_invalid"])]


@pytest.mark.parametrize(("options", "want"), [({}, "unchanged ingest ingest delete ingest"), ({"retry_empty": False}, "unchanged unchanged ingest delete ingest"), ({"force": True}, "ingest ingest ingest delete ingest")])
def test_checksum_plan(spark, options, want):
    expected = spark.createDataFrame([("a", "h", True, False), ("b", "h", True, False), ("c", None, True, False), ("e", "h", True, False), ("p", None, False, True)], "uid string, checksum string, listed boolean, protected boolean")
    current = spark.createDataFrame([("a", "h", 2, None), ("b", "h", 0, True), ("c", "h", 2, True), ("d", "h", 2, True), ("p", "h", 1, True)], "uid string, checksum string, n_chunks int, complete boolean")
    assert rows(M.checksum_plan(expected, current, **options), "uid", "action") == list(zip("abcde", want.split(), strict=True))
