import math
import uuid

import pytest
from pyspark.sql import functions as F

from weftline.functions import refs, text
from weftline.operators import chunking, context, delta, evalmetrics, fusion, vectors
from weftline.sources import markup
from weftline.streaming import limits


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_uuid5(spark):
    ns = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    rows = spark.createDataFrame([(n,) for n in ("", "a", "é/1", "x" * 90)], "n string").select("n", text.uuid5(ns, F.col("n")).alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(uuid.UUID(ns), r.n)) for r in rows)


def test_fold_and_markdown(spark):
    assert one(spark, text.fold(F.lit("Élève — N° 3, où ?"))) == "eleve n 3 ou"
    assert one(spark, text.clean_markdown(F.lit(" a  b . \n\n\n\n c ,d "))) == "a b.\n\nc,d"
    assert one(spark, text.first_filled(F.lit(" "), F.lit(None).cast("string"), F.lit("z"))) == "z"


def test_refs(spark):
    assert one(spark, refs.article_mentions(F.lit("art. L 123-4, r.12-3 et L123-4"))) == ["L123-4", "R12-3"]
    assert one(spark, refs.number_range(F.lit("12-3"), F.lit("12-5"))) == ["12-3", "12-4", "12-5"]
    assert one(spark, refs.number_range(F.lit("12-3"), F.lit("13-5"))) == ["12-3", "13-5"]


def test_vectors_search_and_ann_recall(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in centres[i % 12] + 0.4 * rng.normal(size=16)]) for i in range(600)] + [(600, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = df.filter("vec_id % 20 = 0 and vec_id < 600").withColumnRenamed("vec_id", "query_id")
    exact = {(r.query_id, r.id) for r in vectors.vector_topk(df, queries, 10).collect()}
    m = np.array([v for _, v in rows[:-1]], np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = {(i, int(j)) for i in range(0, 600, 20) for j in np.lexsort((np.arange(600), -np.round(m @ m[i], 6)))[:10]}
    assert exact == want
    near = {(r.query_id, r.id) for r in vectors.ann_topk(df, queries, 10).collect()}
    assert len(near & exact) / len(exact) >= 0.9


def test_ann_recall_on_embeddings(spark):
    from weftline.plans import registry

    exact, near = ({(r.query_id, r.id) for r in registry.queries()[name](spark, "/root/testdata/sf0.01").collect()} for name in ("vector_topk", "ann_topk"))
    assert len(near & exact) / len(exact) >= 0.9


def test_hybrid_absent_lane(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, 11, 1)], "query_id long, id long, rank int")
    rows = {r.id: r.score for r in fusion.hybrid_rrf(a, b, 20).collect()}
    assert rows[10] == pytest.approx(0.5 / 61 + 0.5 / 80, abs=1e-8)
    assert rows[11] == pytest.approx(0.5 / 62 + 0.5 / 61, abs=1e-8)


def test_reconcile(spark):
    m = spark.createDataFrame([("a", "h", False, False), ("b", "h", False, False), ("c", None, False, False), ("d", "h", True, False), ("e", "h", True, False), ("f", "x", False, True)], "uid string, content_hash string, abrogated boolean, protected boolean")
    c = spark.createDataFrame([("a", "h", 1), ("c", "h", 1), ("d", "h", 2), ("f", "h", 1), ("g", "h", 1)], "uid string, content_hash string, n_chunks int")
    got = {r.uid: r.action for r in delta.reconcile(m, c).collect()}
    assert got == {"a": "unchanged", "b": "new", "c": "changed", "d": "remove_abrogated", "e": "acknowledged", "f": "protected", "g": "stale"}
    assert {r.action for r in delta.reconcile(m.limit(0), c).collect()} == {"weak_stale"}
    with pytest.raises(ValueError):
        delta.keep_only(c, "uid", c.limit(0))


def test_ndcg_uses_hits_inside_k(spark):
    rows = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, False)], "query_id long, rank int, relevant boolean")
    got = {r.query_id: r for r in evalmetrics.ranking_metrics(rows, 2).collect()}
    assert got[1].ndcg == pytest.approx(1 / math.log2(3), abs=1e-6)
    assert got[1].mrr == 0.5
    assert got[2].ndcg == 0


def test_exclusive_quantile(spark):
    import statistics

    values = [0.1, 0.4, 0.35, 0.8, 0.9]
    df = spark.createDataFrame([(1, v) for v in values] + [(2, 0.3)], "g int, v double")
    got = {r.g: r["quantile"] for r in evalmetrics.exclusive_quantile(df, ["g"], "v", 0.95).collect()}
    assert got[1] == pytest.approx(statistics.quantiles(values, n=20)[18])
    assert got[2] == 0.3


def test_budget_skips_and_goes_on(spark):
    rows = [(1, i + 1, i, f"p{i % 2}", t, 1.0 - i / 10) for i, t in enumerate([500, 900, 400, 90])]
    df = spark.createDataFrame(rows, "query_id long, rank int, id long, publisher string, tokens long, score double")
    assert context.token_budget(df, 1000).first()["ids"] == [0, 2, 3]
    packed = context.pack_context(df, 1000, 100, 1, 1).first()
    assert packed["whole"] == [3]
    assert packed["added"] == [1]
    assert packed["ids"] == [0, 1, 2, 3]


def test_sections():
    md = "intro\n## A\nbody a\n### B\nbody b\n## C\n" + "c" * 60
    s = chunking.markdown_sections(md)
    assert [x["heading_path"] for x in s] == ["Introduction", "A", "A > B", "C"]
    assert [x["parent_index"] for x in s] == [None, None, 1, None]
    assert [x["is_indexable"] for x in s] == [False, False, False, True]
    assert chunking.markdown_sections("") == []
    assert chunking.markdown_sections("just text")[0]["heading"] == "Document"


def test_chunks_cover_text(spark):
    words = " ".join(f"w{i}" for i in range(900))
    df = spark.createDataFrame([(1, words), (2, ""), (3, "a\n\nb")], "doc_id long, text string")
    rows = chunking.paragraph_chunks(df, 300, 0).collect()
    assert "".join(r.chunk for r in rows if r.doc_id == 1) == words
    assert [r.chunk for r in rows if r.doc_id == 3] == ["a\n\nb"]
    assert all(len(r.chunk) <= 300 for r in rows)
    assert " ".join(chunking.legal_chunks(words, 300, 50)).split() == words.split()


def test_markdown_of_page():
    html = "<html><script>x</script><h1>T</h1><p>a<br>b &amp; c</p><ul><li>x</li></ul><nav>n</nav></html>"
    assert markup.to_markdown(html) == "## T\n\na\nb & c\n\n- x"
    assert markup.to_markdown(None) == ""


def test_rate_limit_opens_at_first_attempt(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([0, 10, 20, 61, 62, 63])], "user_id long, event_id long, s long").withColumn("ts", F.col("s"))
    got = {r.event_id: r.allowed for r in limits.rate_limit(df, 2, 60).collect()}
    assert [got[i] for i in range(6)] == [True, True, False, True, True, False]
