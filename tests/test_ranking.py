"""Ranks and quantiles dealt by range, lexical search both ways, markers, rate limits, judge rubric."""

import random

from pyspark.sql import functions as F

from weftline.operators import evalmetrics as M
from weftline.operators import lexical, ranking
from weftline.streaming import limits


def test_places_and_values(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randint(0, 30), i) for i in range(500)] + [("c", 5, 900), ("d", None, 901)]
    df = spark.createDataFrame(rows, "g string, v int, id long").repartition(7)
    got = {r.id: r.place for r in ranking.places(df.filter("v is not null"), ["v", "id"], "place").collect()}
    want = sorted((v, i) for _, v, i in rows if v is not None)
    assert got == {i: k + 1 for k, (_, i) in enumerate(want)}
    at = {r.g: (r.n, r.low, r.mid, r.top) for r in ranking.values_at(df, ["g"], "v", {"low": F.lit(1), "mid": F.floor((F.col("n") + 1) / 2), "top": F.col("n")}).collect()}
    for g in "abc":
        v = sorted(x for k, x, _ in rows if k == g and x is not None)
        assert at[g] == (len(v), v[0], v[(len(v) + 1) // 2 - 1], v[-1])
    assert "d" not in at


def test_lexical_both_ways(spark, monkeypatch):
    rng = random.Random(2)
    words = ["the", "été", "a1", "x"] + [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(300)] + [(300, None)], "id long, text string").repartition(3)
    queries = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))) for i in range(25)] + [(99, None), (98, "nowhere")], "query_id long, text string")
    for f in (lexical.lexical_topk, lexical.heading_topk):
        blocks = sorted(map(tuple, f(docs, queries, 7).collect()))
        monkeypatch.setattr(lexical, "WIDTH", 5)
        assert sorted(map(tuple, f(docs, queries, 7).collect())) == blocks
        monkeypatch.setattr(lexical, "MAX_TOKENS", 0)
        assert sorted(map(tuple, f(docs, queries, 7).collect())) == blocks
        monkeypatch.undo()
        assert blocks


def test_markers(spark):
    docs = spark.createDataFrame([(1, "s", "abc"), (2, "t", "bcd"), (3, None, "xx"), (4, "t", None)], "doc_id long, source string, body string")
    markers = spark.createDataFrame([(1, "bc"), (2, "zz"), (3, ""), (4, "x"), (5, None), (6, "bc")], "item_id long, marker string")
    got = {r.item_id: (r.n_docs, r.n_sources, r.first_doc) for r in lexical.marker_search(docs, markers).collect()}
    assert got == {1: (2, 2, 1), 2: (0, 0, None), 3: (4, 2, 1), 4: (1, 0, 3), 5: (0, 0, None), 6: (2, 2, 1)}


def test_limit_row_by_row(spark):
    rng = random.Random(4)
    rows = [(u, i, s) for u in range(5) for i, s in enumerate(sorted(rng.randint(0, 300) for _ in range(80)))]
    df = spark.createDataFrame([(u, 100 * u + i, s) for u, i, s in rows], "user_id long, event_id long, s long").withColumn("ts", F.col("s"))
    got = {r.event_id: r.allowed for r in limits.rate_limit(df, 3, 20).collect()}
    for u in range(5):
        opened, used = None, 0
        for _, i, s in (r for r in rows if r[0] == u):
            if opened is None or s >= opened + 20:
                opened, used = s, 0
            assert got[100 * u + i] == (used < 3)
            used += used < 3


def test_rubric_caps(spark):
    dims = {"legal_correctness": 0.9, "completeness": 0.9, "gold_answer_alignment": 0.9, "source_support": 0.9}

    def judge(raw=0.95, wrong=False, recall=1.0, hit=1.0, **over):
        cols = M.calibrated(M.RUBRIC, F.lit(raw).cast("double"), {k: F.lit(v).cast("double") for k, v in (dims | over).items()}, F.lit(wrong), F.lit(recall).cast("double"), F.lit(hit))
        return tuple(spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first())

    assert judge() == (0.9, 0.9, True, [])
    assert judge(raw=None, recall=None, hit=0.0) == (0.9, 0.9, True, [])
    assert judge(recall=0.0, hit=0.0) == (0.6, 0.9, True, ["no_expected_source_retrieved"])  # lowers what is stored, not the verdict
    assert judge(recall=0.5)[0] == 0.85
    assert judge(wrong=True)[:3] == (0.6, 0.6, False)
    assert judge(source_support=0.6)[2:] == (False, ["weak_source_support"])
    assert judge(completeness=None)[3] == ["incomplete_answer"]
