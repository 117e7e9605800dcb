import tracemalloc

import numpy as np
import pyarrow as pa

from weftline.operators import vectors


def _pair(q, r, ids):
    row = (np.arange(len(q)).tobytes(), q.tobytes(), ids.tobytes(), r.tobytes())
    return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], names=["q_ids", "q_rows", "r_ids", "r_rows"])


def _all(pair, k):
    return [np.concatenate(x) for x in zip(*vectors._scored(pair, 0, k), strict=True)]


def test_scores_of_a_block_equal_whole_sorting(monkeypatch):
    monkeypatch.setattr(vectors, "STRIP", 500)
    rng = np.random.default_rng(4)
    r = rng.integers(-2, 3, (90, 4)).astype(float)  # many ties
    q, ids = np.concatenate([r[:37], np.full((1, 4), np.nan)]), rng.permutation(90).astype(np.int64)
    for k in (1, 7, 89, 90, 200):
        owner, found, scores = _all(_pair(q, r, ids), k)
        want = np.round(q @ r.T, 6)
        best = np.stack([np.lexsort((ids, -s))[:k] for s in want])
        assert np.array_equal(owner, np.repeat(np.arange(38), best.shape[1])) and np.array_equal(found, ids[best].ravel())
        assert np.array_equal(scores, np.take_along_axis(want, best, 1).ravel(), equal_nan=True)


def test_memory_of_a_pair_of_full_blocks_is_a_strip():
    rng = np.random.default_rng(5)
    pair = _pair(rng.normal(size=(vectors.BLOCK, 16)), rng.normal(size=(vectors.BLOCK, 16)), np.arange(vectors.BLOCK))
    tracemalloc.start()
    n = sum(len(x[0]) for x in vectors._scored(pair, 0, 10))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 10 * vectors.BLOCK and peak < 60_000_000  # all scores of the pair are 134 MB, several times over


def test_vectors_are_searched_once_a_query(spark, monkeypatch):
    from weftline.plans import evaluation, registry

    calls = []
    monkeypatch.setattr(evaluation, "_relevant", lambda t, k=50, f=evaluation._relevant: calls.append(k) or f(t, k))
    for name in ("conformance", "strategy_tournament"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
        assert "MapInArrow" not in plan
    assert calls == [50, 50]


def test_ann_searching_all_cells_is_exact_and_deals_cells_over_tasks(spark):
    from pyspark.sql import functions as F

    rows = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(*[F.sin(F.col("id") * (i + 1.5)) for i in range(5)]).cast("array<float>").alias("embedding"))
    asked = rows.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    found = vectors.ann_topk(rows, asked, 7, cells=12, probes=12)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("RepartitionByExpression [q_cell") == 1 and plan.count("RepartitionByExpression [r_cell") == 1
    want = vectors.vector_topk(rows, asked, 7).drop("group")
    assert {tuple(x) for x in found.select(*want.columns).collect()} == {tuple(x) for x in want.collect()}
