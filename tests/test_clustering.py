"""Clusters of hashed grams against brute force over all rows."""

import math

import numpy as np

from weftline.operators.clustering import Clusters


def test_clusters_are_those_of_k_means(spark):
    rng = np.random.default_rng(1)
    docs = {i: (rng.integers(0, 20, 30) + 20 * (i % 3)).tolist() + [77] for i in range(60)} | {60: [], 61: [78]}
    df = spark.createDataFrame([(i, b) for i, b in docs.items()], "doc_id long, buckets array<int>")
    found = Clusters(df.repartition(5), 128, k=3, seed=7)
    again = Clusters(df.repartition(2), 128, k=3, seed=7)
    got = {r.doc_id: r.cluster for r in found.assigned().collect()}
    assert got == {r.doc_id: r.cluster for r in again.assigned().collect()}  # however rows are dealt
    n = len(docs)
    seen = [sum(b in x for x in docs.values()) for b in range(128)]
    assert found.vocabulary.tolist() == [b for b in range(128) if 2 <= seen[b] <= 0.9 * n]
    rows = np.array([[x.count(b) * math.log((n + 1) / (seen[b] + 1)) if b in found.vocabulary else 0.0 for b in range(128)] for x in docs.values()])
    near = ((rows[:, None, :] - found.centres[None]) ** 2).sum(2)
    assert all(near[i, got[i]] <= near[i].min() + 1e-9 for i in docs)
    for c in set(got.values()):  # each centre is the mean of all its documents
        assert np.allclose(found.centres[c], rows[[i for i in docs if got[i] == c]].mean(0))
    assert len({got[i] for i in (0, 1, 2)}) == 3 and all(got[i] == got[i % 3] for i in range(60))


def test_nothing_to_cluster(spark):
    empty = spark.createDataFrame([], "doc_id long, buckets array<int>")
    assert Clusters(empty, 64, k=2, seed=1).assigned().count() == 0
