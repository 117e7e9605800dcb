"""Queries without SQL against plain-Python twins, or against properties that fix them, on whole small tables."""

import re
import unicodedata
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import pytest

from weftline.plans import registry

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return registry.queries()[name](spark, SF).collect()


def test_chunk_similarity(spark):
    sides = {"user": {}, "assistant": {}}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        if r.role in sides:
            sides[r.role][r.conv_id, r.turn // 2] = r.text
    got = {r.doc_id: r for r in rows(spark, "chunk_similarity")}
    places = defaultdict(set)
    for side in sides.values():
        for conv, place in side:
            places[conv].add(place)
    assert set(got) == set(places)
    for conv, mine in places.items():
        pairs = [(sides["user"].get((conv, p)), sides["assistant"].get((conv, p))) for p in mine]
        scores = [1.0 if a == b else 0.0 if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in pairs]
        r = got[conv]
        assert (r.n_old, r.n_new, r.n_equal) == (sum(a is not None for a, _ in pairs), sum(b is not None for _, b in pairs), sum(a == b for a, b in pairs))
        assert r.mean_similarity == pytest.approx(sum(scores) / len(scores), abs=2e-6)


def test_section_summary(spark):
    sections = rows(spark, "section_split")
    want = defaultdict(lambda: [0, 0, 0])
    for s in sections:
        x = want[s.level]
        x[0], x[1], x[2] = x[0] + 1, x[1] + len(s.body) // 4, x[2] + bool(s.is_indexable)
    assert {r.level: (r.n, r.tokens, r.mean_tokens, r.indexable) for r in rows(spark, "section_summary")} == {k: (n, t, t // n, i) for k, (n, t, i) in want.items()}


def test_random_sample(spark):
    one, two = rows(spark, "random_sample"), rows(spark, "random_sample")
    assert one == two and len(set(one)) == len(one) > 0


def test_clusters(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    cluster = {r.doc_id: r.cluster for r in rows(spark, "tfidf_kmeans")}
    assert set(cluster) == set(docs) and set(cluster.values()) <= {0, 1, 2, 3} and len(set(cluster.values())) > 1
    by_text = defaultdict(set)
    for d, c in cluster.items():
        by_text[docs[d]].add(c)
    assert all(len(x) == 1 for x in by_text.values())  # equal texts are in one cluster
    fold = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()
    seen = Counter()
    for text in docs.values():
        w = re.findall("[a-z0-9]+", fold(text))
        seen.update({*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))})
    terms = rows(spark, "cluster_terms")
    assert Counter(r.cluster for r in terms) == {c: 10 for c in range(4)} and all({r.rank for r in terms if r.cluster == c} == set(range(1, 11)) for c in range(4))
    assert sum(2 <= seen[r.term] <= 0.9 * len(docs) for r in terms) >= 0.9 * len(terms)
