"""Queries on small fixtures against brute force: the whole of each input counts."""

import hashlib
import re
import unicodedata
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from weftline.operators import evalmetrics, linking
from weftline.plans import common, corpus, evaluation, payloads, registry
from weftline.plans import delta as plans_delta


def test_text_functions_reach_the_end(spark):
    head = "Élève, où ? " * 40
    texts = {1: head + "un", 2: head + "deux", 3: "court", 4: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.folded, r.bounded) for r in corpus.text_functions_whole(SimpleNamespace(documents=df)).collect()}

    def want(x):
        plain = "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower()
        return " ".join(re.findall("[a-z0-9]+", plain)), x if len(x) <= 40 else f"{x[:31]}_{hashlib.sha1(x.encode()).hexdigest()[:8]}"

    assert got == {i: want(x or "") for i, x in texts.items()}
    assert got[1][1] != got[2][1]


def test_metrics_count_all_relevant_rows(spark):
    vectors = {0: [1.0, 0.0], 1: [1.0, 0.1], 2: [1.0, 0.2], 3: [0.0, 1.0], 20: [0.1, 1.0]} | {30 + i: [-1.0, i / 10] for i in range(9)}
    labels = {i: "b" if i in (1, 20) else "a" for i in vectors}
    df = spark.createDataFrame([(i, v, labels[i]) for i, v in vectors.items()], "vec_id long, embedding array<double>, label string")
    got = {r.query_id: r for r in evaluation.deterministic_metrics_whole(SimpleNamespace(embeddings=df)).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    for q in (0, 20):
        found = sorted(vectors, key=lambda i: (-round(cos(vectors[q], vectors[i]), 6), i))[:10]
        gold = {i for i in vectors if labels[i] == labels[q]}
        hits = [i in gold for i in found]
        assert (got[q].hits, got[q].recall, got[q].precision, got[q].hit_rate, got[q].mrr) == (sum(hits), round(sum(hits) / len(gold), 6), sum(hits) / 10, 1, round(1 / (hits.index(True) + 1), 6))
    assert got[20].hits == 2


def test_set_metrics(spark):
    df = spark.createDataFrame([(1, [3, 4, 4], [9, 4, 3]), (2, [], [1]), (3, [1], [])], "i int, gold array<int>, found array<int>")
    got = {r.i: tuple(r)[1:] for r in df.select("i", *[c.alias(n) for n, c in evalmetrics.set_metrics(F.col("gold"), F.col("found")).items()]).collect()}
    assert got == {1: (2, 1.0, 2 / 3, 1, 0.5), 2: (0, None, 0.0, None, 0.0), 3: (0, 0.0, None, 0, 0.0)}


def test_snapshot_sees_every_row(spark):
    def mark(lang, ids, vectors):
        docs = spark.createDataFrame([(i, lang) for i in ids], "doc_id long, lang string")
        vecs = spark.createDataFrame([(i, [1.0] if v else None) for i, v in vectors], "vec_id long, embedding array<double>")
        return {r.name: tuple(r)[1:] for r in plans_delta.corpus_snapshot(SimpleNamespace(documents=docs, embeddings=vecs)).collect()}

    def want(ids):
        parts = {}
        for i in sorted(ids):
            parts.setdefault(i >> 16, []).append(str(i))
        md5 = lambda x: hashlib.md5("\n".join(x).encode()).hexdigest()
        return md5([f"{p}:{len(x)}:{md5(x)}" for p, x in sorted(parts.items())])

    ids = [5, 70000, 3, 200000, 65535, 65536]
    got = mark("en", ids, [(1, True), (2, False)])
    assert got == {"documents": (6, 3, 200000, None, want(ids)), "embeddings": (2, 1, 2, 1, want([1, 2]))}
    assert mark("en", [4, *ids[1:]], [(1, True), (2, False)])["documents"] != got["documents"]


def test_no_query_is_lost():
    assert {"manifest_errors", "manifest_validation"} <= set(registry.queries()) & set(registry.oracles())

    def manifest_errors(t):
        return t.documents

    with pytest.raises(ValueError, match="manifest_errors"):
        common.query()(manifest_errors)


def test_contents_of_a_long_order(spark):
    lines = spark.range(1, 251).selectExpr("1L AS l_orderkey", "CAST(id AS INT) AS l_linenumber", "id AS l_partkey", "id AS l_suppkey", "'F' AS l_linestatus")
    rows = payloads.contents_articles(SimpleNamespace(lineitem=lines)).collect()
    assert sum(r.aliases.count("-") for r in rows) == 250
    assert {r.version_id for r in rows} == {"LEGIARTI250-250", "LEGIARTI249-249", "LEGIARTI248-248"}


def test_short_labels_are_linked(spark):
    labels = spark.createDataFrame([(1, "RTT"), (2, "CDD"), (3, "loi 84"), (4, "Code général"), (5, "x"), (6, "")], "query_id long, label string")
    titles = spark.createDataFrame([(10, "Guide RTT"), (11, "cdd"), (12, "La loi 84 16"), (13, "code general"), (14, "X"), (15, "")], "cand_id long, title string")
    got = {r.query_id: (r.cand_id, r.score, r.ambiguous) for r in linking.entity_link(labels, titles).collect()}
    assert got == {1: (10, 0.92, False), 2: (11, 1.0, False), 3: (12, 0.92, False), 4: (13, 1.0, False), 5: (14, 1.0, False)}
