import random
import re

import pytest

from weftline.operators import lexical
from weftline.operators.lexical import FRENCH, Language


def plain_density(text, query, language, need_all, weight=0.1):
    """(covers, score) by looking at all stretches of the text."""
    words = [language.lexeme(w) for w in re.findall("[a-z0-9]+", (text or "").lower())]
    terms = {}
    for phrase, word in re.findall(r'"([^"]*)"|([^"\s]+)', (query or "").lower()):
        found = [(language.lexeme(w), i) for i, w in enumerate(re.findall("[a-z0-9]+", phrase or word))]
        found = [x for x in found if x[0]]
        for term in [found] if phrase else [[x] for x in found]:
            if term:
                terms[tuple((w, i - term[0][1]) for w, i in term)] = None
    n = len(words)
    hits = [{(i, i + t[-1][1]) for i in range(n) if all(i + d < n and words[i + d] == w for w, d in t)} for t in terms]
    holds = lambda a, b: (all if need_all else any)(any(a <= x and y <= b for x, y in h) for h in hits)
    minimal = [(a, b) for a in range(n) for b in range(a, n) if holds(a, b) and not (a < b and (holds(a + 1, b) or holds(a, b - 1)))] if hits else []
    used = {w for t in terms for w, _ in t}
    return len(minimal), sum(weight / (1 + sum(words[i] not in used for i in range(a, b + 1))) for a, b in minimal)


@pytest.mark.parametrize("need_all", [False, True])
def test_cover_density_equals_all_stretches(spark, need_all, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 7)
    r = random.Random(3)
    vocabulary = ["a", "b", "c", "de", "droits", "droit", "agent", "agents", "x1"]
    some = lambda n: r.choice([" ", ", ", "\n"]).join(r.choice(vocabulary) for _ in range(r.randint(0, n)))
    docs = [(i, some(25)) for i in range(50)] + [(100, None), (101, "")]
    queries = [(i, r.choice(['"{0}" {1}', "{0}", '{0} "{1}"', '"{0} {1}" {1}']).format(some(2), some(2))) for i in range(25)] + [(50, None), (51, '"'), (52, "de a")]
    frames = spark.createDataFrame(docs, "id long, text string").repartition(3), spark.createDataFrame(queries, "query_id long, text string")
    got = {(x.query_id, x.id): (x.n_covers, x.score, x.rank) for x in lexical.cover_density_topk(*frames, 1000, FRENCH, need_all).collect()}
    want = {(q, d): found for q, query in queries for d, text in docs if (found := plain_density(text, query, FRENCH, need_all))[0]}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and len(want) > 60
    assert all(got[k][1] == pytest.approx(v[1], abs=2e-6) for k, v in want.items())
    top = lexical.cover_density_topk(*frames, 2, FRENCH, need_all).collect()
    assert {(x.query_id, x.id, x.rank) for x in top} == {(*k, v[2]) for k, v in got.items() if v[2] <= 2}


def test_lexemes():
    assert [FRENCH.lexeme(w) for w in ("agents", "chevaux", "travail", "nomination", "annulation", "rapidement", "donner", "donnees", "de", "les", "prix")] == ["agent", "cheval", "travail", "nomin", "annul", "rapid", "donn", "donn", "", "", "pri"]
    assert Language().lexeme("les") == "les"


def test_many_queries_take_several_passes(spark, monkeypatch):
    r = random.Random(6)
    some = lambda n: " ".join(f"w{r.randrange(40)}" for _ in range(n))
    docs = spark.createDataFrame([(i, some(30)) for i in range(60)] + [(99, "É " * 3)], "id long, text string")
    queries = spark.createDataFrame([(i, some(5)) for i in range(30)] + [(70, "e é"), (71, ""), (72, None)], "query_id long, text string")
    whole = [tuple(x) for x in lexical.lexical_topk(docs, queries, 5).orderBy("query_id", "rank").collect()]
    dense = [tuple(x) for x in lexical.cover_density_topk(docs, queries, 5).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(lexical, "MAX_TOKENS", 20)
    monkeypatch.setattr(lexical, "WIDTH", 9)
    assert [tuple(x) for x in lexical.lexical_topk(docs, queries, 5).orderBy("query_id", "rank").collect()] == whole
    assert [tuple(x) for x in lexical.cover_density_topk(docs, queries, 5).orderBy("query_id", "rank").collect()] == dense
    assert (70, 99, 1, 3, 1) in whole and not any(x[0] in (71, 72) for x in whole)


def test_a_task_keeps_the_k_best_of_all_its_blocks():
    import numpy as np

    r, best, every = np.random.default_rng(8), lexical._Best(3), []
    for block in range(20):
        ids, n = np.arange(block, 400, 20), r.integers(0, 4, 20)
        best.add(5, ids, n, n / 10)
        every += [(-x / 10, i, x) for i, x in zip(ids.tolist(), n.tolist(), strict=True) if x]
    best.add(6, np.arange(2), np.zeros(2, int), np.zeros(2))
    got = [tuple(x.values()) for batch in best.batches() for x in batch.to_pylist()]
    assert sorted((-s, i, n) for q, i, n, s in got if q == 5) == sorted(every)[:3] and {x[0] for x in got} == {5}


def test_markers_are_counted_as_texts_come(spark):
    docs = spark.createDataFrame([(i, None if i % 3 == 0 else f"s{i % 3}", "abc ab" if i % 2 else None) for i in range(60)], "doc_id long, source string, body string")
    markers = spark.createDataFrame([(1, "ab"), (2, ""), (3, "zz"), (4, None), (5, "ab")], "item_id long, marker string")
    got = {x.item_id: (x.n_docs, x.n_sources, x.first_doc) for x in lexical.marker_search(docs, markers).collect()}
    assert got == {1: (30, 2, 1), 2: (60, 2, 0), 3: (0, 0, None), 4: (0, 0, None), 5: (30, 2, 1)}
    assert "MapInArrow" in lexical.marker_search(docs, markers)._jdf.queryExecution().analyzed().toString()
