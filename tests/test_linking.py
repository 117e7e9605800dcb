import random
import re
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from weftline.functions import refs
from weftline.operators import citations, deltaplans, linking

WORDS = "agent conge retraite prime du de fonction temps partiel maladie mutation salaire concours grade echelon paie droit".split()


def folded(s):
    return " ".join(re.findall("[a-z0-9]+", (s or "").lower()))


def telling(s):
    return {w for w in folded(s).split() if len(w) > 1 and w not in linking.STOP}


def all_pairs(labels, titles, floor=0.05, least=0.2):
    """Every label with every title, by the rules of entity_link."""
    out = {}
    for q, label, publisher, tag in labels:
        a, best = folded(label), {}
        for c, title, of in titles if a else []:
            b = folded(title)
            if not (a in b or any(w in b for w in sorted(telling(label))[:6])):
                continue
            x, y = telling(label), telling(title)
            share = 0.7 * len(x & y) / len(x) + 0.3 * len(x & y) / len(y) if x and y else 0
            score = 0 if not b else 1 if a == b else 0.92 if a in b or b in a else max(share, 0.85 * SequenceMatcher(None, a, b).ratio())
            if publisher and folded(publisher) == folded(of):
                score = min(1, score + 0.08)
            if tag and (folded(tag) in b or folded(tag) == folded(of)):
                score = min(1, score + 0.06)
            best[c] = max(best.get(c, -1), round(score, 4))
        good = sorted(((s, c) for c, s in best.items() if s >= least), key=lambda x: (-x[0], x[1]))
        if good:
            out[q] = (good[0][1], good[0][0], len(good) > 1 and good[1][0] >= round(good[0][0] - floor, 4))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_entity_link_equals_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(linking, "TITLES", 37)
    monkeypatch.setattr(linking, "LABELS", 11)
    r = random.Random(seed)
    some = lambda n: " ".join(r.choice(WORDS) for _ in range(r.randint(1, n)))
    titles = [(i % 180, some(6) + (f" n{i % 9}" if i % 3 else ""), r.choice(["Alpha", "beta", None])) for i in range(220)] + [(500, None, "alpha"), (501, "", None)]
    labels = [(i, some(5), r.choice(["alpha", "Beta", None]), r.choice([None, "paie"])) for i in range(60)] + [(90, None, None, None), (91, "...", None, None)]
    got = linking.entity_link(spark.createDataFrame(labels, "query_id long, label string, publisher string, tag string").repartition(2), spark.createDataFrame(titles, "cand_id long, title string, publisher string").repartition(3))
    assert {x.query_id: (x.cand_id, x.score, x.ambiguous) for x in got.collect()} == all_pairs(labels, titles)


def test_heading_scores(spark):
    r = random.Random(4)
    some = lambda n: " ".join(r.choice(WORDS) for _ in range(r.randint(0, n)))
    rows = [(i, some(5), r.choice([None, "", some(4)]), some(5)) for i in range(400)] + [(900, None, None, "x"), (901, "a", "b", None), (902, "Congé maladie !", None, "conges maladies")]
    got = {x.id: x.score for x in linking.heading_scores(spark.createDataFrame(rows, "id long, heading string, path string, query string")).collect()}
    for i, heading, path, query in rows:
        h, p, q = (x.lower().replace("é", "e") if x else "" for x in (heading, path, query))
        h, p, q = folded(h), folded(p), folded(q)
        names, x, y = [n for n in (h, p) if n], telling(q), telling(f"{h} {p}")
        both = len(x & y)
        if not q or not names:
            want = 0.0
        elif any(n in q or q in n for n in names):
            want = 1.0
        elif not both:
            want = 0.0
        elif both >= 0.75 * len(x) and both >= 0.45 * len(y):
            want = 1.0
        else:
            alike = max(SequenceMatcher(None, q, n).ratio() for n in names)
            want = min(0.99, max(0.7 * both / len(x) + 0.3 * both / len(y), alike if alike >= 0.72 else 0))
        assert got[i] == pytest.approx(want, abs=2e-6), (heading, path, query)


def test_citations(spark):
    text = "Voir l'ART. L.123-4 2° b), art l123-4, R 12-3, D.300-1 1° ; Article 3 du Décret n° 86-83 du 17 janvier 1986, IV de l'article 5 du décret 2019-12. Annexe 4. fiche 12 [Le code](https://a.example/x) [Le code](https://a.example/x)"
    frame = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    rows = sorted((x.place, x.ref) for x in citations.references(frame, "a.example").collect())
    assert [x for _, x in rows] == ["ART. L.123-4 2° b)", "art l123-4", "L.123-4 2° b)", "l123-4", "D.300-1 1°", "Article 3 du Décret n° 86-83 du 17 janvier 1986", "Décret n° 86-83", "IV de l'article 5 du décret 2019-12", "Annexe 4.", "fiche 12", "Le code"]
    parse = lambda s: tuple(spark.range(1).select(refs.parsed(F.lit(s)).alias("p")).first().p)
    assert parse("Art. L. 123-4 2° b)") == ("CODE", "L123-4", "2° b)", None) and parse(" r.123-4 1° a)") == ("CODE", "R123-4", "1°", None)
    assert parse("Article 3 du décret n° 86-83 du 1 mai 1986") == ("DECRET", "3", None, "86-83") and parse("DÉCRET n°2020-1") == ("DECRET", None, None, "2020-1")
    assert parse("iv de l'article 5 du décret 2019-12") == ("DECRET", "5", "IV", "2019-12") and parse("article 7") == ("DECRET", "7", None, None)
    assert parse("annexe 4.") == ("ANNEXE", "A4", None, None) and parse("Fiche 12") == ("FICHE", "F12", None, None)
    assert parse("loi 84") == ("OTHER", "loi 84", None, None) and parse("Art. R. 123-4")[0] == "OTHER"
    assert [tuple(x) for x in citations.links(frame, "a.example").collect()] == [(1, "Le code", "https://a.example/x")]


def test_citations_grow_linearly(spark):
    def seconds(n):
        frame = spark.createDataFrame([(1, "; ".join(f"L. 123-{i} 2°" for i in range(n)))], "doc_id long, text string")
        start = time.perf_counter()
        assert citations.references(frame, "a.example").count() == n
        return time.perf_counter() - start

    seconds(10)
    assert seconds(20_000) < 20


def test_one_row_a_key(spark):
    docs = spark.createDataFrame([(1, "a", "c1"), (2, "b", "c2"), (3, "c", "")], "doc_id int, uid string, checksum string")
    state = spark.createDataFrame([("A ", "c1", "f", 2), ("a", "c1", "f", 5), ("a", "c0", "f", 9), ("b", "c2", "g", 1), ("c", "", "f", 3)], "uid string, checksum string, fingerprint string, n_valid int")
    assert sorted(tuple(x) for x in deltaplans.reuse(docs, state, F.lit("f")).select("doc_id", "reusable").collect()) == [(1, 5), (2, 0), (3, 0)]
    rows = spark.createDataFrame([(1, None), (2, "x"), (3, " ")], "k int, v string")
    source = spark.createDataFrame([(1, "q"), (1, "p"), (1, None), (2, "y")], "k int, v string")
    assert sorted(tuple(x) for x in deltaplans.backfill(rows, source, "k", ["v"]).collect()) == [(1, "p", 1), (2, "x", 0), (3, " ", 0)]
