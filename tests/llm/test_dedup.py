"""Dedup operators against brute force on small tables with nulls, ties, repeated and empty rows."""

import hashlib
import random
import re

import pytest

from weftline.llm.minhash import near_duplicates
from weftline.llm.rlz_dedup import rlz_dedup
from weftline.llm.suffix_dedup import Family, narrow, suffix_array_dedup, widen

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed, n=60):
    """Random documents that share passages; some null, empty, repeated, long, periodic."""
    rng = random.Random(seed)
    words = ["the", "of", "été", "naïve", "x", "alpha", "beta", "gamma", "delta e", "9"] + [f"w{i}" for i in range(120)]
    passages = [[rng.choice(words) for _ in range(rng.randint(40, 140))] for _ in range(6)]
    docs = []
    for i in range(n):
        out = []
        for _ in range(rng.randint(0, 4)):
            if rng.random() < 0.5:
                p = rng.choice(passages)
                a = rng.randint(0, 30)
                out += p[a : rng.randint(a, len(p))]
            out += [rng.choice(words) for _ in range(rng.randint(0, 40))]
        docs.append((i * 3, rng.choice([" ", "\n", "\t "]).join(out)))
    docs += [(1, None), (2, ""), (4, "ab" * 400), (5, "ab" * 300), (7, "z " * 200), (8, "z " * 150), (1000, docs[5][1]), (1001, docs[5][1]), (1001, docs[5][1]), (1002, "\0" * 60 + "q"), (1003, "\0" * 61)]
    return docs


def gone(symbols, first, doc, size):
    out = bytearray(len(symbols))
    for p in range(len(symbols) - size + 1):
        if first[symbols[p : p + size]] < doc:
            out[p : p + size] = b"\1" * size
    return out


def brute(docs, cut, size):
    rows = [(d, cut(t or "")) for d, t in docs]
    first = {}
    for d, s in rows:
        for p in range(len(s) - size + 1):
            first[s[p : p + size]] = min(d, first.get(s[p : p + size], d))
    return [(d, s, gone(s, first, d, size)) for d, s in rows]


@pytest.mark.parametrize("seed,batches", [(1, 4), (2, 1), (3, 3)])
def test_suffix_arrays(spark, seed, batches):
    docs = corpus(seed)
    df = spark.createDataFrame([(t, d, "kept") for d, t in docs], "text string, doc_id long, kept string").repartition(5)
    got = sorted(tuple(r) for r in suffix_array_dedup(df, 50, batches).collect())
    want = []
    for d, b, g in brute(docs, lambda t: t.encode(), 50):
        spans = sum(1 for i, x in enumerate(g) if x and not (i and g[i - 1]))
        want.append((d, len(b), sum(g), spans, hashlib.sha256(bytes(x for x, y in zip(b, g, strict=True) if not y)).hexdigest()))
    assert got == sorted(want)


@pytest.mark.parametrize("seed", [1, 4])
def test_relative_lempel_ziv(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in rlz_dedup(df, 50, with_text=True).collect())
    want = []
    for d, w, g in brute(docs, lambda t: tuple(SPACE.findall(t)), 50):
        kept = " ".join(x for x, y in zip(w, g, strict=True) if not y)
        want.append((d, len(w), sum(g), hashlib.sha256(kept.encode()).hexdigest(), kept))
    assert got == sorted(want)


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_array_dedup(empty).count() == rlz_dedup(empty).count() == near_duplicates(empty).count() == 0
    df = spark.createDataFrame([(None, "a b " * 60), (1, "a b " * 60), (None, None)], "doc_id long, text string")
    assert sorted(r.n_removed for r in suffix_array_dedup(df).collect()) == [0, 0, 0]
    assert sorted(r.n_removed for r in rlz_dedup(df).collect()) == [0, 0, 0]
    assert sorted((r.doc_id or 0, r.kept) for r in near_duplicates(df).collect()) == [(0, True), (0, True), (1, True)]


def test_order_in_three_or_four_bytes():
    import numpy as np

    for top in (5, 1 << 24, (1 << 24) + 9):
        order = np.array([0, 3, top])
        assert (widen(narrow(order)) == order).all()
    assert len(widen(narrow(np.zeros(0, np.int64)))) == 0


def components(docs, size, percent):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = {}
    for d, t in docs:
        w = SPACE.findall(lower(t))
        sets[d] = frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a1, b1 = find(a), find(b)
                root[max(a1, b1)] = min(a1, b1)
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in ids)


@pytest.mark.parametrize("seed,size", [(1, 2), (2, 5), (3, 1)])
def test_near_duplicates(spark, seed, size):
    rng = random.Random(seed)
    docs = []
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 9)) for _ in range(rng.randint(3, 60))] for _ in range(12)]
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(["NEW", "other", "q"])
        docs.append((i, " ".join(w)))
    docs += [(200, None), (201, ""), (202, "One"), (203, "one"), (204, " \n")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in near_duplicates(df, size, 80, part=300).collect())
    assert got == components(docs, size, 80)


def test_links_beside_the_hub(spark):
    """Copies link to the original only, which is not the least of them: the later pass must find it."""
    rng = random.Random(9)
    original = [f"t{i}" for i in range(100)]
    docs = []
    for i in range(30):
        w = list(original)
        for j in rng.sample(range(100), 9):
            w[j] = f"n{i}-{j}"
        docs.append((i, " ".join(w)))
    docs.append((99, " ".join(original)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(tuple(r) for r in near_duplicates(df, 1, 80, part=700).collect())
    assert got == components(docs, 1, 80)
    assert {r[2] for r in got} == {0}


def thue_morse(n, a, b):
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join(b if x else a for x in bits[:n])


def test_words_that_collide_modulo_powers_of_two(spark):
    """The Thue-Morse word and its complement have one polynomial hash modulo 2^64, whatever the base."""
    x, y = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    df = spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string")
    assert sorted(r.component_id for r in near_duplicates(df, 2, 80).collect()) == [1, 2]
    assert sorted(r.component_id for r in near_duplicates(df, 1, 80).collect()) == [1, 2]
    lists = [(1, " ".join([x] * 60)), (2, " ".join([y] * 60)), (3, " ".join(thue_morse(1024, "a", "b"))), (4, " ".join(thue_morse(1024, "b", "a")))]
    df = spark.createDataFrame(lists, "doc_id long, text string")
    want = []
    for d, w, g in brute(lists, lambda t: tuple(SPACE.findall(t)), 50):
        want.append((d, len(w), sum(g)))
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in rlz_dedup(df, 50).collect()) == sorted(want)


def test_rows_of_one_id_are_one_node(spark):
    """An id with two texts links the copies of both; many equal rows of one id count once; clashing columns are not read."""
    rng = random.Random(3)
    one, two = ([f"{c}{rng.randint(0, 10**6)}" for _ in range(60)] for c in "xy")
    rows = [(7, " ".join(one))] * 300 + [(7, " ".join(two)), (3, " ".join(one[:-1])), (9, " ".join(two + ["z"])), (11, "else")]
    rows += [(20, " ".join(one[1:]))] * 200
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, cid int, component string").repartition(3)
    got = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(df, 1, 80).collect()}
    assert got == {(7, 3, False), (3, 3, True), (9, 3, False), (20, 3, False), (11, 11, True)}
    assert near_duplicates(df, 1, 80).count() == len(rows)


def test_chains_and_recall(spark):
    """Near copies that link in chains only, and a dense group most of whose pairs are below the threshold."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randint(0, 10**9)}"
    chain, docs = [word() for _ in range(100)], []
    for i in range(40):
        docs.append((i, " ".join(chain)))
        chain = chain[8:] + [word() for _ in range(8)]
    base = [word() for _ in range(100)]
    for i in range(200):
        w = list(base)
        for j in rng.sample(range(100), rng.randint(5, 18)):
            w[j] = word()
        docs.append((1000 - i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = components(docs, 1, 80)
    for part in (400, 2_000_000):
        assert sorted(tuple(r) for r in near_duplicates(df, 1, 80, part=part).collect()) == want


def test_ids_of_several_texts_are_one_node(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 30))
    base = [[word() for _ in range(40)] for _ in range(8)]
    rows = [(i, " ".join(base[i % 8] + [word()])) for i in range(30)] + [(40, " ".join(base[0])), (40, " ".join(base[1])), (40, " ".join(base[1])), (41, "x"), (41, "x"), (42, None), (42, "x y")]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size=2, percent=80).collect()}
    assert got[40] == got[0] == got[1] == 0 and got[8] == 0 and got[2] == got[10] == 2 and got[41] == 41


def test_classes_are_told_apart_by_both_marks_and_size():
    from weftline.llm.minhash import sets_of

    class Frame:  # what sets_of calls
        def select(self, *_):
            return self

        def mapInArrow(self, work, _):
            return work

    import numpy as np
    import pyarrow as pa

    from weftline.llm.minhash import marks, shingles

    text = b"one two three four"
    h, at = shingles(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 2)
    (a,), (b,) = marks(h, at)
    keys = [(len(h), a, b), (len(h), a, b + 1), (len(h), a + 1, b), (len(h) + 1, a, b)]
    batch = pa.RecordBatch.from_pylist([{"text": text.decode(), "cid": i, "n": int(n), "a": int(x), "b": int(y)} for i, (n, x, y) in enumerate(keys)])
    assert [x for part in sets_of(Frame(), 2)(iter([batch])) for x in part.column("cid").to_pylist()] == [0]


def test_family_takes_batches_in_calls_of_their_own(spark, tmp_path):
    docs = sorted(corpus(6), key=lambda x: x[0]) + [(5000, None), (5001, "new words only")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = {}
    for d, b, g in brute(docs, lambda t: t.encode(), 50):
        want.setdefault(d, []).append((len(b), sum(g)))
    ids = sorted({d for d, _ in docs})
    cuts = [ids[len(ids) * i // 5] for i in range(1, 5)]
    got = {}
    for t in range(5):  # levels 1, 2, 1 + 2, 4, 1 + 4
        mine = [(d, x) for d, x in docs if sum(d >= c for c in cuts) == t]
        family = Family(spark, str(tmp_path / "family"), 50, 8)
        assert family.batches() == t
        for r in family.add_batch(frame(mine)).collect():
            got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed))
    assert {d: sorted(x) for d, x in got.items()} == {d: sorted(x) for d, x in want.items()}
    levels = [p.parent.name for p in (tmp_path / "family").glob("step*/kind=level")]
    assert sorted(levels) == ["step3", "step4"]
    again = Family(spark, str(tmp_path / "family"), 50, 8).add_batch(frame([(1, docs[10][1]), (None, docs[10][1])]), with_text=True).collect()
    assert [(r.doc_id, bytes(r.kept).decode() == docs[10][1]) for r in again if r.doc_id is None] == [(None, True)]
    assert [r.n_removed for r in again if r.doc_id == 1] == [len(docs[10][1].encode()) if len(docs[10][1].encode()) >= 50 else 0]
