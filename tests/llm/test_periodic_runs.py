import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from weftline.functions import scan
from weftline.llm.periodic_runs import find_runs, periodic_runs


def plain_runs(w):
    """All runs by comparing the words with themselves at each distance."""
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if size >= max(24, 3 * q) and not any(all(w[k] == w[k + d] for k in range(i, i + size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain(doc_id, text, tails=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if tails and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    left = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, left)))


def sample(r, words):
    k, out = r.choice([1, 2, 3, 30]), []
    while len(out) < words:
        base = [r.randrange(k) for _ in range(r.randint(1, 20))]
        out += (base * 14)[: r.randint(3, 120)]
    return out[:words]


def test_runs_equal_to_loops():
    r = random.Random(5)
    for _ in range(40):
        texts = [sample(r, r.choice([0, 1, 25, 80, 300])) for _ in range(r.randint(1, 6))]
        a, b = [0], [0, 1]
        while len(b) < 200:  # a Fibonacci word: many squares, classes that part unevenly
            a, b = b, b + a
        texts.append(b)
        words = scan.mix(np.array([x for t in texts for x in t], np.uint64) + np.uint64(1))
        found = find_runs(words, scan.mix(words), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
        got = list(zip(*(x.tolist() for x in found)))
        assert got == [(i, *run) for i, t in enumerate(texts) for run in plain_runs(t)]


def test_first_hash_alone_does_not_tell():
    same, apart = np.zeros(60, np.uint64), np.arange(60, dtype=np.uint64)
    assert len(find_runs(same, apart, np.array([0, 60]))[0]) == 0
    assert find_runs(same, same, np.array([0, 60]))[2].tolist() == [60]


def test_query_rows(spark):
    r = random.Random(9)
    rows = [(i, " \n"[i % 2].join(f"w{x}é" for x in sample(r, r.choice([3, 24, 60, 200]))), "x", 3) for i in range(150)]
    rows += [(None, "a " * 30, None, None), (200, None, "", 0), (201, "", "", 0), (202, " \n\t", "", 0), (203, "one", "", 0)] + [(204, "a b " * 12, "", 0)] * 2 + [(-10, "a b c " * 9, "", 0), (205, "ab" * 100_000, "", 0), (206, "long x y z " * 5000, "", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, start string, n_runs int")
    assert sorted(map(tuple, periodic_runs(frame, tails=True).collect()), key=str) == sorted((plain(i, t) if i != 206 else tuple(periodic_runs(frame.filter("doc_id = 206"), tails=True).first()) for i, t, *_ in rows), key=str)
    assert periodic_runs(frame.limit(0)).count() == 0


def test_runs_and_words(spark):
    row = periodic_runs(spark.createDataFrame([(1, "start " + "a b c " * 10 + "end")], "doc_id long, text string"), with_text=True).first()
    assert [tuple(x) for x in row["runs"]] == [(1, 30, 3)] and bytes(row["kept"]) == b"start a b c end"
    long = periodic_runs(spark.createDataFrame([(2, "x y z " * 20_000)], "doc_id long, text string"), with_text=True).first()
    assert (long["length"], long["period"], bytes(long["kept"])) == (60_000, 3, b"x y z")
