"""Models, rules and formats against plain twins: gradients, boosted tables, hosts, hashes, conversations without an id."""

import math
import random

import numpy as np

from weftline.llm import quality_gam, toxicity, windows
from weftline.llm.chat_format import digest, format_conversations
from weftline.llm.packing import WordTable, pack, tokenizer_path
from weftline.llm.quality_rules import quality_rules
from weftline.llm.rlz_dedup import Runs, parse
from weftline.llm.toxicity import toxicity_scores


def loss(word, sentence, owner, plain, y, w, b):
    """Of a noisy-or over sentences, by loops."""
    total = 0.0
    for d, label in enumerate(y):
        q = (1 - 1 / (1 + math.exp(-b))) ** plain[d]
        for s in (s for s, o in enumerate(owner) if o == d):
            q *= 1 - 1 / (1 + math.exp(-(b + sum(w[x] for x, k in zip(word, sentence, strict=True) if k == s))))
        total -= math.log(1 - q) if label else math.log(q)
    return total / len(y)


def test_noisy_or_descends():
    """One step of the fit goes against the slope found by differences; many lower the loss."""
    rng = random.Random(3)
    owner = np.repeat(np.arange(12), 3)
    sentence = np.repeat(np.arange(36), 2)
    word = np.array([rng.randrange(6) for _ in sentence])
    plain = np.array([rng.randrange(3) for _ in range(12)])
    y = np.array([float(0 in word[np.isin(sentence, np.flatnonzero(owner == d))]) for d in range(12)])
    start = np.zeros(6)
    at = lambda w, b: loss(word, sentence, owner, plain, y, w, b)
    slope = [(at(np.eye(6)[k] * 1e-5, -6.0) - at(-np.eye(6)[k] * 1e-5, -6.0)) / 2e-5 for k in range(6)]
    w, b = toxicity.fit(word, sentence, owner, plain, y, 6, start, steps=1, decay=0.0)
    assert all(np.sign(-w[k]) == np.sign(slope[k]) for k in range(6) if abs(slope[k]) > 1e-6)
    w, b = toxicity.fit(word, sentence, owner, plain, y, 6, start, decay=0.0)
    assert at(w, b) < 0.3 * at(start, -6.0)
    assert w.argmax() == 0


def test_scores_by_loops():
    text = ["Bad word here. Fine words there\nbad", "", "fine"]
    buf = np.frombuffer("".join(text).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in text])])
    s = toxicity.Sentences(buf, offsets)
    words = sorted(set(s.hashes.tolist()))
    weights = np.linspace(-2, 2, len(words))
    model = toxicity.Model(np.array(words, np.uint64), weights, -1.0)
    z = [-1.0 + sum(weights[words.index(h)] for h, k in zip(s.hashes.tolist(), s.sentence, strict=True) if k == j) for j in range(len(s.owner))]
    each = [1 / (1 + math.exp(-x)) for x in z]
    want = [1 - math.prod(1 - p for p, o in zip(each, s.owner, strict=True) if o == d) for d in range(3)]
    assert np.allclose(toxicity.noisy_or(model.sentence_scores(s), s.owner, 3), want)
    assert len(s.owner) == 4 and want[1] == 0


def test_tables_add_up():
    """A score is the sum of table and grid entries; boosting finds a step, and an interaction that no single feature shows."""
    rng = np.random.default_rng(5)
    x = rng.random((600, 3))
    step = quality_gam.fit(x, (x[:, 0] > 0.5).astype(float), pairs=2)
    p = step.score(x)
    assert ((p > 0.5) == (x[:, 0] > 0.5)).mean() > 0.97
    for i in range(0, 600, 97):
        want = step.base + sum(t[sum(e <= x[i, f] for e in step.edges[f])] for f, t in enumerate(step.tables))
        want += sum(g[sum(e <= x[i, a] for e in step.coarse[a]), sum(e <= x[i, b] for e in step.coarse[b])] for (a, b), g in zip(step.pairs, step.grids, strict=True))
        assert math.isclose(step.raw(x[i : i + 1])[0], want, abs_tol=1e-9)
    y = ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    both = quality_gam.fit(x, y, pairs=1)
    assert both.pairs == [(1, 2)]
    assert ((both.score(x) > 0.5) == (y > 0.5)).mean() > 0.9
    g, h = rng.normal(size=9), np.ones(9)
    leaves = quality_gam._tree(g, h, 2)
    cut = max(range(1, 9), key=lambda k: g[:k].sum() ** 2 / (k + 1) + g[k:].sum() ** 2 / (10 - k))
    assert np.allclose(leaves, np.r_[np.full(cut, g[:cut].sum() / (cut + 1)), np.full(9 - cut, g[cut:].sum() / (10 - cut))])


def test_hosts_far_above_the_corpus_go(spark):
    """A host of which a quarter fails is rejected among hosts of a few in a hundred; a small one with one failure in two isn't."""
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(h * 1000 + i, "short" if i % 50 == 0 else good, f"h{h}") for h in range(20) for i in range(200)]
    rows += [(90_000 + i, "short" if i % 4 == 0 else good, "bad") for i in range(300)] + [(95_000, "short", "small"), (95_001, good, "small")]
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    dropped = {r.host for r in got if not r.kept and not r.base_failed}
    assert dropped == {"bad"}
    assert all(not r.kept for r in got if r.base_failed)
    assert {round(r.shrunk_rate, 2) for r in got if r.host == "bad"} <= {0.24, 0.25}


def test_colliding_words(spark):
    """Words and lines that a polynomial hash modulo 2^64 can't tell apart, in rules and packing."""
    bits = [0]
    while len(bits) < 1024:
        bits += [1 - x for x in bits]
    x, y = "".join("ab"[i] for i in bits), "".join("ba"[i] for i in bits)
    df = spark.createDataFrame([(1, f"{x}\n{y}"), (2, f"{x}\n{x}")], "doc_id long, text string").withColumn("source", df_lit("s"))
    assert {r.doc_id: r.n_dup_lines for r in quality_rules(df).collect()} == {1: 0, 2: 1}
    single = spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string")
    crc = {r.doc_id: r.ids_crc32 for r in pack(single).collect()}
    assert crc[1] != crc[2]
    table = WordTable(tokenizer_path())
    for t in (x, y):
        ids, _ = table.encode(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))
        assert ids[:-1].tolist() == table.tokenizer.encode(t, add_special_tokens=False).ids


def df_lit(v):
    from pyspark.sql import functions as F

    return F.lit(v)


def test_factors_are_looked_up_at_heads_and_boundaries():
    """A long copy costs one look-up at its head and those at its end; without the parse nothing is found."""
    rng = np.random.default_rng(7)
    passage = rng.integers(1, 1 << 62, 3000).astype(np.uint64)
    fresh = lambda n: rng.integers(1, 1 << 62, n).astype(np.uint64)
    parts = [passage, np.concatenate([fresh(70), passage, fresh(70)])]
    words, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    counts = np.diff(offsets) - 49
    runs = Runs(words, windows.ranges(offsets[:-1], counts), np.repeat([1, 2], counts), 50)
    asked = []
    find = runs.find
    runs.find = lambda at: asked.append(len(at)) or find(at)
    found = parse(words, offsets, np.array([1, 2]), runs, 50)
    mine = found[counts[0] :]
    assert mine.sum() == 2951 and mine[70 : 70 + 2951].all()
    assert not found[: counts[0]].any()
    assert sum(asked) - counts[0] < 500  # of 3091 windows of the second


def test_conversations_without_an_id_stand_alone(spark):
    rows = [(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "assistant", "b"), (5, 0, "user", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = sorted((r.conv_id or 0, r.n_turns, r.loss_chars) for r in digest(format_conversations(df)).collect())
    assert got == [(0, 1, 0), (0, 1, 0), (0, 1, 1), (5, 1, 0)]
    assert digest(format_conversations(df.limit(0))).count() == 0


def test_labelled_id_on_many_rows(spark):
    rows = [(1, "foul bad thing. ok")] * 400 + [(i, "foul bad thing" if i % 2 else "nice calm thing") for i in range(2, 120)]
    labels = [(i, i % 2) for i in range(1, 120)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity_scores(docs, known).collect()
    assert len(out) == len(rows)
    assert all((r.score >= 0.5) == bool(r.doc_id % 2) for r in out)
