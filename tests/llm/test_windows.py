"""Equal segments that a task holds are packed once, whatever the number of documents that share them."""

import numpy as np
import pytest

from weftline.llm import windows
from weftline.llm.scratch import Scratch


@pytest.mark.parametrize("kind", ["bytes", "words"])
def test_hot_passage_is_packed_once_a_block(spark, kind):
    passage = " ".join(f"hot{i}" for i in range(200))
    docs = spark.createDataFrame([(i, f"own{i} {passage} end{i}") for i in range(300)], "doc_id long, text string").repartition(2)
    scratch = Scratch(spark, "windows")
    blocks = windows.make_blocks(scratch, docs, [])
    plan = windows.Plan(kind, 50, 20 if kind == "bytes" else 16, 64)
    bits = scratch.save(windows.shared_keys(plan, blocks, scratch), "bits")
    rows = windows.shared_segments(plan, blocks, bits).collect()
    packed = copies = 0
    for r in rows:
        if r.bucket >= 0:
            cut = np.concatenate([[0], np.cumsum(np.frombuffer(r.sizes, np.int32))])
            owners = {}
            for d, a, b in zip(np.frombuffer(r.docs, np.int64), cut, cut[1:], strict=False):
                owners.setdefault(r.data[a:b], set()).add(int(d))
            packed, copies = packed + len(cut) - 1, copies + sum(len(x) - 1 for x in owners.values())
    local = sum(len(r.starts) // 4 for r in rows if r.bucket < 0)
    assert packed > 0
    assert copies == 0
    assert local > packed  # most copies are runs to remove that their block found by itself


def _texts(spark, n, seed=1):
    import random

    r = random.Random(seed)
    shared = [" ".join(f"s{r.randrange(10**6)}" for _ in range(80)) for _ in range(5)]
    rows = [(i, " ".join([*(f"w{r.randrange(10**6)}" for _ in range(300)), r.choice(shared)])) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2)


@pytest.mark.parametrize("levels", [2, 3])
def test_steps_give_the_same_bits(spark, levels, monkeypatch):
    monkeypatch.setattr(windows, "HELD", 3000)
    scratch = Scratch(spark, "windows")
    blocks = windows.make_blocks(scratch, _texts(spark, 120), [], 20_000)
    one, more = (windows.Plan("bytes", 50, 20, 64, n, 5) for n in (1, levels))
    key = lambda r: (r["unit"], r["bucket"], r["tag"])
    got = [sorted((r.asDict() for r in windows.shared_keys(p, blocks, Scratch(spark, "windows")).collect()), key=key) for p in (one, more)]
    assert got[0] == got[1] and len(got[0]) > 20 and any(any(r["bits"]) for r in got[0])


def test_rows_of_the_key_exchange_follow_the_text(spark, monkeypatch):
    monkeypatch.setattr(windows, "HELD", 3000)
    monkeypatch.setattr(windows, "CHUNK", 0)
    counts = []
    for n in (100, 200, 400):
        scratch = Scratch(spark, "windows")
        blocks = windows.make_blocks(scratch, _texts(spark, n), [], 20_000)
        counts.append(windows.shared_keys(windows.Plan("bytes", 50, 20, n, 1, 8), blocks, scratch).count() / blocks.count())
    assert max(counts) <= 8 and max(counts) - min(counts) < 1


def test_levels():
    assert [windows.key_levels(x) for x in (0, 10**10, 10**11, 10**13, 10**14)] == [1, 1, 2, 3, 3]
