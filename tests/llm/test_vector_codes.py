import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from weftline.llm.vector_codes import Forest, compress

SCHEMA = "vec_id long, embedding array<float>, label int, n int, v string"


def plain(rows, parts=8, entries=16, rounds=6):
    """The contract by loops over Python integers."""
    kept = [(i, [math.floor(4096 * x) for x in e], y) for i, e, y, *_ in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    width = len(kept[0][1]) // parts
    least = {}
    for i, v, _ in kept:
        if i is not None:
            least[i] = min(v, least.get(i, v))
    seeds = [least[i] for i in sorted(least)[:entries]]
    books = [[s[p * width : (p + 1) * width] for s in seeds] for p in range(parts)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), k) for k, entry in enumerate(books[p]))

    for _ in range(rounds):
        new = [list(map(list, b)) for b in books]
        for p in range(parts):
            members = {}
            for _, v, _ in kept:
                part = v[p * width : (p + 1) * width]
                members.setdefault(nearest(p, part)[1], []).append(part)
            for k, got in members.items():
                new[p][k] = [sum(c) // len(got) for c in zip(*got)]
        books = new
    mark = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[nearest(p, v[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in kept]
    error, total = [sum(d for d, _ in f) for f in found], {}
    for (_, _, y), e in zip(kept, error):
        total[y] = total.get(y, 0) + e
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, total[y], mark) for (i, _, y), f, e in zip(kept, found, error)), key=str)


def rows_of(seed, n, dims=16, grid=None):
    r = random.Random(seed)
    value = (lambda: r.choice(grid)) if grid else (lambda: r.uniform(-1, 1))
    return [(i, [value() for _ in range(dims)], r.choice([0, 1, 2, None]), 1, "x") for i in range(n)]


def run(spark, rows, **how):
    return sorted((tuple(r) for r in compress(spark.createDataFrame(rows, SCHEMA), **how).collect()), key=str)


def test_forest_keeps_lower_index_of_ties():
    rng = np.random.default_rng(3)
    for spread in (2, 4, 1000):
        books = rng.integers(-spread, spread, (3, 16, 2))
        books[0, 5:9] = books[0, 2]
        parts, book = rng.integers(-spread - 1, spread + 1, (600, 2)), np.tile(np.arange(3), 200)
        which, far = Forest.grow(books).nearest(parts, book)
        every = ((parts[:, None] - books[book]) ** 2).sum(axis=2)
        assert (which == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()


def test_equal_to_loops(spark):
    for rows in (rows_of(1, 120), rows_of(2, 90, grid=[-0.5, 0.0, 0.25])):
        assert run(spark, rows) == plain(rows)


def test_nulls_ties_repeats_and_few(spark):
    rows = rows_of(4, 40, grid=[-1 / 4096 / 2, 0.1]) + rows_of(5, 3) * 2
    rows += [(None, [0.5] * 16, None, None, None), (50, None, 1, 1, ""), (51, [None] + [0.0] * 15, 1, 1, ""), (52, [float("nan")] * 16, 1, 1, ""), (53, [float("-inf")] * 16, 2, 1, "")]
    assert run(spark, rows) == plain(rows)
    few = rows_of(6, 5)
    assert run(spark, few) == plain(few)
    assert run(spark, []) == [] and run(spark, [(1, None, 1, 1, "")]) == []
    assert [r[1:4] for r in run(spark, [(None, [0.5] * 16, 1, 1, "")])] == [(None, None, None)]


def test_large_components_and_other_sizes(spark):
    rows = [(i, [3e38 * (-1) ** i, 1.0], 0, 1, "") for i in range(4)]
    assert all(r[2] == 0 for r in run(spark, rows, parts=2, entries=4, rounds=1))
    wide = rows_of(7, 60, dims=12)
    assert run(spark, wide, parts=3, entries=5, rounds=2) == plain(wide, 3, 5, 2)
    try:
        run(spark, [(0, [0.0] * 16, 0, 1, ""), (1, [0.0] * 8, 0, 1, "")])
        raise AssertionError("lengths differ")
    except ValueError:
        pass


def test_columns_may_clash(spark):
    frame = spark.createDataFrame(rows_of(8, 30), SCHEMA).withColumns({"code": F.lit("a"), "error": F.lit(1), "label_error": F.lit(2), "part": F.lit(3)})
    assert compress(frame).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and compress(frame).count() == 30
