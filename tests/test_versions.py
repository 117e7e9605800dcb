import random

from weftline.operators import versions


def follow(links):
    to = {}
    for v, c in links:
        if v is not None and c is not None:
            to.setdefault(v, set()).add(c)
    out = {}
    for v, targets in to.items():
        if len(targets) > 1:
            out[v] = (None, None, "contradiction")
            continue
        at, hops, seen = v, 0, {v}
        while len(to.get(at, ())) == 1 and (new := next(iter(to[at]))) != at:
            at, hops = new, hops + 1
            if at in seen:
                out[v] = (None, None, "cycle")
                break
            seen.add(at)
        else:
            out[v] = (at, hops, None)
    return out


def test_canonical_equals_following(spark):
    r = random.Random(2)
    for links in ([(i + 1, i) for i in range(300)], [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(200, 200), (201, 200), (None, 3), (5, None)], [(i, (i + 1) % 7) for i in range(7)] + [(10, 3), (11, 10)], [(0, None)]):
        frame = spark.createDataFrame(links, "version long, canonical long").repartition(3)
        got = {x.version: (x.canonical, x.hops, x.error) for x in versions.canonical(frame).collect()}
        assert got == follow(links)
    assert versions.canonical(spark.createDataFrame([], "version string, canonical string")).count() == 0


def test_entries_are_replaced(spark):
    found = versions.canonical(spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "version string, canonical string"))
    rows = versions.replaced(spark.createDataFrame([(1, "c"), (2, "a"), (3, "x"), (4, None)], "k int, article string"), found, "article")
    assert sorted(tuple(x) for x in rows.select("k", "article", "replaced").collect()) == [(1, "a", True), (2, "a", False), (3, "x", False), (4, None, False)]
