from pyspark.sql import functions as F

from weftline.operators import chunking
from weftline.operators.corpusrun import corpus_run


def frames(spark, manifest, files, documents=(), chunks=()):
    return (
        spark.createDataFrame(manifest, "uid string, in_force boolean, valid boolean"), spark.createDataFrame([(u, c.encode() if c is not None else None) for u, c in files], "uid string, content binary"),
        spark.createDataFrame(list(documents), "uid string, checksum string"), spark.createDataFrame(list(chunks), "uid string, chunk_index int, text string"),
    )


def parser(spark):
    count = spark.sparkContext.accumulator(0)

    def parse(rows):
        def work(batches):
            for frame in batches:
                count.add(len(frame))
                frame["text"] = [bytes(c).decode() for c in frame["content"]]
                frame["error"] = ["bad" if t == "bad" else None for t in frame["text"]]
                frame["chunk_index"] = 0
                yield frame[frame["text"] != ""][["uid", "chunk_index", "text", "error"]]

        return rows.mapInPandas(work, "uid string, chunk_index int, text string, error string")

    return parse, count


def collected(out):
    status = {r.uid: (r.status, r.n_chunks) for r in out["status"].collect()}
    return status, {r.uid for r in out["documents"].collect()}, {(r.uid, r.text) for r in out["chunks"].collect()}, out["run"].first().asDict()


def test_second_run_parses_nothing(spark):
    manifest = [(" a", True, True), ("B", True, True), ("c", True, True), ("d", False, True), ("e", True, False), ("f", True, True), ("h", False, True), ("i", True, True), (None, True, True), ("I ", True, True)]
    files = [("a", "one"), ("b", None), ("c", "bad"), ("f", ""), ("i", "same")]
    old = [("B", "x"), ("D", "x"), ("E", "x"), ("C", "x"), ("G", "x")]
    first = frames(spark, manifest, files, old, [("b", 0, "b0"), ("d", 0, "d0"), ("c", 0, "c0"), ("g", 0, "g0"), ("zz", 0, "orphan")])
    parse, count = parser(spark)
    out = corpus_run(*first, parse)
    status, documents, chunks, run = collected(out)
    assert status == {"A": ("ok", 1), "B": ("error", None), "C": ("error", None), "D": ("removed", None), "E": ("error", None), "F": ("error", None), "G": ("removed", None), "H": ("acknowledged", None), "I": ("ok", 1)}
    assert documents == {"A", "B", "C", "E", "I"} and chunks == {("A", "one"), ("B", "b0"), ("C", "c0"), ("I", "same")}
    assert count.value == 4 and run == {"scope": "full", "ok": 2, "unchanged": 0, "error": 4, "removed": 2, "acknowledged": 1}
    good = [x for x in files if x[0] in "ai"]
    names = [(u, True, True) for u, _ in good]
    again, counted = parser(spark)
    second = corpus_run(frames(spark, names, good)[0], frames(spark, names, good)[1], out["documents"].filter("uid in ('A', 'I')"), out["chunks"], again)
    assert collected(second)[0] == {"A": ("unchanged", 1), "I": ("unchanged", 1)} and counted.value == 0
    forced = corpus_run(frames(spark, names, good)[0], frames(spark, names, good)[1], out["documents"].filter("uid in ('A', 'I')"), out["chunks"], again, force=True)
    assert {v[0] for v in collected(forced)[0].values()} == {"ok"} and counted.value == 2


def test_requested_only(spark):
    data = frames(spark, [("a", True, True), ("b", True, True)], [("a", "1"), ("b", "2")], [("c", "x"), ("d", "x")], [("c", 0, "c"), ("q", 0, "q")])
    status, documents, chunks, run = collected(corpus_run(*data, parser(spark)[0], requested=spark.createDataFrame([("A",), ("c",)], "uid string")))
    assert status == {"A": ("ok", 1), "C": ("removed", None)} and documents == {"A", "D"} and chunks == {("A", "1"), ("q".upper(), "q")} and run["scope"] == "document"
    status, documents, chunks, _ = collected(corpus_run(*frames(spark, [], [], [("c", "x")], [("q", 0, "q")]), parser(spark)[0]))
    assert documents == set() and chunks == {("Q", "q")}  # an empty manifest sweeps no chunks without a document


def test_page_edges(spark):
    pages = [(1, i, f"Direction\n\n {i} body\nx\ny\nz\nw\n page {i} \n# T\nfoot") for i in range(5)] + [(1, 5, None), (2, 0, "Direction"), (2, 1, "Direction"), (3, 0, ""), (4, 0, "a\nb"), (4, 1, "ab\r\nab"), (4, 2, "ab")]
    frame = spark.createDataFrame(pages, "doc_id long, page_no int, text string")
    found = chunking.page_edges(frame)
    assert sorted(tuple(r) for r in found.collect()) == [(1, "Direction", 5, 3), (1, "foot", 5, 3)]
    clean = {(r.doc_id, r.page_no): r.text for r in chunking.without_lines(frame, found).collect()}
    assert clean[1, 0] == "\n 0 body\nx\ny\nz\nw\n page 0 \n# T" and clean[1, 5] is None and clean[2, 0] == "Direction" and clean[4, 1] == "ab\r\nab"
    assert found.filter(F.col("doc_id") == 2).count() == 0  # two pages are too few
