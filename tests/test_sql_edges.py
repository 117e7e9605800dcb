"""Queries with SQL on small tables that hold what the given ones lack, against DuckDB."""

from types import SimpleNamespace

import duckdb
import pyarrow as pa

from weftline.plans import corpus, joins, references, registry, summaries, values


def same(spark, plan, **tables):
    """Rows of the query and of its SQL over tables given as (schema of Spark, pyarrow table)."""
    con = duckdb.connect()
    frames = {}
    for name, (schema, table) in tables.items():
        con.register(name, table)
        frames[name] = spark.createDataFrame([tuple(r.values()) for r in table.to_pylist()], schema)
    df = plan(SimpleNamespace(**frames))
    want = con.execute(registry.oracles()[plan.__name__])
    names = [c[0] for c in want.description]
    rows = lambda found: sorted((tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in found), key=repr)
    assert rows(map(tuple, df.select(*names).collect())) == rows(want.fetchall())


def test_reconstruction_gate(spark):
    texts = ["été très élevé là où naît hier noël", "un deux trois quatre cinq six sept huit été", "ete tres eleve la ou nait hier noel", None, "un deux", "", "İl un deux trois quatre cinq six sept huit", "il neuf dix"]
    same(spark, summaries.reconstruction_gate, benchmark=("item_id long, text string", pa.table({"item_id": range(len(texts)), "text": texts})))


def test_ref_extract(spark):
    texts = ["éR 4800 et", "DÉCRET n° 86-83, Décret\x0b87/1", "L\x0b123 L\t124 _L 125", "arrêté d.12-3", None]
    same(spark, corpus.ref_extract, documents=("doc_id long, text string", pa.table({"doc_id": range(1, len(texts) + 1), "text": texts})))


def test_vector_literal(spark):
    vectors = [[0.103515625, 0.001953125, -0.005859375, -0.0], [float("nan"), float("inf"), float("-inf"), 1e22], [None, 1.0], [None], [], None, [0.123456785, 2.5e-9, 5e-9, -1e-12]]
    same(spark, corpus.vector_literal, embeddings=("vec_id long, embedding array<double>", pa.table({"vec_id": range(len(vectors)), "embedding": pa.array(vectors, pa.list_(pa.float64()))})))


def test_words_end_at_letters_outside_ascii(spark):
    texts = ["geheit ßde y", "ßof theß", "İn on the", "œde", "the edœ geheit", None, "x der on ъin", "1.2.3.4é é1.2.3.4", "- a\n- b\n- c\nÉOUÉ 1234567890 1234567890 1234567890 \n", "- a\n- b\n- c\r OU \r xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx"]
    docs = ("doc_id long, text string", pa.table({"doc_id": range(len(texts)), "text": texts}))
    for plan in (values.text_rules, corpus.pii_scan, corpus.risk_pages):
        same(spark, plan, documents=docs)


def test_source_candidates_hold_all_pairs(spark):
    s = [(1, 5), (2, 5), (3, 6), (4, None), (9, 7)]
    c = [(1, 5), (2, 6), (4, None), (5, 5), (6, 6), (7, None), (8, 8)]
    suppliers = pa.table({"s_suppkey": [x for x, _ in s], "s_nationkey": [x for _, x in s]})
    customers = pa.table({"c_custkey": [x for x, _ in c], "c_nationkey": [x for _, x in c]})
    same(spark, joins.source_candidates, supplier=("s_suppkey long, s_nationkey long", suppliers), customer=("c_custkey long, c_nationkey long", customers))
    frames = SimpleNamespace(supplier=spark.createDataFrame(s, "s_suppkey long, s_nationkey long"), customer=spark.createDataFrame(c, "c_custkey long, c_nationkey long"))
    rows = joins.source_candidates(frames).collect()
    left, right = ([r for r in rows if r.side == side] for side in ("supplier", "customer"))
    want = {(i, j) for i, a in s for j, b in c if i == j or (a is not None and a == b)}
    assert {(i.id, j.id) for i in left for j in right if j.id == i.same_id or (i.class_id is not None and i.class_id == j.class_id)} == want
    assert {(r.side, r.id): r.n_links for r in rows} == {("supplier", i): sum(x == i for x, _ in want) for i, _ in s} | {("customer", j): sum(x == j for _, x in want) for j, _ in c}


def test_a_mention_meets_a_number_and_cid_once(spark):
    refs = spark.createDataFrame([(i, f"L{i % 2}", f"C{i % 3}") for i in range(600, 0, -1)], "id long, number string, cid string")
    got = {(r.number, r.cid): r.id for r in references.known_references(refs).collect()}
    assert got == {(f"L{i % 2}", f"C{i % 3}"): i for i in range(6, 0, -1)}
