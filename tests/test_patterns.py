from weftline.operators import patterns


def test_verdicts(spark):
    rows = [
        (1, "retrieval", 1, "Guide FMD | Frais"), (1, "retrieval", 2, "Congé maladie"), (1, "rerank", 1, "guide fmd"), (1, "context", 1, "GUIDE FMD"), (1, "sources", 1, "conge maladie"),
        (2, "retrieval", 1, "x"), (3, "kept", 2, "Loi 84-16"), (3, "retrieval", 4, "loi 84-16"), (4, "other", 1, "prime"), (6, "sources", 1, None), (7, "sources", 1, "a.b"),
    ]
    asked = [(1, "FMD"), (1, "Conge|nothing"), (2, "absent"), (3, "LOI 84-16| zzz"), (3, "zzz"), (4, "prime"), (5, " | "), (5, None), (6, ""), (7, "a.b"), (7, "a.b")]
    got = patterns.pattern_loss(spark.createDataFrame(asked, "run_id int, pattern string"), spark.createDataFrame(rows, "run_id int, stage string, rank int, text string"), spark.range(1, 9).selectExpr("cast(id as int) as run_id"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([
        (1, "FMD", "rejected_by_selector", 1, "rejected_by_selector"), (1, "Conge|nothing", "ok", 2, "rejected_by_selector"), (2, "absent", "absent", None, "absent"), (3, "LOI 84-16| zzz", "lost_in_context", 4, "lost_in_context"),
        (3, "zzz", "absent", None, "lost_in_context"), (4, "prime", "absent", None, "absent"), (7, "a.b", "ok", None, "ok"), *((i, None, "not_evaluated", None, "not_evaluated") for i in (5, 6, 8)),
    ], key=str)
