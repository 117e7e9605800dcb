import numpy as np

from weftline.llm import language_cnn as cnn
from weftline.llm.language_cnn import predict

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score string, lettered int"
EN, DE = "the cat and the dog were there with them then ", "der Hund und die Katze nicht auch ich schön über "


def corpus(n=80):
    return [(i, (EN if i % 2 else DE) * (1 + i % 3) + str(i), "en" if i % 2 else "de", "x", 1) for i in range(n)]


def test_gradients():
    rng = np.random.default_rng(1)
    net = cnn.Network.fresh(["a", "b", "c"], rng)
    for p in net.parameters():
        p += 0.1 * rng.standard_normal(p.shape).astype(np.float32)
    wide = cnn.Network(net.languages, net.bytes.astype(float), [f.astype(float) for f in net.filters], [t.astype(float) for t in net.thresholds], net.out.astype(float), net.bias.astype(float))
    rows, y = rng.integers(0, 256, (4, cnn.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, gradient = wide.gradients(rows, y)
    for p, g in zip(wide.parameters(), gradient):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        before = p[at]
        p[at] = before + 1e-6
        up = wide.gradients(rows, y)[0]
        p[at] = before - 1e-6
        down = wide.gradients(rows, y)[0]
        p[at] = before
        assert abs((up - down) / 2e-6 - g[at]) < 1e-5


def test_tables_equal_to_filters():
    rng = np.random.default_rng(2)
    net = cnn.Network.fresh(["a", "b"], rng)
    texts = [b"", b"x", bytes(rng.integers(0, 256, 700).astype(np.uint8)), b"abc" * 85 + b"d"]
    offsets = np.cumsum([0] + [len(t) for t in texts])
    p = net.text_probabilities(np.frombuffer(b"".join(texts), np.uint8), offsets, net.tables())
    for text, got in zip(texts, p):
        total = np.zeros(2)
        for a in range(0, len(text), cnn.WINDOW):
            row = np.zeros(cnn.WINDOW, np.uint8)
            part = np.frombuffer(text[a : a + cnn.WINDOW], np.uint8)
            row[: len(part)] = part
            hidden = []
            for width, filters, threshold in zip(cnn.WIDTHS, net.filters, net.thresholds):
                best = np.max([net.bytes[row[i : i + width]].ravel() @ filters for i in range(cnn.WINDOW - width + 1)], axis=0)
                hidden.append(np.maximum(best + threshold, 0))
            z = np.concatenate(hidden) @ net.out + net.bias
            total += len(part) * (z - np.log(np.exp(z).sum()))
        total = np.exp(total / max(1, len(text)))
        assert np.allclose(got, total / total.sum(), atol=1e-4)


def test_no_letters_nulls_and_repeats(spark):
    rows = corpus() + [(1000, None, "en", "", 0), (1001, "", "de", "", 0), (1002, "12 34 !?", "en", "", 0), (None, EN, None, "", 0), (1003, EN * 3000, None, "", 0)] + [(1004, DE, "de", "", 0)] * 2 + [(1005, "é", None, "", 0)]
    got = predict(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all((by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0) for i in (1000, 1001, 1002)) and by[1005]["lang_pred"] != "und"
    assert by[None]["held_out"] and by[None]["lang_pred"] == "en" and by[1003]["lang_pred"] == "en"
    assert sum(r["doc_id"] == 1004 and r["lang_pred"] == "de" for r in got) == 2
    assert all(by[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(80)) and all(0 <= r["score"] <= 1 for r in got)


def test_nothing_learnt(spark):
    assert predict(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r)[2:] for r in predict(spark.createDataFrame([(1, EN, None, "", 0), (2, DE, None, "", 0)], SCHEMA)).collect()] == [("und", 0.0)] * 2


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = predict(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").selectExpr("avg(cast(lang = lang_pred as int))", "count(*)").first()
    assert got[1] > 200 and got[0] > 0.97
