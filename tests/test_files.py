"""File sources on small files, and chunkers against what they must give."""

import zipfile

import pytest

from weftline.operators import chunking as C
from weftline.sources import files as S


def test_artefacts(spark, tmp_path):
    for uid in ("A1", "b2"):
        (tmp_path / f"{uid}.document.jsonl").write_text(f'{{"title": "{uid}"}}\n')
    (tmp_path / "A1.chunk.jsonl").write_text('{"n": 1}\n{"n": 2}\n')
    ids = spark.createDataFrame([(" a1",), ("B2",)], "uid string")
    schemas = {"document": "title string", "chunk": "n int"}
    out = S.artefacts(spark, str(tmp_path), ids, schemas, tolerate_missing=True)
    assert sorted(r.title for r in out["document"].collect()) == ["A1", "b2"]
    assert sorted((r.uid, r.n) for r in out["chunk"].collect()) == [("A1", 1), ("A1", 2)]
    with pytest.raises(Exception, match="no chunk of B2"):
        S.artefacts(spark, str(tmp_path), ids, schemas)["chunk"].collect()


def test_chunk_files(spark, tmp_path):
    cases = {"good": b'{"a": 1}\n\n{"b": [1]}\n', "list": b'{"a": 1}\n[1]\n', "null": b"null\n", "none": b"{}\n", "broken": b'{"a": 1}\n{"a"', "bytes": b'{"a": "\xff\xfe"}\n', "blank": b" \n"}
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    got = {r.file: r.n_chunks for r in S.chunk_files(spark, str(tmp_path)).collect()}
    assert got == {"good": 2, "list": 0, "null": 0, "none": 0, "broken": 0, "bytes": 0, "blank": 0}


@pytest.mark.parametrize("sep", [",", ";", "\t"])
def test_csv(spark, tmp_path, sep):
    path = tmp_path / "in.csv"
    path.write_text("﻿" + sep.join(['"Réponse, attendue; x"', "Question"]) + "\n" + sep.join(['"a\nb"', "q1"]) + "\n", encoding="utf-8")
    rows = S.read_csv(spark, str(path), {"question": ["la question", "question"], "answer": ["reponse attendue x"]})
    assert [tuple(r) for r in rows.collect()] == [("q1", "a\nb")]
    with pytest.raises(ValueError, match="no column for gold"):
        S.read_csv(spark, str(path), {"gold": ["gold"]})


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name in ("x/F1.xml", "x/F2.xml", "readme"):
            z.writestr(name, f"<{name}>")
    ids = spark.createDataFrame([("F2",)], "uid string")
    got = S.zip_members(spark, str(tmp_path / "*.zip"), ids, r"(F\d+)\.xml$").collect()
    assert [(r.archive, r.member, r.uid, bytes(r.content)) for r in got] == [("a.zip", "x/F2.xml", "F2", b"<x/F2.xml>")]
    assert S.zip_members(spark, str(tmp_path / "*.zip"), None, r"(F\d+)\.xml$").count() == 2


def test_paragraphs():
    text = "a" * 5 + "\n\n" + "b" * 5 + "\n\n" + "c" * 25 + "\n\n\nd"
    assert C.paragraphs_packed(text, 12, 2) == ["aaaaa\n\nbbbbb", "c" * 12, "c" * 12, "c" * 5, "d"]
    assert C.paragraphs_packed("", 10) == C.paragraphs_packed("\n\n \n", 10) == []
    long = "\n\n".join(f"paragraph {i}" for i in range(50_000))
    assert "\n\n".join(C.paragraphs_packed(long)) == long


def test_section_chunks():
    row = "| {} | yes |"
    pages = "\n\n".join("\n".join(["| name | ok |", "| --- | --- |", *[row.format(f"n{i}") for i in range(k, k + 6)]]) for k in (0, 6))
    out = C.section_chunks(f"## Title\n\n{pages}\n\n<!-- PAGE: 2 -->\nthe end", 80, 10)
    assert out[0].startswith("## Title\n\n| name | ok |\n| --- | --- |\n| n0 | yes |")
    assert all(len(x) <= 80 for x in out[1:])
    assert [x for c in out for x in c.splitlines() if x.startswith("| n") and "name" not in x] == [row.format(f"n{i}") for i in range(12)]
    assert out[-1] == "the end"
    assert C.section_chunks("| a |\n\n| b | c |") == ["| a |\n\n| b | c |"]


def test_text_before_the_first_question_stays():
    out = C.qa_chunks("some words first\nIs this a question?\nyes")
    assert [(r["role"], r["chunk"]) for r in out] == [("QA_COMPOSITE", "some words first"), ("Q_ONLY", "Is this a question?"), ("QA_COMPOSITE", "Is this a question?\n\nyes")]


def test_article_records_odd_payloads(spark):
    from weftline.sources import files

    article = """<ARTICLE><META><META_COMMUN><ID>V1</ID></META_COMMUN><META_SPEC><META_ARTICLE><DATE_DEBUT>2020-05-01</DATE_DEBUT></META_ARTICLE></META_SPEC></META>
<CONTEXTE><TEXTE nature="code"><TITRE_TXT id_txt="A" debut="2021-01-01" fin="">late</TITRE_TXT><TITRE_TXT id_txt="B" debut="2019-01-01" fin="2020-12-31" c_titre_court="NULL">old &amp; valid</TITRE_TXT></TEXTE></CONTEXTE>
<BLOC_TEXTUEL><CONTENU>one <b>two</b><br/>three &lt;4</CONTENU></BLOC_TEXTUEL><LIENS><LIEN typelien="MODIFIE" id="m"/><LIEN typelien="X" id="x"/></LIENS></ARTICLE>"""
    rows = {r.payload_id: r for r in files.article_records(spark.createDataFrame([(1, article), (2, "<ARTICLE><oops"), (3, None), (4, ""), (5, "<ARTICLE/>")], "payload_id int, xml string")).collect()}
    one = rows[1]
    assert (one.cid, one.number, one.state, one.title, one.short_title, one.body) == ("V1", "V1", "VIGUEUR", "old & valid", "old & valid", "one two three <4")
    assert (one.modifications, one.citations, one.concordances, one.subtitles, one.section_id, one.note, one.url) == (["m"], ["x"], [], None, None, None, "https://law.example/codes/article_lc/V1")
    assert len(rows) == 5 and all(rows[i].version_id is None and rows[i].title is None for i in (2, 3, 4, 5))
