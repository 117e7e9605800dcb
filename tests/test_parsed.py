import pandas as pd

from weftline.operators import chunking


def test_parsed_rows_are_passed_on_as_texts_come(monkeypatch):
    monkeypatch.setattr(chunking, "PARSED_CHARS", 30, raising=False)
    frame = pd.DataFrame({"doc_id": range(9), "text": ["## a\nbody of a", None, "", "x" * 40, "## b\nc\n### d\ne", *["y"] * 4]})
    work = chunking._mapper(lambda text: [{"n": i, "line": x} for i, x in enumerate(text.split("\n"))], ["n", "line"])
    got = list(work(iter([frame])))
    rows = [tuple(x) for part in got for x in part.itertuples(index=False)]
    assert rows == [(i, n, x) for i, text in enumerate(frame["text"]) for n, x in enumerate((text or "").split("\n"))]
    assert len(got) > 1 and max(len(x) for x in got) < len(rows)
