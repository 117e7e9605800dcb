"""Documents to sections and chunks.

Windows and paragraphs are DataFrame expressions; the markdown splitters keep state from line to line of one document and run
as Arrow-fed functions over batches of documents, one row out a section or chunk.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Characters of texts whose rows a task holds at once.
PARSED_CHARS = 1_000_000


def fixed_windows(df: DataFrame, text: Column, size: int, overlap: int) -> DataFrame:
    """df with chunk_index and chunk: windows of size characters, each size - overlap after the one before."""
    step = max(1, size - overlap)
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return df.select("*", F.posexplode(starts).alias("chunk_index", "__s")).withColumn("chunk", F.substring(text, F.col("__s") + 1, F.lit(size))).drop("__s")


def windows_of(text: str, size: int, overlap: int) -> list[str]:
    return [text[a : a + size] for a in range(0, len(text), max(1, size - overlap))]


def paragraphs_packed(text: str, size: int = 1200, overlap: int = 200) -> list[str]:
    """Paragraphs (between empty lines) joined greedily up to size characters; longer ones are cut into overlapping windows."""
    out: list[list[str]] = []
    room = 0  # characters that the last chunk can still take
    for p in (x.strip() for x in re.split(r"\n{2,}", text)):
        if not p:
            continue
        if len(p) > size:
            out += [[w] for w in windows_of(p, size, overlap)]
            room = 0
        elif room >= len(p) + 2:
            out[-1].append(p)
            room -= len(p) + 2
        else:
            out.append([p])
            room = size - len(p)
    return ["\n\n".join(parts) for parts in out]


def paragraph_chunks(docs: DataFrame, size: int = 1200, overlap: int = 200) -> DataFrame:
    """doc_id, chunk_index, chunk of docs (doc_id, text); see paragraphs_packed."""
    parse = _mapper(lambda text: [{"chunk_index": i, "chunk": c} for i, c in enumerate(paragraphs_packed(text, size, overlap))], ["chunk_index", "chunk"])
    return docs.select("doc_id", "text").mapInPandas(parse, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, chunk_index int, chunk string")


_PAGE_MARK = re.compile(r"^\s*<!--\s*PAGE\b.*-->\s*$", re.IGNORECASE)
_RULER = re.compile(r"^[\s|:\-]*-[\s|:\-]*$")


def table_slices(block: str, size: int) -> list[str]:
    """A markdown table cut between rows, its head and a ruler on every slice; heads that pages repeat are taken out.

    The head is the first of the first five rows that is repeated and says something, else the row above the first ruler.
    """
    lines = [x for x in block.splitlines() if x.strip()]
    rows = [x for x in lines if not _RULER.match(x)]
    again = {k for k, n in Counter(r.strip() for r in rows).items() if n > 1}
    head = next((r for r in rows[:5] if r.strip() in again and not re.search(r"\d{3,}", r)), None)
    at = next((i for i, x in enumerate(lines) if _RULER.match(x)), 0)
    if head is None and 1 <= at <= 2:
        head = lines[at - 1]
    top = [] if head is None else [head, "|" + " --- |" * max(1, head.count("|") - 1)]
    body = [r for r in rows if head is None or r.strip() != head.strip()]
    base = sum(len(x) + 1 for x in top)
    out, used = [], size
    for r in body:
        if used + len(r) + 1 > size:
            out.append([*top])
            used = base
        out[-1].append(r)
        used += len(r) + 1
    return ["\n".join(x) for x in out] or [block]


def section_chunks(text: str, size: int = 1200, overlap: int = 200) -> list[str]:
    """Chunks of a section: prose packed by paragraphs, tables over size cut between rows. Tables that follow each other with
    one number of columns are one table (pages cut them); a heading alone before a chunk goes into it."""
    plain = "\n".join(x for x in text.splitlines() if not _PAGE_MARK.match(x))
    blocks: list[tuple[bool, list[str]]] = []
    for p in (x.strip("\n") for x in re.split(r"\n\s*\n", plain)):
        if not p.strip():
            continue
        rows = [x.strip() for x in p.splitlines() if x.strip()]
        table = all(x.startswith("|") for x in rows)
        if table and blocks and blocks[-1][0] and blocks[-1][1][0].strip().splitlines()[0].count("|") == rows[0].count("|"):
            blocks[-1][1].append(p)
        else:
            blocks.append((table, [p]))
    out: list[str] = []
    prose: list[str] = []
    for table, parts in [*blocks, (True, [])]:
        whole = "\n".join(parts)
        if table and (not parts or len(whole) > size):
            if prose:
                out += paragraphs_packed("\n\n".join(prose), size, overlap)
                prose = []
            out += table_slices(whole, size) if parts else []
        else:
            prose.append(whole)
    if len(out) > 1 and out[0].startswith("#") and "\n" not in out[0].strip() and len(out[0]) < 120:
        out[:2] = [f"{out[0]}\n\n{out[1]}"]
    return out


def split_section_tables(sections: DataFrame, size: int = 1200, overlap: int = 200) -> DataFrame:
    """doc_id, chunk_index, chunk of sections (doc_id, text); see section_chunks."""
    parse = _mapper(lambda text: [{"chunk_index": i, "chunk": c} for i, c in enumerate(section_chunks(text, size, overlap))], ["chunk_index", "chunk"])
    return sections.select("doc_id", "text").mapInPandas(parse, "doc_id long, chunk_index int, chunk string")


def uncovered_sections(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """The sections (section_id, is_indexable, body) that no chunk (section_id) belongs to, are to be indexed and have text."""
    known = chunks.filter("section_id is not null").select("section_id").distinct()
    return sections.join(known, "section_id", "left_anti").filter(F.col("is_indexable") & (F.trim(F.coalesce("body", F.lit(""))) != ""))


def section_tree(sections: DataFrame) -> DataFrame:
    """doc_id, section_index, depth, line: sections (doc_id, section_index, level, heading) as an indented tree. A section's depth
    is the number of the sections it lies in: for each lower level the last one, unless a still lower one came after it."""
    over = Window.partitionBy("doc_id").orderBy("section_index").rowsBetween(Window.unboundedPreceding, -1)
    rows = sections
    for k in range(1, 6):
        rows = rows.withColumn(f"__l{k}", F.max(F.when(F.col("level") == k, F.col("section_index"))).over(over))
    open_ = []
    for k in range(1, 6):
        later = [F.col(f"__l{j}") > F.col(f"__l{k}") for j in range(1, k)]
        closed = F.lit(False)
        for x in later:
            closed = closed | F.coalesce(x, F.lit(False))
        open_.append(((F.col("level") > k) & F.col(f"__l{k}").isNotNull() & ~closed).cast("int"))
    depth = sum(open_, F.lit(0))
    return rows.select("doc_id", "section_index", depth.alias("depth"), F.concat(F.repeat(F.lit("  "), depth), F.lit("- "), "heading").alias("line"))


def section_ends(sections: DataFrame) -> DataFrame:
    """sections (doc_id, section_index, level from 1 to 6, and others) with section_end: the next section of the same or a lower
    level, null if it lasts to the end, and own_end: the next section of any level."""
    after = Window.partitionBy("doc_id").orderBy("section_index").rowsBetween(1, Window.unboundedFollowing)
    ends = [F.when(F.col("level") >= k, F.min(F.when(F.col("level") == k, F.col("section_index"))).over(after)) for k in range(1, 7)]
    return sections.select("*", F.least(*ends).alias("section_end"), F.min("section_index").over(after).alias("own_end"))


def positional_similarity(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, n_old, n_new, n_equal, mean_similarity of chunks (doc_id, position, text) compared place by place; a place that
    one side lacks counts 0."""
    from weftline.operators.linking import ratio

    a, b = old.select("doc_id", "position", F.col("text").alias("a")), new.select("doc_id", "position", F.col("text").alias("b"))
    both = a.join(b, ["doc_id", "position"], "full_outer")
    equal = F.col("a").eqNullSafe(F.col("b"))
    score = F.when(equal, 1.0).when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(ratio(F.when(~equal, F.col("a")), F.col("b")))
    return both.groupBy("doc_id").agg(F.count("a").alias("n_old"), F.count("b").alias("n_new"), F.count_if(equal).alias("n_equal"), F.round(F.avg(score), 6).alias("mean_similarity"))


def line_table(df: DataFrame, text: Column) -> DataFrame:
    """df with line_no and line."""
    return df.select("*", F.posexplode(F.split(text, "\\n")).alias("line_no", "line"))


def boilerplate(lines: DataFrame, group: str, doc: str, share: float, least: int, longest: int = 80) -> DataFrame:
    """group, line, n_docs, needed: short lines in at least max(least, ceil(share of the group's documents)) of them."""
    total = lines.groupBy(group).agg(F.countDistinct(doc).alias("total"))
    short = lines.filter((F.length(F.trim("line")) > 0) & (F.length("line") <= longest))
    counts = short.groupBy(group, "line").agg(F.countDistinct(doc).alias("n_docs"))
    needed = F.greatest(F.lit(least), F.ceil(F.lit(share) * F.col("total")))
    return counts.join(total, group).withColumn("needed", needed).filter("n_docs >= needed").select(group, "line", "n_docs", "needed")


def page_edges(pages: DataFrame, edge: int = 3, share: float = 0.4, least: int = 3, shortest: int = 3, longest: int = 100, never: tuple[str, ...] = ("#", "|")) -> DataFrame:
    """doc_id, line, n_pages, needed: headers and footers of documents, from pages (doc_id, page_no, text; a page a row).

    Of each page its first and last ``edge`` lines that aren't blank count, trimmed, of ``shortest`` to ``longest`` characters and
    not begun by ``never``; a line is a header or footer if ``share`` of the document's pages, and ``least`` at least, have it there.
    """
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\\R"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")
    both = F.array_distinct(F.concat(F.slice("lines", 1, edge), F.slice("lines", F.greatest(F.size("lines") - edge + 1, F.lit(1)), F.lit(edge))))
    rows = pages.withColumn("lines", lines).select("doc_id", F.explode(F.when(F.size("lines") > 0, both)).alias("line"))
    fitting = rows.filter(F.length("line").between(shortest, longest) & ~F.substring("line", 1, 1).isin(*never))
    needed = pages.groupBy("doc_id").agg(F.greatest(F.lit(least), F.ceil(F.count("*") * share)).cast("long").alias("needed"))
    return fitting.groupBy("doc_id", "line").agg(F.count("*").alias("n_pages")).join(needed, "doc_id").filter("n_pages >= needed").select("doc_id", "line", "n_pages", "needed")


def without_lines(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """pages (doc_id, page_no, text) without the lines (doc_id, line) that stand there, trimmed."""
    listed = lines.groupBy("doc_id").agg(F.collect_set("line").alias("__gone"))
    kept = F.array_join(F.filter(F.split("text", "\\R"), lambda x: ~F.array_contains("__gone", F.regexp_replace(x, r"^\s+|\s+$", ""))), "\n")
    joined = pages.join(listed, "doc_id", "left")
    return joined.select(*[F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept).alias(c) if c == "text" else F.col(c) for c in pages.columns])


def _mapper(parse: Callable[[str], list[dict]], columns: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held, size = [], 0
            for i, text in zip(frame["doc_id"], frame["text"], strict=True):
                held += [{"doc_id": i, **r} for r in parse(text or "")]
                size += len(text or "")
                if size >= PARSED_CHARS:
                    yield pd.DataFrame(held, columns=["doc_id", *columns])
                    held, size = [], 0
            if held:
                yield pd.DataFrame(held, columns=["doc_id", *columns])

    return work


_HEADING = re.compile(r"^(#{2,6})\s+(.+?)\s*$")
SECTION_SCHEMA = "doc_id long, section_index int, parent_index int, level int, heading string, heading_path string, body string, is_indexable boolean"


def markdown_sections(text: str, indexable: int = 50) -> list[dict]:
    """Sections of headings ## to ######. What precedes the first is 'Introduction'; without headings one 'Document'."""
    found: list[dict] = []
    stack: list[int] = []
    current, body = None, []

    def close() -> None:
        content = "\n".join(body).strip()
        if current is not None:
            current["body"] = content
        elif content:
            found.insert(0, {"level": 2, "heading": "Introduction" if found else "Document", "parent": None, "path": "Introduction" if found else "Document", "body": content})

    pre: list[str] = []
    for line in text.split("\n"):
        m = _HEADING.match(line)
        if not m:
            body.append(line)
            continue
        if current is None:
            pre = body
        else:
            close()
        body, level = [], len(m[1])
        while stack and found[stack[-1]]["level"] >= level:
            stack.pop()
        parent = stack[-1] if stack else None
        path = m[2] if parent is None else f"{found[parent]['path']} > {m[2]}"
        current = {"level": level, "heading": m[2], "parent": parent, "path": path, "body": ""}
        stack.append(len(found))
        found.append(current)
    close()
    intro = "\n".join(pre).strip()
    shift = 0
    if current is not None and intro:
        found.insert(0, {"level": 2, "heading": "Introduction", "parent": None, "path": "Introduction", "body": intro})
        shift = 1
    return [{"section_index": i, "parent_index": None if s["parent"] is None else s["parent"] + shift, "level": s["level"], "heading": s["heading"], "heading_path": s["path"], "body": s["body"], "is_indexable": len(s["body"]) >= indexable} for i, s in enumerate(found)]


def split_sections(docs: DataFrame) -> DataFrame:
    names = [c.split()[0] for c in SECTION_SCHEMA.split(", ")][1:]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _mapper(markdown_sections, names)(frames):
            yield frame.astype({"section_index": "Int32", "parent_index": "Int32", "level": "Int32"})

    return docs.select("doc_id", "text").mapInPandas(work, SECTION_SCHEMA)


def legal_chunks(text: str, size: int = 1200, least: int = 200) -> list[str]:
    """Paragraphs packed up to size, long ones cut at the last paragraph, sentence or clause end in the second half, small ones merged."""
    pieces: list[str] = []
    for p in (x.strip() for x in re.split(r"\n{2,}|\n", text)):
        while len(p) > size:
            at = next((k + len(mark) for mark in (". ", "; ", " ") if (k := p.rfind(mark, size // 2, size)) > 0), size)
            pieces.append(p[:at].strip())
            p = p[at:].strip()
        if p:
            pieces.append(p)
    out: list[str] = []
    for p in pieces:
        if out and (len(out[-1]) + 2 + len(p) <= size):
            out[-1] += "\n\n" + p
        else:
            out.append(p)
    if len(out) > 1 and len(out[-1]) < least:
        tail = out.pop()
        out[-1] += "\n\n" + tail
    return out


def split_legal(docs: DataFrame) -> DataFrame:
    parse = _mapper(lambda text: [{"chunk_index": i, "chunk": c} for i, c in enumerate(legal_chunks(text))], ["chunk_index", "chunk"])
    return docs.select("doc_id", "text").mapInPandas(parse, "doc_id long, chunk_index int, chunk string")


_QUESTION = re.compile(r"^(?:#{1,4}\s*)?(.{8,200}\?)\s*$")


def qa_chunks(text: str, whole: int = 1500, atom: int = 1200) -> list[dict]:
    """Question lines open blocks. A block gives Q_ONLY, QA_COMPOSITE (up to ``whole``) and A_ATOMIC chunks; what comes before the first question is a block without one."""
    blocks: list[tuple[str, list[str]]] = []
    before: list[str] = []
    for line in text.split("\n"):
        m = _QUESTION.match(line.strip())
        if m:
            blocks.append((m[1], []))
        elif blocks:
            blocks[-1][1].append(line)
        else:
            before.append(line)
    if "".join(before).strip():
        blocks.insert(0, ("", before))
    out = []
    for n, (q, lines) in enumerate(blocks):
        answer = "\n".join(lines).strip()
        if q:
            out.append({"block": n, "role": "Q_ONLY", "position": 0, "chunk": q})
        out.append({"block": n, "role": "QA_COMPOSITE", "position": 1, "chunk": f"{q}\n\n{answer}".strip()[:whole]})
        if len(answer) > atom:
            out += [{"block": n, "role": "A_ATOMIC", "position": 2 + i, "chunk": answer[a : a + atom]} for i, a in enumerate(range(0, len(answer), atom))]
    return out


def split_qa(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").mapInPandas(_mapper(qa_chunks, ["block", "role", "position", "chunk"]), "doc_id long, block int, role string, position int, chunk string")
