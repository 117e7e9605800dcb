"""Practical sheets, as nested XML, to events, markdown, metadata, sections and chunks.

Each sheet is read once, by a pull parser with a stack of its open elements, into rows: one for each heading, paragraph, item,
table row, link and piece of metadata, in order. Everything else is DataFrame work on these rows. Null and empty sheets have no
rows; one that is no well-formed XML has a single row of kind ``error``.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators.scratch import Scratch

#: Element names of the format and what they mean.
REGIONS = {"Avertissement": 1, "Introduction": 2, "Texte": 3, "ListeSituations": 4}
NOTES = {"Attention": "⚠️ **Attention :** ", "ASavoir": "💡 **À savoir :** ", "ANoter": "📝 **À noter :** ", "Rappel": "📌 **Rappel :** ", "Exemple": "📋 **Exemple :** "}
INLINE = {"MiseEnEvidence": " **{}** ", "Valeur": " **{}** ", "Expression": " _{}_ ", "Exposant": "{} ", "LienInterne": " [{}]({}) ", "LienExterne": " [{}]({}) ", "LienIntra": " {} ({}) "}
TARGETS = {"LienInterne": "LienPublication", "LienExterne": "URL", "LienIntra": "LienID"}
META = {"dc:title": "title", "dc:type": "category", "dc:date": "date", "Niveau": "crumb", "SousThemePere": "theme", "SousDossierPere": "theme"}
SKIPPED = {"Source", "OuSAdresser"}
HOME = ("Accueil particuliers", "Accueil")

EVENTS = "doc_id long, at int, region int, kind string, level int, grp int, text string, target string, type string"
#: Rows of a batch that goes back to Spark.
BATCH_ROWS = 4096
_NAMES = [x.split()[0] for x in EVENTS.split(", ")]
_TYPES = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]] for x in EVENTS.split(", ")]


class _Reader:
    """Rows (region, kind, level, grp, text, target, type) of one sheet. A block of text ends where any element that is not
    inline begins or ends; grp numbers lists, tables and notes, whose parts belong together."""

    def __init__(self) -> None:
        self.rows: list[list] = []
        self.stack: list[tuple[str, dict]] = []
        self.parts: list[str] = []
        self.inline: list[int] = []  # where the open inline elements begin in parts
        self.names: dict[str, int] = {}  # how many elements of a name are open
        self.item: list[str] = []
        self.cells: list[list[str]] = []
        self.grp = self.skip = 0
        self.note = ""
        self.definitions: dict[str, str] = {}

    def open(self, name: str) -> bool:
        return self.names.get(name, 0) > 0

    def region(self) -> int:
        return REGIONS.get(self.stack[1][0], 0) if len(self.stack) > 1 else 0

    def add(self, kind: str, text: str, level: int = 0, target: str | None = None, type_: str | None = None, grp: int = 0) -> None:
        self.rows.append([self.region(), kind, level, grp, text, target, type_])

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text and self.stack and not self.skip:
            self.block(text)

    def block(self, text: str) -> None:
        tag, attrs = self.stack[-1]
        above = self.stack[-2][0] if len(self.stack) > 1 else ""
        if tag in META:
            self.add(META[tag], text)
        elif tag == "Titre":
            self.title(above, text)
        elif self.open("Definition"):
            name = next(a.get("ID", "") for t, a in reversed(self.stack) if t == "Definition")
            self.definitions[name] = f"{self.definitions.get(name, '')} {text}".strip()
        elif self.open("Reference"):
            self.add("reference_note" if tag == "Complement" else "reference_text", text)
        elif self.region() == 0:
            pass
        elif self.open("Cellule"):
            self.cells[-1][-1] = f"{self.cells[-1][-1]} {text.replace('|', '/')}".strip()
        elif self.open("Item"):
            self.item.append(text)
        elif tag == "TitreFlottant":
            self.add("text", f"**{text}**")
        else:
            self.add("text", self.note + text, grp=self.grp if self.note else 0)
            self.note = ""

    def title(self, above: str, text: str) -> None:
        if above in ("Theme", "DossierPere"):
            self.add("theme", text)
        elif above == "Reference":
            self.add("reference_title", text)
        elif self.region() == 0:
            pass
        elif above == "Avertissement":
            self.add("warning", text)
        elif above in ("Chapitre", "Situation"):
            self.add("heading", text, 2)
        elif above == "SousChapitre":
            self.add("heading", text, 3)
        elif above == "Cas":
            self.add("heading", text, 4 if self.open("SousChapitre") or self.names["Cas"] > 1 else 3)
        elif above == "Tableau":
            self.add("text", f"**📊 {text}**")
        elif above == "ServiceEnLigne":
            url = self.stack[-2][1].get("URL", "")
            self.add("text", f"🌐 [{text}]({url})" if url else f"🌐 {text}", target=url or None)
        else:
            self.add("text", f"**{text}**")

    def items(self) -> None:
        if self.item:
            self.add("item", "- " + " ".join(self.item), grp=self.grp)
            self.item.clear()

    def start(self, tag: str, attrs: dict) -> None:
        if tag in INLINE:
            self.inline.append(len(self.parts))
        else:
            self.flush()
        self.skip += tag in SKIPPED
        if tag == "Item":
            self.items()
        elif tag in ("Liste", "Tableau") and not self.open(tag):
            self.grp += 1
        elif tag in NOTES:
            self.grp += 1
            self.note = NOTES[tag]
        elif tag == "Rangée":
            self.cells.append([])
        elif tag == "Cellule" and self.cells:
            self.cells[-1].append("")
        elif tag == "Reference":
            self.add("reference", "", target=attrs.get("URL") or None, type_=attrs.get("type", ""))
        self.stack.append((tag, attrs))
        self.names[tag] = self.names.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        if tag in INLINE:
            self.finish_inline(tag, self.inline.pop())
        else:
            self.flush()
        if tag == "Item":
            self.items()
        elif tag == "Tableau" and self.names[tag] == 1:
            self.table()
        elif tag in NOTES:
            self.note = ""
        self.skip -= tag in SKIPPED
        self.stack.pop()
        self.names[tag] -= 1

    def finish_inline(self, tag: str, begin: int) -> None:
        inner, attrs = "".join(self.parts[begin:]), self.stack[-1][1]
        target, text = attrs.get(TARGETS.get(tag, ""), ""), inner.strip()
        if tag == "LienInterne" and target and not self.skip:
            self.add("link", " ".join(text.split()), target=target, type_=attrs.get("type", ""))
        if tag in TARGETS and not target:
            new = f" {text} "
        elif tag == "LienIntra":
            new = f" {text}\u0001{target}\u0002 "  # the definition may come later
        else:
            new = INLINE[tag].format(text, target)
        self.parts[begin:] = [new] if text else [inner]

    def table(self) -> None:
        width = len(self.cells[0]) if self.cells else 0
        if width and self.region():
            for i, cells in enumerate(self.cells):
                line = "| " + " | ".join((cells + [""] * width)[:width]) + " |"
                self.add("row", line + ("\n|" + "---|" * width if i == 0 else ""), grp=self.grp)
        self.cells.clear()

    def data(self, text: str) -> None:
        self.parts.append(text)

    def finished(self) -> list[list]:
        """All rows, terms followed by their definitions."""

        def defined(text: str) -> str:
            head, *rest = text.split("\u0001")
            for part in rest:
                name, tail = part.split("\u0002", 1)
                head += (f" ({self.definitions[name]})" if name in self.definitions else "") + tail
            return head

        for row in self.rows:
            row[4] = defined(row[4])
        return self.rows + [[0, "definition", 0, 0, v, k, None] for k, v in self.definitions.items()]


def read(xml: str) -> list[list]:
    reader, parser = _Reader(), expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = reader.start, reader.end, reader.data
    try:
        parser.Parse(xml, True)
        return reader.finished()
    except expat.ExpatError as error:
        return [[0, "error", 0, 0, str(error), None, None]]


def events(sheets: DataFrame) -> DataFrame:
    """The rows of sheets (doc_id, xml), about BATCH_ROWS at a time."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for doc_id, xml in zip(batch.column("doc_id").to_pylist(), batch.column("xml"), strict=True):
                text = xml.as_py()
                held += [(doc_id, i, *row) for i, row in enumerate(read(text))] if text else []
                if len(held) >= BATCH_ROWS:
                    yield batch_of(held)
                    held = []
        if held:
            yield batch_of(held)

    return sheets.select(F.col("doc_id").cast("long").alias("doc_id"), "xml").mapInArrow(work, EVENTS)


def stored_events(sheets: DataFrame) -> DataFrame:
    """As events, each sheet read once and its rows written, for plans that read them several times."""
    return Scratch(sheets.sparkSession, "sheets").save(events(sheets), "events")


def _content(rows: DataFrame) -> DataFrame:
    """Events that are text of the sheet: where it has situations, its other body is left out."""
    chosen = F.max(F.when(F.col("region") == 4, 1).otherwise(0)).over(Window.partitionBy("doc_id"))
    shown = rows.filter(F.col("kind").isin("heading", "text", "item", "row", "warning") & (F.col("region") > 0))
    return shown.withColumn("__s", chosen).filter((F.col("region") != 3) | (F.col("__s") == 0)).drop("__s")


def _joined(pieces: Column) -> Column:
    """Text of an array of events: parts of a list or table line by line, a warning quoted, else with an empty line between."""
    before = lambda i: F.get(pieces, i - 1)
    line = lambda x: F.when(x["region"] == 1, F.concat(F.lit("> "), F.when(x["kind"] == "warning", F.concat(F.lit("⚠️ **"), x["text"], F.lit("**"))).otherwise(F.replace(x["text"], F.lit("\n"), F.lit("\n> "))))).when(x["kind"] == "heading", F.concat(F.repeat(F.lit("#"), x["level"]), F.lit(" "), x["text"])).otherwise(x["text"])
    together = lambda x, i: (x["grp"] > 0) & (x["grp"] == before(i)["grp"]) & x["kind"].isin("item", "row")
    gap = lambda x, i: F.when(i == 0, "").when((x["region"] == 1) & (before(i)["region"] == 1), F.when(together(x, i), "\n").otherwise("\n>\n")).when(together(x, i), "\n").otherwise("\n\n")
    return F.array_join(F.transform(pieces, lambda x, i: F.concat(gap(x, i), line(x))), "")


def _gathered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the events of each in order, as ``pieces``."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("region", "at", "kind", "level", "grp", "text"))).alias("pieces"))


def markdown(rows: DataFrame) -> DataFrame:
    """doc_id, markdown of the sheets whose events these are: title, warning, introduction, then body."""
    title = rows.filter("kind = 'title'").groupBy("doc_id").agg(F.min_by("text", "at").alias("title"))
    body = _gathered(_content(rows), ["doc_id"]).select("doc_id", _joined(F.col("pieces")).alias("body"))
    both = title.join(body, "doc_id", "full_outer")
    whole = F.concat_ws("\n\n", F.concat(F.lit("# "), F.coalesce("title", F.col("doc_id").cast("string"))), F.col("body"))
    return both.select("doc_id", T.clean_markdown(whole).alias("markdown"))


def metadata(rows: DataFrame) -> DataFrame:
    """doc_id, title, category, verified (date text, 'modified ' taken off), breadcrumb, themes, links (each target once, as first
    found), refs (url, title, type, note), definitions; null or empty where a sheet has none."""
    of = lambda kind: F.when(F.col("kind") == kind, F.struct("at", "text", "target", "type"))
    listed = lambda kind: F.array_sort(F.collect_list(of(kind)))
    first = lambda kind: F.min(of(kind))["text"]
    words = lambda c: F.array_join(F.transform(c, lambda x: x["text"]), " > ")
    pairs = lambda c: F.transform(c, lambda x: F.struct(x["target"].alias("target"), x["text"].alias("text"), x["type"].alias("type")))
    # A link counts once, and what follows a reference belongs to it.
    link = rows.filter("kind = 'link'").groupBy("doc_id", "target").agg(F.min(F.struct("at", "text", "type")).alias("x")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("x.at", "target", "x.text", "x.type"))).alias("links"))
    opened = rows.filter("kind like 'reference%'").withColumn("ref", F.max(F.when(F.col("kind") == "reference", F.col("at"))).over(Window.partitionBy("doc_id").orderBy("at")))
    refs = opened.filter("ref is not null").groupBy("doc_id", "ref").agg(F.max("target").alias("url"), F.max(F.when(F.col("kind") == "reference_title", F.col("text"))).alias("title"), F.max("type").alias("type"), F.max(F.when(F.col("kind") == "reference_note", F.col("text"))).alias("note"))
    refs = refs.filter("url is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ref", "url", F.coalesce("title", F.lit("")).alias("title"), "type", F.coalesce("note", F.lit("")).alias("note")))).alias("refs"))
    one = rows.groupBy("doc_id").agg(first("title").alias("title"), first("category").alias("category"), first("date").alias("date"), listed("crumb").alias("crumbs"), listed("theme").alias("themes"), listed("definition").alias("definitions"))
    out = one.join(link, "doc_id", "left").join(refs, "doc_id", "left")
    crumbs = F.filter("crumbs", lambda x: ~x["text"].isin(*HOME))
    return out.select(
        "doc_id", "title", "category", F.regexp_replace("date", "^modified ", "").alias("verified"), words(crumbs).alias("breadcrumb"), words(F.col("themes")).alias("themes"),
        F.transform(F.coalesce("links", F.array().cast("array<struct<at:int,target:string,text:string,type:string>>")), lambda x: F.struct(x["target"].alias("target"), x["text"].alias("text"), x["type"].alias("type"))).alias("links"),
        F.transform("refs", lambda x: F.struct(x["url"].alias("url"), x["title"].alias("title"), x["type"].alias("type"), x["note"].alias("note"))).alias("refs"), pairs(F.col("definitions")).alias("definitions"),
    )


def sections(rows: DataFrame, least: int = 50) -> DataFrame:
    """The sheets' sections: doc_id, section_index, section_id, level, heading, path, body, is_indexable (``least`` characters).

    A section is a heading and what follows it up to the next one; what comes before the first is 'Introduction', level 1.
    The path holds the headings above that are still open. Ids are hashes of document and place, the same in each run.
    """
    shown = _content(rows)
    order = Window.partitionBy("doc_id").orderBy("region", "at")
    numbered = shown.withColumn("section_index", F.sum(F.when(F.col("kind") == "heading", 1).otherwise(0)).over(order).cast("int"))
    heads = numbered.filter("kind = 'heading'").select("doc_id", "section_index", "level", F.col("text").alias("heading"))
    parts = numbered.filter("kind <> 'heading'")
    body = _gathered(parts, ["doc_id", "section_index"]).select("doc_id", "section_index", T.clean_markdown(_joined(F.col("pieces"))).alias("body"))
    both = heads.join(body, ["doc_id", "section_index"], "full_outer").withColumns({"level": F.coalesce("level", F.lit(1)), "heading": F.coalesce("heading", F.lit("Introduction")), "body": F.coalesce("body", F.lit(""))})
    above = Window.partitionBy("doc_id").orderBy("section_index")
    # The last heading of each level, and where it stands: it is still open if none of a lesser level has come since.
    for n in (2, 3, 4):
        both = both.withColumn(f"__at{n}", F.last(F.when(F.col("level") == n, F.col("section_index")), True).over(above)).withColumn(f"__h{n}", F.last(F.when(F.col("level") == n, F.col("heading")), True).over(above))
    live = lambda n: F.when((F.col("level") >= n) & F.col(f"__at{n}").isNotNull() & ((F.lit(True) if n == 2 else F.col(f"__at{n}") > F.greatest(*[F.coalesce(f"__at{m}", F.lit(-1)) for m in range(2, n)], F.lit(-1)))), F.col(f"__h{n}"))
    path = F.when(F.col("level") == 1, F.col("heading")).otherwise(F.concat_ws(" > ", live(2), live(3), live(4)))
    ident = F.sha1(F.concat_ws("/", F.col("doc_id").cast("string"), F.col("section_index").cast("string")))
    return both.select("doc_id", "section_index", ident.alias("section_id"), "level", "heading", path.alias("path"), "body", (F.length("body") >= least).alias("is_indexable"))


def payload(c: Column) -> Column:
    """What of a chunk is worth embedding: images, heading marks and rules off, nothing but punctuation is nothing."""
    c = F.regexp_replace(c, r"!\[[^\]]*\]\([^)]*\)", "")
    c = F.trim(F.regexp_replace(F.regexp_replace(c, r"(?m)^#{1,6} +", ""), r"(?m)^[ |:*_-]+$", ""))
    return F.when(c.rlike(r"[\p{L}\p{N}]"), c)


def chunks(found: DataFrame, size: int = 1200, overlap: int = 200) -> DataFrame:
    """chunk_id, section_id, doc_id, chunk_index, text, n_chars of the indexable sections that have something to embed; each chunk
    begins with its section's path. Ids are hashes of section, place and text."""
    from weftline.operators.chunking import paragraph_chunks

    cut = paragraph_chunks(found.filter("is_indexable").select(F.col("section_id").alias("doc_id"), F.col("body").alias("text")), size, overlap)
    cut = cut.select(F.col("doc_id").alias("section_id"), "chunk_index", payload(F.col("chunk")).alias("body")).filter("body is not null")
    rows = cut.join(found.select("section_id", "doc_id", "path"), "section_id").withColumn("text", F.concat("path", F.lit("\n\n"), "body"))
    return rows.select(T.chunk_id(F.col("section_id"), F.col("chunk_index"), F.col("text")).alias("chunk_id"), "section_id", "doc_id", "chunk_index", "text", F.length("text").cast("long").alias("n_chars"))
