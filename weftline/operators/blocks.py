"""Documents to question-and-answer blocks, line by line: guides, FAQs, marked questions, processes and matrices of acts.

Texts become rows of lines; what kind a line is follows from patterns, and what block, section or branch it belongs to from
running counts and last values over the lines of its document, so that all parsers are plain window plans. A document's lines
are one partition of these windows: memory is bound to one document, and no state is kept in Python.

Every parser returns blocks: doc_id, section_index, level, title, parent_path, path, question, answer, qa_id, parent_qa_id. Blocks
without an answer are left out; lines before the first block belong to none (see ``route``, which then takes the whole text as
one block). Null texts have no lines; an empty table gives no blocks; rows of one doc_id are one document.

What patterns say of a line is found once, in one pass, and written to the scratch folder; the plans over it read that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators.scratch import Scratch

#: Titles of tables of contents, and lines that say nothing.
TOC_TITLES = ("table des matieres", "sommaire")
BOILERPLATE = ("secretariat general", "direction des ressources humaines", "c1 - public")
TOC_ENTRY = r"(?i)^(?:[IVXLC]+-|[A-Z]\.|\d+\.)?.{3,}(?:\.{3,}|…)\s*\d+\s*$"
#: Forms of headings (level, pattern of label and title), tried in this order.
HEADINGS = (
    (1, r"(?i)^\((Titre)\)\s*(.+)$"),
    (2, r"(?i)^\((Intertitre)\)\s*(.+)$"),
    (1, r"^([IVXLC]+-)\s*(.+)$"),
    (2, r"^([A-Z]\.)\s*(.+)$"),
    (2, r"^(\d+\s*:)\s*(.+)$"),
    (3, r"^(\d+\.[a-z])\s*(.+)$"),
    (3, r"^(\d+\.)\s*(.+)$"),
    (4, r"^([a-z]\.)\s*(.+)$"),
    (4, r"^([✓✔☑])\s*(.+)$"),
)
#: What opens a marked question, what is a heading beside it, and what makes a question a sub-question.
QUESTION = r"(?iu)^(?:Q(?:uestion)?\s*[:\-]\s*|(?:Quel(?:le|s)?|Comment|Pourquoi|Quand|Dans quel(?:le)?|L'agent|Le contractuel|Vous)\b.*\?\s*$|(?:Quelle est la procédure|Le contractuel a-t-il droit|L'agent a-t-il droit)\b.*)"
MARKED_HEADING = r"(?i)^[IVXLC]+[\.\-]\s+|^\d+[\.\)]\s+|^FICHE\s*\d+\b|^ANNEXE\s*\d+\b"
SUB_QUESTION = r"(?iu)(procédure|préavis|montant|conditions|conséquences|droit|indemnité|reclassement|cas particulier|délais|pièces|modalités|exceptions?)"
#: Words of actors and steps, names of branches, sections and entities of a matrix.
ACTORS = ("sgcd", "dreets", "ddets", "drhm", "cbcm", "dgfip", "renoirh", "prefet", "agent", "services deconcentres", "service recruteur")
STEPS = ("publication", "selection", "production", "signature", "depot", "validation", "creation", "mise en paie", "pre liquidation", "simulation", "recrutement")
BRANCHES = {"si respect rdr": "Respect du RDR", "respect rdr": "Respect du RDR", "si hors rdr": "Hors RDR", "hors rdr": "Hors RDR", "si refus cbcm": "Refus du CBCM", "si visa cbcm": "Visa du CBCM"}
MATRIX_SECTIONS = ("Propositions financières", "Signature des contrats et avenants", "Fin du contrat", "Modalités de service", "Formation et concours", "Absences et congés", "Disciplinaire")
ENTITIES = ("Déconcentré", "DRH-BPECO", "DRH-BPECO / CBCM", "CBCM")
MATRIX_ROW = r"^(.+?)\s+(\d+°|-)\s+(Déconcentré|DRH-BPECO(?: / CBCM)?|CBCM)$"
PAGE = r"^\[(?:PAGE|SLIDE) "
MARKER = r"(?i)^\((?:Titre|Intertitre)\)\s*"
BLOCKS = ["doc_id", "section_index", "level", "title", "parent_path", "path", "question", "answer", "qa_id", "parent_qa_id"]


def _over(*keys: str, upto: int = 0):
    return Window.partitionBy("doc_id", *keys).orderBy("n").rowsBetween(Window.unboundedPreceding, upto)


def _once(rows: DataFrame, name: str) -> DataFrame:
    """rows, written once for all that reads them."""
    return Scratch(rows.sparkSession, "blocks").save(rows, name)


def _bound(c: Column, f) -> Column:
    """f(c), where c is computed once, however often f uses it."""
    return F.transform(F.array(c), f)[0]


def squeezed(c: Column) -> Column:
    """Lower case without accents, blanks squeezed."""
    return F.trim(F.regexp_replace(F.lower(F.translate(c, T.ACCENTED, T.PLAIN)), "\\s+", " "))


def n_words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, " "), lambda w: w != ""))


def text_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n, line of docs (doc_id, text): blanks squeezed, tables of contents taken out."""
    unix = F.replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    rows = docs.filter("text is not null").select("doc_id", F.posexplode(F.split(unix, "\n")).alias("n", "line"))
    rows = rows.withColumn("line", F.trim(F.regexp_replace("line", "[ \\t]+", " ")))
    starts = squeezed(F.regexp_replace("line", MARKER, "")).isin(*TOC_TITLES)
    rows = rows.withColumn("start", starts).withColumn("toc", F.sum(F.col("start").cast("int")).over(_over()))
    entry, blank = F.col("line").rlike(TOC_ENTRY), F.col("line").rlike("^$|^\\[PAGE [23]\\]$")
    rows = rows.withColumn("entry", entry & ~F.col("start")).withColumn("hits", F.coalesce(F.sum(F.col("entry").cast("int")).over(_over("toc", upto=-1)), F.lit(0)))
    miss = ~F.col("entry") & ~F.col("start") & ~(blank & (F.col("hits") > 0))
    rows = rows.withColumn("miss", miss).withColumn("misses", F.sum(F.col("miss").cast("int")).over(_over("toc")))
    leaves = F.col("miss") & ((F.col("hits") >= 3) | (F.col("misses") >= 3))
    inside = F.coalesce(F.sum(leaves.cast("int")).over(_over("toc", upto=-1)), F.lit(0)) == 0
    gone = F.col("start") | ((F.col("toc") > 0) & inside & (F.col("entry") | (blank & (F.col("hits") > 0))))
    return rows.withColumn("gone", gone).filter(~F.col("gone")).select("doc_id", "n", "line")


def heading(line: Column, mode: Column, extra: tuple[tuple[int, str], ...] = ()) -> Column:
    """struct<level, label, title> of a heading line, else null. mode: none, strict or normal, for lines that only look like one."""
    return _bound(F.trim(F.regexp_replace(line, "(?:\\.{3,}|…)\\s*\\d+$", "")), lambda clean: _heading(clean, mode, extra))


def _heading(clean: Column, mode: Column, extra: tuple[tuple[int, str], ...]) -> Column:
    bare = lambda c: F.regexp_replace(c, "^[ \\-:\\t]+|[ \\-:\\t]+$", "")
    make = lambda level, label, title: F.struct(level.cast("int").alias("level"), label.alias("label"), title.alias("title"))
    out = F.when((clean == "") | clean.rlike(PAGE), F.lit(None))
    for k, (level, form) in enumerate(HEADINGS + tuple(extra)):
        label, title = F.regexp_extract(clean, form, 1), bare(F.regexp_extract(clean, form, 2))
        numbering = F.regexp_extract(title, "^(\\d+(?:\\.\\d+)*)[\\s.)\\-–:]", 1)
        own = F.when(numbering != "", F.least(F.lit(4), F.size(F.split(numbering, "\\.")))).otherwise(F.lit(level)) if k < 2 else F.lit(level)
        out = out.when(clean.rlike(form) & (title != ""), make(own, label, title))
    words, letters = n_words(clean), F.regexp_replace(clean, "[^\\p{L}]", "")
    upper = F.length(F.regexp_replace(clean, "[^\\p{Lu}]", ""))
    strong = (F.length(letters) > 0) & (upper >= 0.75 * F.length(letters))
    with_letter = F.size(F.filter(F.split(clean, " "), lambda w: w.rlike("\\p{L}")))
    looks = (mode != "none") & (F.length(clean) <= 90) & clean.rlike("^\\p{Lu}") & ((mode != "strict") | strong) & words.between(2, 10) & ~clean.rlike("[.;,]$") & (2 * with_letter >= words)
    out = out.when(clean.endswith("?") & (F.length(clean) <= 140) & (words <= 14), make(F.lit(2), F.lit("Q."), F.regexp_replace(clean, "^[ ?]+|[ ?]+$", "")))
    return out.when(looks, make(F.lit(2), F.lit("H."), clean))


def _real(line: Column, extra: tuple[tuple[int, str], ...] = ()) -> Column:
    """Whether a line is a heading by its form."""
    return _bound(heading(line, F.lit("none"), extra), lambda h: h.isNotNull() & F.coalesce(h["label"] != "Q.", F.lit(False)))


def _answers(rows: DataFrame, keys: list[str], keep: Column, sep: str = "\n") -> DataFrame:
    """keys, answer of the rows' lines in order (blank runs to one empty line); a block's lines are a part of one document."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("n", "line")))), lambda x: x["line"]), sep)
    return rows.groupBy(*keys).agg(F.regexp_replace(F.regexp_replace(joined, "\\n{3,}", "\n\n"), "^\\s+|\\s+$", "").alias("answer"))


def user_question(title: Column, path: Column) -> Column:
    """A question that the section of this title answers."""
    t = F.lower(F.regexp_replace(title, "^[ .]+|[ .]+$", ""))
    rules = t.rlike("procedure|renouvellement|recrutement|conge|temps partiel|remuneration")
    about = F.when(path != "", F.concat(F.lit("Que faut-il savoir sur "), t, F.lit(" dans le cadre de "), F.lower(path), F.lit(" ?"))).otherwise(F.concat(F.lit("Que faut-il savoir sur "), t, F.lit(" ?")))
    return F.when(t == "", "Quelles sont les regles applicables dans cette section ?").when(t.rlike("^(?:le |la |les |l')"), F.concat(F.lit("Quelles sont les regles relatives a "), t, F.lit(" ?"))).when(rules, F.concat(F.lit("Quelle est la procedure ou les regles concernant "), t, F.lit(" ?"))).otherwise(about)


def _qa_id(*parts: Column | str) -> Column:
    return F.sha1(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("None")) for p in parts]))


def guide_blocks(lines: DataFrame, extra: tuple[tuple[int, str], ...] = ()) -> DataFrame:
    """Headings open blocks below the nearest heading of a lower level before them; a line in lower case or a bracket right
    after a heading continues its title. Lines that only look like headings count in documents without real ones."""
    doc = Window.partitionBy("doc_id")
    rows = lines.withColumn("real", _real(F.col("line"), extra).cast("int")).withColumn("marked", F.col("line").rlike(MARKER).cast("int"))
    mode = F.when(F.sum("marked").over(doc) >= 2, "none").when(F.sum("real").over(doc) >= 2, "strict").otherwise("normal")
    rows = rows.withColumn("h", heading(F.col("line"), mode, extra)).withColumn("block", F.sum(F.col("h").isNotNull().cast("int")).over(_over())).filter("block > 0")
    goes_on = F.col("h").isNull() & F.col("line").rlike("^[\\p{Ll}(]") & (F.length("line") <= 160) & ~F.first(F.col("h")["label"]).over(_over("block")).isin("Titre", "Intertitre")
    stops = F.col("h").isNull() & ~goes_on
    rows = rows.withColumn("tail", goes_on & (F.sum(stops.cast("int")).over(_over("block")) == 0)).withColumn("is_title", F.col("h").isNotNull() | F.col("tail"))
    rows = _once(rows.select("doc_id", "n", "line", "h", "block", "is_title"), "guide")
    titles = _answers(rows.withColumn("line", F.coalesce(F.col("h")["title"], F.regexp_replace("line", "^[ \\-]+|[ \\-]+$", ""))), ["doc_id", "block"], F.col("is_title"), " ").withColumnRenamed("answer", "title")
    heads = rows.filter("h is not null").select("doc_id", "n", "block", F.col("h")["level"].alias("level"), F.col("h")["label"].alias("label")).join(titles, ["doc_id", "block"])
    heads = heads.withColumn("qa_id", _qa_id("guide", F.col("doc_id"), F.col("block"), F.col("level"), F.col("title")))
    last = lambda k: F.last(F.when(F.col("level") == k, F.struct("n", "title", "qa_id")), ignorenulls=True).over(_over(upto=-1))
    for k in (1, 2, 3):
        heads = heads.withColumn(f"l{k}", last(k))
    # A level's last heading is still open if no heading of a lower level came after it.
    alive = {k: F.when((F.col("level") > k) & reduce(lambda a, j: a & (F.col(f"l{j}").isNull() | (F.col(f"l{j}")["n"] < F.col(f"l{k}")["n"])), range(1, k), F.lit(True)), F.col(f"l{k}")) for k in (1, 2, 3)}
    above = F.array_compact(F.array(*alive.values()))
    heads = heads.withColumn("above", above).withColumn("parent_path", F.nullif(F.array_join(F.transform("above", lambda x: x["title"]), " > "), F.lit("")))
    heads = heads.withColumn("path", F.concat_ws(" > ", "parent_path", "title")).withColumn("parent_qa_id", F.when(F.size("above") > 0, F.element_at("above", -1)["qa_id"]))
    body = _answers(rows, ["doc_id", "block"], ~F.col("is_title"))
    out = heads.join(body, ["doc_id", "block"]).filter((F.col("answer") != "") & ~squeezed(F.col("title")).isin(*TOC_TITLES))
    return out.withColumn("question", user_question(F.col("title"), F.col("path"))).withColumn("section_index", F.col("block").cast("int")).select(BLOCKS)


def marked_blocks(lines: DataFrame) -> DataFrame:
    """Question lines open blocks; the last four headings before the next question are their path. A sub-question hangs on the
    last root question of its path; the first of a path is a root."""
    rows = lines.withColumn("line", F.regexp_replace("line", MARKER, ""))
    rows = rows.withColumn("is_q", F.col("line").rlike(QUESTION)).withColumn("is_h", ~F.col("is_q") & F.col("line").rlike(MARKED_HEADING))
    rows = _once(rows.withColumn("title", F.nullif(F.when(F.col("is_h"), F.trim(F.regexp_replace("line", "^[IVXLC]+[.\\-]\\s+|\\d+[.)]\\s+", ""))), F.lit(""))), "marked")
    heads = rows.filter("title is not null").withColumn("path", F.concat_ws(" > ", *[F.lag("title", k).over(Window.partitionBy("doc_id").orderBy("n")) for k in (3, 2, 1)], "title")).select("doc_id", "n", "path")
    rows = rows.join(heads, ["doc_id", "n"], "left").withColumn("path", F.last("path", ignorenulls=True).over(_over())).withColumn("block", F.sum(F.col("is_q").cast("int")).over(_over())).filter("block > 0")
    rows = _once(rows.select("doc_id", "n", "line", "is_q", "is_h", "path", "block"), "marked_lines")
    g = rows.groupBy("doc_id", "block").agg(F.min_by("line", "n").alias("title"), F.max_by("path", "n").alias("parent_path"), F.min("n").alias("n"))
    g = g.join(_answers(rows, ["doc_id", "block"], ~F.col("is_q") & ~F.col("is_h")), ["doc_id", "block"]).withColumn("qa_id", F.sha1(F.lower(F.trim(F.regexp_replace("title", "\\s+", " ")))))
    by_path = Window.partitionBy("doc_id", "parent_path").orderBy("n")
    root = ~F.col("title").rlike(SUB_QUESTION) | (F.row_number().over(by_path) == 1)
    g = g.withColumn("root", root).withColumn("parent_qa_id", F.when(~F.col("root"), F.last(F.when(F.col("root"), F.col("qa_id")), ignorenulls=True).over(by_path.rowsBetween(Window.unboundedPreceding, -1))))
    out = g.filter("answer <> ''").withColumn("level", F.lit(3)).withColumn("path", F.concat_ws(" > ", "parent_path", "title")).withColumn("section_index", F.col("block").cast("int"))
    return out.withColumn("question", F.when(F.col("title").endswith("?"), F.col("title")).otherwise(F.concat("title", F.lit("?")))).select(BLOCKS)


_NUMBERED = r"^\d{1,2}\s*\.\s*(.+)$"


def faq_lines(lines: DataFrame) -> DataFrame:
    """doc_id, n, line, kind ('section', 'question', 'body'), title: numbered lines are joined with what follows up to their
    question mark (sections: up to the next break); entries of a table of contents, page marks and page numbers are left out."""
    rows = lines.withColumn("line", F.regexp_replace("line", MARKER, ""))
    numbered, entry = F.col("line").rlike(_NUMBERED), F.col("line").rlike(r"\.{5,}\s*\d+\s*$") | (F.col("line").rlike(_NUMBERED) & F.col("line").rlike(r"\?\s+\d{1,3}$"))
    dropped = (F.col("line") == "") | F.col("line").rlike(PAGE) | F.col("line").rlike(r"^\d{1,3}$") | entry
    rows = rows.withColumn("dropped", dropped).withColumn("numbered", numbered & ~F.col("dropped"))
    breaks = F.col("numbered") | (F.col("line") == "") | F.col("line").rlike(PAGE) | entry
    rows = rows.withColumn("seg", F.sum(breaks.cast("int")).over(_over())).filter(~F.col("dropped"))
    title = F.regexp_replace(F.regexp_extract("line", _NUMBERED, 1), "^[ \\-:\\t]+|[ \\-:\\t]+$", "")
    letters, upper = F.length(F.regexp_replace(title, "[^\\p{L}]", "")), F.length(F.regexp_replace(title, "[^\\p{Lu}]", ""))
    section = F.col("numbered") & (letters > 0) & (upper >= 0.65 * letters) & (n_words(title) >= 2)
    seg = Window.partitionBy("doc_id", "seg")
    rows = rows.withColumn("section", section).withColumn("headed", F.max("numbered").over(seg)).withColumn("as_section", F.max("section").over(seg))
    ends = F.min(F.when(F.col("line").contains("?"), F.col("n"))).over(seg)
    rows = _once(rows.withColumn("joined", F.col("headed") & (F.col("as_section") | ends.isNull() | (F.col("n") <= ends))), "faq")
    heads = _answers(rows.filter("joined"), ["doc_id", "seg", "as_section"], F.lit(True), " ").join(rows.filter("numbered").select("doc_id", "seg", "n"), ["doc_id", "seg"]).withColumnRenamed("answer", "line")
    whole = F.regexp_replace(F.regexp_extract("line", _NUMBERED, 1), "^[ \\-:\\t]+|[ \\-:\\t]+$", "")
    kind = F.when(F.col("as_section"), "section").when(whole.contains("?") & (n_words(whole) >= 3), "question").otherwise("body")
    return heads.select("doc_id", "n", "line", kind.alias("kind"), whole.alias("title")).unionByName(rows.filter("not joined").select("doc_id", "n", "line", F.lit("body").alias("kind"), F.lit(None).cast("string").alias("title")))


def faq_blocks(lines: DataFrame) -> DataFrame:
    """Numbered questions open blocks, numbered lines in capitals sections; a section ends the block before it."""
    rows = faq_lines(lines).withColumn("opens", (F.col("kind") != "body").cast("int"))
    rows = rows.withColumn("part", F.sum("opens").over(_over())).withColumn("section_index", F.sum((F.col("kind") == "question").cast("int")).over(_over())).withColumn("parent_path", F.last(F.when(F.col("kind") == "section", F.col("title")), ignorenulls=True).over(_over()))
    rows = _once(rows, "faq_lines")
    heads = rows.filter("kind = 'question'").select("doc_id", "part", "title", "parent_path", "section_index")
    out = heads.join(_answers(rows.filter("kind = 'body' and part > 0"), ["doc_id", "part"], F.lit(True)), ["doc_id", "part"]).filter("answer <> ''")
    out = out.withColumn("qa_id", _qa_id("faq", F.col("doc_id"), F.col("section_index"), F.col("parent_path"), F.col("title"))).withColumn("parent_qa_id", F.lit(None).cast("string")).withColumn("level", F.lit(3))
    return out.withColumn("path", F.concat_ws(" > ", "parent_path", "title")).withColumn("question", F.when(F.col("title").endswith("?"), F.col("title")).otherwise(F.concat("title", F.lit("?")))).withColumn("section_index", F.col("section_index").cast("int")).select(BLOCKS)


def _has(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, w: a | c.contains(w), words, F.lit(False))


def _boilerplate(c: Column) -> Column:
    return _bound(squeezed(c), _says_nothing)


def _says_nothing(norm: Column) -> Column:
    return (norm == "") | norm.isin(*BOILERPLATE) | norm.rlike(r"^\d{1,2}/\d{2}/\d{4}$") | norm.rlike(r"^\d{1,3}$")


def _step_title(c: Column) -> Column:
    shape = (F.length(c) <= 110) & n_words(c).between(2, 12) & ~c.rlike("^-|:$")
    said = lambda norm: ~_says_nothing(norm) & ~norm.isin(*BRANCHES) & ~_has(norm, ACTORS) & (_has(norm, STEPS) | c.rlike("^\\p{Lu}.*[^.;,]$"))
    return shape & _bound(squeezed(c), said)


def merged_fragments(lines: DataFrame) -> DataFrame:
    """Runs of lines of three words at most become lines of up to three of them."""
    rows = lines.withColumn("line", F.regexp_replace("line", MARKER, ""))
    short = (n_words(F.col("line")) <= 3) & (F.col("line") != "") & ~F.col("line").rlike(PAGE)
    rows = rows.withColumn("short", short).withColumn("run", F.sum((~F.col("short")).cast("int")).over(_over()))
    rows = rows.withColumn("k", F.floor((F.sum(F.col("short").cast("int")).over(_over("run")) - 1) / 3))
    group = F.when(F.col("short"), F.col("k")).otherwise(-1)
    rows = rows.withColumn("k", group)
    joined = rows.groupBy("doc_id", "run", "k").agg(F.min("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), " ").alias("line"))
    return joined.filter("line <> ''").select("doc_id", "n", "line")


def process_blocks(lines: DataFrame) -> DataFrame:
    """Step titles open blocks under the last heading and branch; the first actor named below a step is its main one. A heading
    or a branch ends the step before it."""
    rows = merged_fragments(lines).filter(~_boilerplate(F.col("line")) & ~F.col("line").rlike(PAGE))
    said = lambda norm: F.struct(F.coalesce(*[F.when(norm == k, F.lit(v)) for k, v in BRANCHES.items()]).alias("branch"), _has(norm, ACTORS).alias("acts"))
    rows = rows.withColumn("h", heading(F.col("line"), F.lit("normal"))["title"]).withColumn("said", F.when(F.col("h").isNull(), _bound(squeezed(F.col("line")), said)))
    rows = rows.withColumn("branch", F.col("said")["branch"]).withColumn("actor", F.when(F.col("h").isNull() & F.col("branch").isNull() & F.col("said")["acts"], F.col("line")))
    rows = _once(rows.withColumn("step", F.col("h").isNull() & F.col("branch").isNull() & F.col("actor").isNull() & _step_title(F.col("line"))).drop("said"), "process")
    rows = rows.withColumn("part", F.sum((F.col("step") | F.col("h").isNotNull() | F.col("branch").isNotNull()).cast("int")).over(_over())).withColumn("section_index", F.sum(F.col("step").cast("int")).over(_over()))
    rows = rows.withColumn("parent_path", F.last("h", ignorenulls=True).over(_over())).withColumn("hn", F.max(F.when(F.col("h").isNotNull(), F.col("n"))).over(_over())).withColumn("b", F.last(F.when(F.col("branch").isNotNull(), F.struct("n", "branch")), ignorenulls=True).over(_over()))
    rows = rows.withColumn("b", F.when(F.col("b")["n"] > F.coalesce("hn", F.lit(-1)), F.col("b")["branch"]))
    heads = rows.filter("step").select("doc_id", "part", F.col("line").alias("title"), "parent_path", "b", "section_index")
    below = rows.filter("not step and h is null and branch is null")
    g = heads.join(below.groupBy("doc_id", "part").agg(F.min_by("actor", F.when(F.col("actor").isNotNull(), F.col("n"))).alias("actor")), ["doc_id", "part"], "left").join(_answers(below, ["doc_id", "part"], F.lit(True)), ["doc_id", "part"], "left")
    said = F.concat_ws("\n", F.concat(F.lit("Branche: "), "b"), F.concat(F.lit("Acteur principal: "), "actor"), F.nullif("answer", F.lit("")))
    t, low = F.lower(F.regexp_replace("title", "^[ .]+|[ .]+$", "")), lambda c: F.lower(F.col(c))
    question = F.when(F.col("b").isNotNull() & F.col("actor").isNotNull(), F.concat(F.lit("Que doit faire "), low("actor"), F.lit(" pour "), t, F.lit(" dans le cas "), low("b"), F.lit(" ?"))).when(F.col("b").isNotNull(), F.concat(F.lit("Que faut-il faire pour "), t, F.lit(" dans le cas "), low("b"), F.lit(" ?"))).when(F.col("actor").isNotNull(), F.concat(F.lit("Quel est le role de "), low("actor"), F.lit(" pour "), t, F.lit(" ?"))).otherwise(F.concat(F.lit("Quelle est l'etape ou la regle concernant "), t, F.lit(" dans le processus ?")))
    out = g.withColumn("question", question).withColumn("path", F.concat_ws(" > ", "parent_path", "b", "title")).withColumn("answer", F.coalesce(F.nullif(said, F.lit("")), F.col("title"))).withColumn("level", F.lit(2)).withColumn("parent_qa_id", F.lit(None).cast("string"))
    return out.withColumn("qa_id", _qa_id("process", F.col("parent_path"), F.col("b"), F.col("title"), F.col("section_index"))).withColumn("section_index", F.col("section_index").cast("int")).select(BLOCKS)


def matrix_blocks(lines: DataFrame) -> DataFrame:
    """Rows 'act alinea entity' of a matrix of acts; an act of several lines ends with a line that is its entity. The first two
    bullet lines after 'Notice' are noted in every row below."""
    rows = lines.withColumn("line", F.regexp_replace("line", MARKER, "")).filter((F.col("line") != "") & ~F.col("line").rlike(PAGE))
    plain = lambda x: x.lower().translate(str.maketrans(T.ACCENTED, T.PLAIN))
    named = ("type d'actes", "entite de gestion", "type d'actes entite de gestion", "entite de gestion type d'actes", "attention !")

    def said(norm: Column) -> Column:
        dropped = norm.isin(*named) | norm.rlike("^(references :|arretes du|les actes devront etre)")
        section = F.coalesce(*[F.when((norm == plain(name)) | norm.startswith(plain(name) + " "), F.lit(name)) for name in MATRIX_SECTIONS])
        entity = F.coalesce(*[F.when(norm == plain(e), F.lit(e)) for e in ENTITIES])
        notice = norm.rlike("^(la colonne|a gauche|les autres feuilles)")
        return F.struct(dropped.alias("dropped"), section.alias("section"), entity.alias("entity"), notice.alias("notice"), _says_nothing(norm).alias("empty"))

    rows = rows.withColumn("said", _bound(squeezed(F.col("line")), said)).select("doc_id", "n", "line", "said.*", F.col("line").rlike(MATRIX_ROW).alias("direct"))
    rows = _once(rows, "matrix").filter("not dropped")
    alinea = F.col("line").rlike(r"^(?:\d+°|-)$")
    kind = F.when(F.col("direct"), "row").when(F.col("line") == "Notice", "end").when(F.col("section").isNotNull(), "section").when(F.col("notice") | F.col("line").startswith("•"), "notice").when(F.col("entity").isNotNull(), "entity").when(alinea, "alinea").when(F.col("empty"), "none").otherwise("part")
    rows = rows.withColumn("kind", kind).withColumn("section", F.last(F.when(F.col("kind") == "section", F.col("section")), ignorenulls=True).over(_over())).filter("kind <> 'none'")
    ends = F.col("kind").isin("row", "section", "entity", "end")
    rows = rows.withColumn("group", F.coalesce(F.sum(ends.cast("int")).over(_over(upto=-1)), F.lit(0)))
    # Of the notices above a line the first two, by their number: no row holds the list of all.
    rows = rows.withColumn("place", F.sum((F.col("kind") == "notice").cast("int")).over(_over()))
    note = lambda k: F.first(F.when((F.col("kind") == "notice") & (F.col("place") == k), F.regexp_replace("line", "^[• ]+", "")), ignorenulls=True).over(_over())
    rows = _once(rows.withColumn("notes", F.array_compact(F.array(note(1), note(2)))).select("doc_id", "n", "line", "kind", "section", "entity", "group", "notes"), "matrix_lines")
    single = rows.filter("kind = 'row'").select("doc_id", "n", "section", "notes", F.regexp_extract("line", MATRIX_ROW, 1).alias("title"), F.regexp_extract("line", MATRIX_ROW, 2).alias("alinea"), F.regexp_extract("line", MATRIX_ROW, 3).alias("entity"))
    act = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "part", F.struct("n", "line")))), lambda x: x["line"]), " ")
    several = rows.groupBy("doc_id", "group").agg(F.max("n").alias("n"), F.max_by("section", "n").alias("section"), F.max_by("notes", "n").alias("notes"), act.alias("title"), F.max(F.when(F.col("kind") == "alinea", F.col("line"))).alias("alinea"), F.max("entity").alias("entity")).filter("entity is not null and title <> ''")
    both = single.unionByName(several.select(single.columns)).withColumn("section_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("n")))
    said = F.concat_ws("\n", F.concat(F.lit("Rubrique: "), F.coalesce("section", F.lit("-"))), F.concat(F.lit("Type d'acte: "), "title"), F.concat(F.lit("Alinéa de référence: "), F.coalesce("alinea", F.lit("-"))), F.concat(F.lit("Entité de gestion: "), "entity"), F.concat(F.lit("Notice: "), F.nullif(F.array_join("notes", " "), F.lit(""))))
    low = F.lower(F.regexp_replace("title", "[ .]+$", ""))
    question = F.concat(F.lit("Quelle entite de gestion est competente pour "), low, F.when(F.coalesce("alinea", F.lit("-")) != "-", F.concat(F.lit(" au titre de l'alinea "), "alinea")).otherwise(F.concat(F.lit(" dans la rubrique "), F.lower(F.coalesce("section", F.lit("-"))))), F.lit(" ?"))
    out = both.withColumn("answer", said).withColumn("question", question).withColumn("parent_path", F.col("section")).withColumn("path", F.concat_ws(" > ", "section", "title")).withColumn("level", F.lit(2)).withColumn("parent_qa_id", F.lit(None).cast("string"))
    return out.withColumn("qa_id", _qa_id("table", F.col("section"), F.col("title"), F.col("alinea"), F.col("entity"), F.col("section_index"))).select(BLOCKS)


def deduped(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """The first block of equal path, question and answer of a document, numbered anew from 1."""
    kept = blocks.withColumn("__k", F.row_number().over(Window.partitionBy(*keys, "path", "question", "answer").orderBy("section_index"))).filter("__k = 1").drop("__k")
    return kept.withColumn("section_index", F.row_number().over(Window.partitionBy(*keys).orderBy("section_index")))


def route(docs: DataFrame, modes: tuple[str, ...] = ("matrix", "faq", "marked", "process", "guide"), least: float = 0.35) -> DataFrame:
    """mode, coverage and the blocks of each document of docs (doc_id, text) by the first of ``modes`` that looks like it and whose
    blocks hold at least ``least`` of its characters; else one block of the whole text, so that no text is lost."""
    lines = _once(text_lines(docs), "lines")
    said = lambda norm: F.struct(norm.contains("type d'actes").alias("acts"), norm.isin("deconcentre", "drh-bpeco", "drh-bpeco / cbcm", "cbcm").alias("entity"), norm.contains("logigramme").alias("named"), (norm.isin(*BRANCHES) | _has(norm, ACTORS)).alias("acting"))
    question = F.col("line").contains("?") & F.col("line").rlike(_NUMBERED)
    marks = lines.withColumn("said", _bound(squeezed(F.col("line")), said)).withColumn("heading", _real(F.col("line")))
    looks = marks.groupBy("doc_id").agg(
        F.sum(F.when(F.col("line").rlike(PAGE), 0).otherwise(F.length("line"))).alias("size"),
        F.max("said.acts").alias("acts"), F.sum((F.col("said.entity") | F.col("line").rlike(MATRIX_ROW)).cast("int")).alias("entities"),
        F.sum(question.cast("int")).alias("questions"), F.sum(F.col("line").rlike(QUESTION).cast("int")).alias("marked"),
        F.sum(F.col("heading").cast("int")).alias("headings"), F.max("said.named").alias("named"), F.avg((n_words(F.col("line")) <= 4).cast("int")).alias("short"),
        F.sum((F.col("said.acting") | _step_title(F.col("line"))).cast("int")).alias("steps"),
        F.min_by("line", F.when(F.col("line") != "", F.col("n"))).alias("first_line"),
    )
    looks = _once(looks, "looks")
    process = F.col("named") | ((F.col("headings") < 2) & (F.col("short") >= 0.35) & (F.col("steps") >= 8))
    fits = {"matrix": F.col("acts") & (F.col("entities") >= 5), "faq": F.col("questions") >= 5, "marked": F.col("marked") >= 1, "process": process, "guide": F.lit(True)}
    parse = {"matrix": matrix_blocks, "faq": faq_blocks, "marked": marked_blocks, "process": process_blocks, "guide": guide_blocks}
    found = []
    for k, mode in enumerate(modes):
        mine = looks.filter(fits[mode]).select("doc_id", "size")
        found.append(parse[mode](lines.join(mine.select("doc_id"), "doc_id", "left_semi")).withColumn("mode", F.lit(mode)).withColumn("k", F.lit(k)))
    every = _once(reduce(DataFrame.unionByName, found), "blocks")
    covers = every.groupBy("doc_id", "mode", "k").agg(F.sum(F.length("answer") + F.length("title")).alias("held")).join(looks.select("doc_id", "size"), "doc_id").withColumn("coverage", F.round(F.least(F.lit(1.0), F.col("held") / F.greatest("size", F.lit(1))), 6)).filter(F.col("coverage") >= least)
    best = covers.groupBy("doc_id").agg(F.min_by(F.struct("mode", "coverage"), "k").alias("b")).select("doc_id", "b.*")
    blocks = every.join(best, ["doc_id", "mode"]).drop("k")
    rest = docs.join(looks.filter("size > 0").select("doc_id", "first_line"), "doc_id").join(best.select("doc_id"), "doc_id", "left_anti")
    title = F.col("first_line")
    whole = rest.select("doc_id", F.lit(1).alias("section_index"), F.lit(1).alias("level"), title.alias("title"), F.lit(None).cast("string").alias("parent_path"), title.alias("path"), user_question(title, title).alias("question"), F.col("text").alias("answer"), _qa_id("fallback", F.col("doc_id")).alias("qa_id"), F.lit(None).cast("string").alias("parent_qa_id"), F.lit("fallback").alias("mode"), F.lit(1.0).alias("coverage"))
    return deduped(blocks.unionByName(whole.select(blocks.columns)), ["doc_id"])


def block_chunks(blocks: DataFrame, form: str = "section", composite: int = 3000, size: int = 1200, overlap: int = 200) -> DataFrame:
    """blocks with role, position, chunk: Q_ONLY (0), QA_COMPOSITE (1, cut at ``composite`` characters) and, of answers over
    ``size``, windows A_ATOMIC (from 2) that hold the whole answer; form: 'qr' or 'section'. Equal chunks of a document once."""
    head = F.concat(F.lit("Q: "), "question", F.lit("\nR: ")) if form == "qr" else F.concat(F.lit("Titre: "), "title", F.lit("\nSection: "), "path", F.lit("\nQuestion utilisateur probable: "), "question", F.lit("\n\n"))
    step = max(1, size - overlap)
    windows = F.when(F.length("answer") > size, F.transform(F.sequence(F.lit(0), F.length("answer") - 1, F.lit(step)), lambda s: F.struct(F.lit("A_ATOMIC").alias("role"), (2 + F.call_function("div", s, F.lit(step))).cast("int").alias("position"), F.substring(F.col("answer"), s + 1, F.lit(size)).alias("chunk"))))
    one = lambda role, position, text: F.struct(F.lit(role).alias("role"), F.lit(position).alias("position"), text.alias("chunk"))
    every = F.concat(F.array(one("Q_ONLY", 0, F.col("question")), one("QA_COMPOSITE", 1, F.substring(F.concat(head, "answer"), 1, composite))), F.coalesce(windows, F.array().cast("array<struct<role:string,position:int,chunk:string>>")))
    rows = blocks.select("doc_id", "section_index", "qa_id", F.explode(every).alias("c")).select("doc_id", "section_index", "qa_id", "c.*")
    return rows.groupBy("doc_id", "qa_id", "role", "position", "chunk").agg(F.min("section_index").alias("section_index"))
