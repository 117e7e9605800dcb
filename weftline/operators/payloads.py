"""Payloads of outside services as columns: page batches, image annotations, nested tables of contents, cited sources."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Forms of an image and of a citation; the texts and prefixes below are what stored payloads have as well.
IMAGE = r"!\[[^\]]*\]\(([^)]*)\)"
CITATION = r"\[(\d+)\]"


def rewrite(text: Column, pattern: str, make: Callable[[Column, Column], Column]) -> Column:
    """text with each match of pattern replaced by make(match, group 1). Null stays null."""
    between = F.split(text, pattern, -1)
    whole, group = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, 1))
    made = F.zip_with(whole, group, make)
    return F.array_join(F.zip_with(between, made, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def annotate_images(text: Column, notes: Column) -> Column:
    """Image references replaced by what is known of the image.

    notes: map of image id to struct(kind, description). Decorative images go, those with a description become it, and a
    reference without a note or with an empty description stays as it is.
    """

    def make(ref: Column, image: Column) -> Column:
        note = F.try_element_at(notes, F.trim(image))
        return F.when(note["kind"] == "decorative", "").when(F.length(note["description"]) > 0, F.concat(F.lit("[Illustration — "), note["description"], F.lit("]"))).otherwise(ref)

    return rewrite(text, IMAGE, make)


def cited_sources(hits: DataFrame) -> DataFrame:
    """answer_id, key, source_no (1 for the source that an answer's hits show first). hits: answer_id, position, key."""
    first = hits.groupBy("answer_id", "key").agg(F.min("position").alias("first"))
    return first.select("answer_id", "key", F.row_number().over(Window.partitionBy("answer_id").orderBy("first", "key")).alias("source_no"))


def renumber_citations(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """answer_id, answer, n_sources: each [position] becomes [source_no] of that hit; other numbers stay.

    answers: answer_id, answer; hits: answer_id, position, key (a few dozen an answer, as a search returns them).
    """
    numbered = hits.join(cited_sources(hits), ["answer_id", "key"]).groupBy("answer_id").agg(F.map_from_entries(F.collect_set(F.struct(F.col("position").cast("string"), F.col("source_no").cast("string")))).alias("places"), F.max("source_no").alias("n_sources"))
    joined = answers.join(numbered, "answer_id", "left")
    new = rewrite(F.col("answer"), CITATION, lambda ref, n: F.coalesce(F.concat(F.lit("["), F.try_element_at(F.col("places"), F.regexp_replace(n, "^0+(?=.)", "")), F.lit("]")), ref))
    return joined.select("answer_id", new.alias("answer"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"))


def batch_pages(payloads: DataFrame) -> DataFrame:
    """A row for each page: document_id, batch, place, page, markdown, images, with image ids made unique within the document.

    payloads: document_id, batch, pages array<struct<index, markdown, images array<string>>>. Blank image ids stay.
    """
    page = payloads.select("document_id", "batch", F.posexplode("pages").alias("place", "p"))
    prefix = F.format_string("page-%04d-", F.coalesce("p.index", F.lit(0)))
    # A lambda of one argument: F.trim itself would take the index as the characters to trim.
    ids = F.transform(F.coalesce("p.images", F.array().cast("array<string>")), lambda i: F.trim(i))
    named = F.transform(ids, lambda i: F.when(i != "", F.concat(prefix, i)).otherwise(i))
    text = F.aggregate(F.array_distinct(F.filter(ids, lambda i: i != "")), F.coalesce("p.markdown", F.lit("")), lambda t, i: F.replace(t, i, F.concat(prefix, i)))
    return page.select("document_id", "batch", "place", F.col("p.index").alias("page"), text.alias("markdown"), named.alias("images"))


def batch_totals(payloads: DataFrame) -> DataFrame:
    """document_id, n_pages, pages_processed, doc_size_bytes of all batches of a document."""
    return payloads.groupBy("document_id").agg(F.sum(F.coalesce(F.size("pages"), F.lit(0)).cast("long")).alias("n_pages"), F.sum(F.coalesce("pages_processed", F.lit(0)).cast("long")).alias("pages_processed"), F.max(F.coalesce("doc_size_bytes", F.lit(0)).cast("long")).alias("doc_size_bytes"))


def _articles(payload: str | None, prefixes: tuple[str, ...]) -> dict[str, list]:
    """Articles of a payload by cid, or id without one: [in force, place, id, state, number, names].

    The node is the first one in force, else the last; nodes are met parents first and in the order of the text.
    """
    found: dict[str, list] = {}
    try:
        left = [json.loads(payload or "null")]
    except ValueError:
        return found
    place = 0
    while left:
        node = left.pop()
        if type(node) is dict:
            ident, chain = str(node.get("id") or ""), str(node.get("cid") or "")
            if ident.startswith(prefixes) or chain.startswith(prefixes):
                state, number = str(node.get("etat") or ""), node.get("num")
                in_force = state.upper() == "VIGUEUR"
                known = found.get(chain or ident)
                if known is None:
                    known = found[chain or ident] = [False, None, None, None, None, set()]
                if not known[0]:
                    known[:5] = in_force, place, ident, state, None if number is None else str(number)
                known[5].update((ident, chain))
                place += 1
            node = node.values()
        elif type(node) is not list:
            continue
        inner = [v for v in node if type(v) is dict or type(v) is list]
        inner.reverse()
        left += inner
    return found


def contents_articles(payloads: DataFrame, prefixes: tuple[str, ...] = ("LEGIARTI", "JORFARTI")) -> DataFrame:
    """payload_id, cid, state, number, version_id, aliases (sorted): one row for each article of a nested table of contents.

    payloads: payload_id, payload (JSON). Nodes of any depth are grouped by cid, or id without one; the first one in force is
    current, else the last. Malformed JSON has no article. A payload's nodes are grouped where it is read, those of several
    payloads of one id by Spark.
    """
    key = payloads.schema["payload_id"].dataType.simpleString()
    names = ["in_force", "place", "id", "state", "number", "names"]
    types = [pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cids, found = [], [], []
            for i, payload in enumerate(batch.column(1).to_pylist()):
                for cid, node in _articles(payload, prefixes).items():
                    rows.append(i)
                    cids.append(cid)
                    found.append(node)
            keys = batch.column(0).take(pa.array(rows, pa.int64()))
            columns = [pa.array([node[c] for node in found], kind) for c, kind in enumerate(types[:-1])]
            idents = pa.array([sorted(filter(None, node[5])) for node in found], types[-1])
            yield pa.RecordBatch.from_arrays([keys, pa.array(cids, pa.string()), *columns, idents], ["payload_id", "cid", *names])

    nodes = payloads.select("payload_id", "payload").mapInArrow(walk, f"payload_id {key}, cid string, in_force boolean, place long, id string, state string, number string, names array<string>")
    node = F.struct("place", "id", "state", "number")
    current = F.coalesce(F.min(F.when(F.col("in_force"), node)), F.max(node))
    found = nodes.groupBy("payload_id", "cid").agg(current.alias("now"), F.collect_set("names").alias("names"))
    aliases = F.when(F.size("names") == 1, F.get("names", F.lit(0))).otherwise(F.array_sort(F.array_distinct(F.flatten("names"))))
    return found.select("payload_id", "cid", F.col("now.state").alias("state"), F.col("now.number").alias("number"), F.when(F.col("now.id") != "", F.col("now.id")).otherwise(F.col("cid")).alias("version_id"), aliases.alias("aliases"))
