"""Files of a lake as tables: artefact sets, chunk files that must be valid, CSV of unknown dialect, XML articles, archives.

Paths are read by Spark's readers alone, so that any store it knows will do. A file is read by one task at least, never by the
driver, except for the first line of a CSV.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import values as V
from weftline.sources.markup import unescape


def _name() -> Column:
    return F.regexp_extract(F.input_file_name(), "([^/]+)$", 1)


def artefacts(spark: SparkSession, root: str, ids: DataFrame, schemas: dict[str, str], tolerate_missing: bool = False) -> dict[str, DataFrame]:
    """Tables of the kinds in ``schemas`` (kind: DDL) of the documents in ids (uid), from root/<uid>.<kind>.jsonl.

    Ids are compared in upper case. An id without a file of some kind is an error when that table is read, unless
    tolerate_missing is set.
    """
    wanted = ids.select(F.upper(F.trim("uid")).alias("uid")).distinct()
    out = {}
    for kind, schema in schemas.items():
        rows = spark.read.schema(schema).json(f"{root}/*.{kind}.jsonl").withColumn("uid", F.upper(F.regexp_replace(_name(), f"\\.{kind}\\.jsonl$", "")))
        if tolerate_missing:
            out[kind] = rows.join(wanted, "uid", "left_semi")
        else:
            found = wanted.join(rows.withColumn("__found", F.lit(True)), "uid", "left")
            checked = F.when(F.col("__found").isNull(), F.raise_error(F.concat(F.lit(f"no {kind} of "), "uid")).cast("boolean")).otherwise(F.col("__found"))
            out[kind] = found.withColumn("__found", checked).filter("__found").drop("__found")
    return out


def valid_chunks(lines: DataFrame) -> DataFrame:
    """file, n_chunks of rows (file, value: a line): 0 if any line that isn't blank is no UTF-8 or no JSON object with a field."""
    rows = lines.filter(F.coalesce(F.trim("value"), F.lit("")) != "")
    kind = F.schema_of_variant(F.try_parse_json(F.try_validate_utf8("value")))
    good = F.coalesce(kind.startswith("OBJECT<") & (kind != "OBJECT<>"), F.lit(False))
    g = rows.groupBy("file").agg(F.count("*").alias("n"), F.min(good).alias("ok"))
    return lines.select("file").distinct().join(g, "file", "left").select("file", F.when(F.col("ok"), F.col("n")).otherwise(0).cast("long").alias("n_chunks"))


def chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """valid_chunks of the files below path."""
    return valid_chunks(spark.read.text(path).select(_name().alias("file"), "value"))


def read_csv(spark: SparkSession, path: str, aliases: dict[str, list[str]]) -> DataFrame:
    """The columns of ``aliases`` (name: headers it may have, compared folded) of a CSV file with a header.

    The separator is that of comma, semicolon and tab which the header line has most often outside quotes; a byte order mark
    is left out; quoted fields may hold line breaks. A column that no header fits is an error.
    """
    first = spark.read.text(path).limit(1).collect()
    header = re.sub('"[^"]*"', "", (first[0][0] if first else "").lstrip("﻿"))
    sep = max(",;\t", key=header.count)
    rows = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)
    fold = lambda s: " ".join(re.findall("[a-z0-9]+", s.lstrip("﻿").translate(str.maketrans(T.ACCENTED, T.PLAIN)).lower()))
    have = {fold(c): c for c in rows.columns}
    found = {name: next((have[fold(a)] for a in names if fold(a) in have), None) for name, names in aliases.items()}
    missing = [name for name, c in found.items() if c is None]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)} in {rows.columns}")
    return rows.select(*[F.col(f"`{c}`").alias(name) for name, c in found.items()])


ARTICLE = """META struct<META_COMMUN:struct<ID:string>,META_SPEC:struct<META_ARTICLE:struct<CID:string,NUM:string,ETAT:string,DATE_DEBUT:string,DATE_FIN:string>>>,
CONTEXTE struct<TEXTE:struct<_nature:string,_ministere:string,TITRE_TXT:array<struct<_id_txt:string,_debut:string,_fin:string,_c_titre_court:string,_VALUE:string>>>>,
LIENS struct<LIEN:array<struct<_typelien:string,_id:string>>>"""


def article_records(payloads: DataFrame, root: str = "https://law.example") -> DataFrame:
    """A row of each XML article (payload_id, xml), from one parse to a struct; mixed content is read from the source.

    Ids of version and chronicle (the version's where there is none), number, state, dates, nature, body and note without markup,
    title and short_title (of the title valid at the article's start, then of a code's text, then the one that starts last), the
    headings above (subtitles, with the nearest one's id and text), ministry, address below root, and ids of links:
    modifications, concordances or citations by the name of their type. Payloads that are no XML have nulls.
    """
    inner = lambda outer: F.regexp_extract("xml", rf"(?s)<{outer}>.*?<CONTENU[^>]*>(.*?)</CONTENU>.*?</{outer}>", 1)
    plain = lambda c: F.trim(F.regexp_replace(unescape(F.regexp_replace(c, "<[^>]*>", " ")), "\\s+", " "))
    parsed = payloads.select("payload_id", "xml", F.from_xml("xml", ARTICLE, {"mode": "PERMISSIVE"}).alias("a"))
    meta, context = F.col("a.META.META_SPEC.META_ARTICLE"), F.col("a.CONTEXTE.TEXTE")
    heading = r"(?s)<TITRE_TM([^>]*)>(.*?)</TITRE_TM>"
    found = F.zip_with(F.regexp_extract_all("xml", F.lit(heading), F.lit(1)), F.regexp_extract_all("xml", F.lit(heading), F.lit(2)), lambda x, t: F.struct(F.regexp_extract(x, 'id="([^"]*)"', 1).alias("id"), plain(t).alias("t")))
    version = V.nullable(F.col("a.META.META_COMMUN.ID"))
    rows = parsed.select(
        "payload_id", version.alias("version_id"), F.coalesce(V.nullable(meta["CID"]), version).alias("cid"), F.coalesce(V.nullable(meta["NUM"]), version).alias("number"),
        F.coalesce(V.nullable(meta["ETAT"]), F.lit("VIGUEUR")).alias("state"), V.nullable(meta["DATE_DEBUT"]).alias("start"), V.nullable(meta["DATE_FIN"]).alias("end"), F.upper(V.nullable(context["_nature"])).alias("nature"),
        V.nullable(context["_ministere"]).alias("ministry"), plain(inner("BLOC_TEXTUEL")).alias("body"), F.nullif(plain(inner("NOTA")), F.lit("")).alias("note"), context["TITRE_TXT"].alias("titles"),
        F.coalesce("a.LIENS.LIEN", F.array().cast("array<struct<_typelien:string,_id:string>>")).alias("links"), F.filter(found, lambda h: h["t"] != "").alias("headings"),
    )
    begins = lambda t: F.coalesce(t["_debut"], F.lit(""))
    valid = lambda t: F.coalesce((begins(t) <= F.col("start")) & (F.col("start") <= F.coalesce(F.nullif(t["_fin"], F.lit("")), F.lit("9999-12-31"))), F.lit(False))
    best = F.array_max(F.transform("titles", lambda t, i: F.struct(valid(t).alias("v"), F.coalesce(t["_id_txt"].startswith("LEGITEXT"), F.lit(False)).alias("l"), begins(t).alias("a"), i.alias("i"), plain(t["_VALUE"]).alias("t"), V.nullable(t["_c_titre_court"]).alias("s"))))
    of = lambda test: F.transform(F.filter("links", test), lambda k: k["_id"])
    is_concord, is_change = (lambda k: F.upper(k["_typelien"]).contains("CONCORD")), (lambda k: F.upper(k["_typelien"]).contains("MODIF"))
    title, above = F.coalesce(best["t"], F.col("version_id")), F.get("headings", F.size("headings") - 1)
    return rows.select(
        "payload_id", "version_id", "cid", "number", "state", "start", "end", "nature", "body", title.alias("title"),
        of(is_concord).alias("concordances"), of(lambda k: is_change(k) & ~is_concord(k)).alias("modifications"), of(lambda k: ~is_change(k) & ~is_concord(k)).alias("citations"),
        F.coalesce(best["s"], title).alias("short_title"), F.nullif(F.array_join(F.transform("headings", lambda h: h["t"]), " > "), F.lit("")).alias("subtitles"), V.nullable(above["id"]).alias("section_id"), above["t"].alias("section_title"),
        "ministry", "note", V.article_url(F.col("version_id"), F.col("nature"), F.lit(root)).alias("url"),
    )


def articles(payloads: DataFrame) -> DataFrame:
    """What ``article_records`` has of each article's identity, validity, text, title and links."""
    return article_records(payloads).select("payload_id", "version_id", "cid", "number", "state", "start", "end", "nature", "body", "title", "concordances", "modifications", "citations")


def zip_members(spark: SparkSession, path: str, ids: DataFrame | None, pattern: str) -> DataFrame:
    """archive, member, uid (group 1 of ``pattern`` in the member's name), content of the members of the ZIP files at path, of
    the uids in ids (uid) if given. An archive is one task's, a member in memory at a time."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.namelist():
                        m = re.search(pattern, member)
                        if m:
                            yield pd.DataFrame([(name, member, m[1], archive.read(member))], columns=["archive", "member", "uid", "content"])

    rows = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("path"), "content")
    members = rows.mapInPandas(work, "archive string, member string, uid string, content binary")
    return members if ids is None else members.join(ids.select("uid").distinct(), "uid", "left_semi").select("archive", "member", "uid", "content")


def archives_to_read(names: DataFrame, pattern: str) -> DataFrame:
    """name, stamp, kind of an index of archives (name): the newest 'full' one and the 'delta' ones after it. pattern: two
    groups, the kind and the stamp."""
    rows = names.select("name", F.lower(F.regexp_extract("name", pattern, 1)).alias("kind"), F.regexp_extract("name", pattern, 2).alias("stamp")).filter("stamp <> ''")
    newest = rows.filter("kind = 'full'").agg(F.max("stamp").alias("newest"))
    return rows.join(F.broadcast(newest)).filter("(kind = 'full' and stamp = newest) or (kind = 'delta' and (newest is null or stamp > newest))").select("name", "kind", "stamp")


def situation(xml: Column, keep: str) -> Column:
    """xml with only one of its <Situation id="..."> branches: those of other ids are taken out, all else stays."""
    return F.regexp_replace(xml, f"(?s)<Situation id=\"(?!{re.escape(keep)}\")[^\"]*\".*?</Situation>", "")


def spans(events: DataFrame) -> DataFrame:
    """span_id, payload of trace events (turn_id, event_index, stage, status, start_ns, duration_ms): a span as JSON, its parent
    the turn's root span."""
    text = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(F.coalesce(v.cast("string"), F.lit("")).alias("stringValue")).alias("value"))
    trace = F.md5(F.col("turn_id").cast("string"))
    own = F.substring(F.md5(F.concat_ws("|", "turn_id", "event_index")), 1, 16)
    end = F.col("start_ns") + F.greatest(F.lit(0), F.col("duration_ms").cast("long")) * 1_000_000
    span = F.struct(
        trace.alias("traceId"), own.alias("spanId"), F.substring(F.md5(F.concat(F.col("turn_id").cast("string"), F.lit("|root"))), 1, 16).alias("parentSpanId"), F.concat(F.lit("rag."), F.coalesce("stage", F.lit("unknown"))).alias("name"), F.lit(1).alias("kind"),
        F.col("start_ns").cast("string").alias("startTimeUnixNano"), end.cast("string").alias("endTimeUnixNano"), F.array(text("rag.turn_id", F.col("turn_id")), text("rag.stage", F.col("stage"))).alias("attributes"),
        F.struct(F.when(F.coalesce("status", F.lit("ok")) == "ok", 1).otherwise(2).alias("code")).alias("status"),
    )
    return events.select(own.alias("span_id"), F.to_json(span).alias("payload"))
