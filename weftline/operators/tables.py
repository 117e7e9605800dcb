"""Tables and headings in converted pages, line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a boxed text begins with.
BOX = r"(?iu)^(encadré|attention|à noter|exemple|rappel)\s*:"


def cells(line: Column) -> Column:
    """The trimmed cells of a markdown table row."""
    return F.transform(F.split(F.regexp_replace(F.trim(line), "^\\||\\|$", ""), "\\|"), lambda c: F.trim(c))


def flattened(lines: DataFrame, least_rows: int = 2) -> DataFrame:
    """lines (doc_id, n, line) with their tables as text: below the head of a matrix (three columns and more, and ``least_rows``
    rows under it) each row says 'head: cell' of its cells, empty ones left out; other rows are their cells one after another.
    Rulers of dashes go."""
    is_row = F.col("line").rlike("^\\s*\\|.*\\|\\s*$")
    over = Window.partitionBy("doc_id").orderBy("n")
    rows = lines.withColumn("row", is_row).filter(~(F.col("row") & F.col("line").rlike("^[\\s|:\\-]+$")))
    rows = rows.withColumn("run", F.sum((~F.col("row")).cast("int")).over(over)).withColumn("cells", F.when(F.col("row"), cells(F.col("line"))))
    run = Window.partitionBy("doc_id", "run", "row")
    rows = rows.withColumn("k", F.row_number().over(run.orderBy("n"))).withColumn("of", F.count("*").over(run)).withColumn("head", F.first("cells").over(run.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    said = F.filter(F.zip_with("head", "cells", lambda h, c: F.when(F.coalesce(c, F.lit("")) != "", F.when(F.coalesce(h, F.lit("")) != "", F.concat(h, F.lit(": "), c)).otherwise(c))), lambda x: x.isNotNull())
    matrix = (F.size("head") >= 3) & (F.col("of") > least_rows)
    text = F.when(~F.col("row"), F.col("line")).when(matrix & (F.col("k") > 1), F.array_join(said, "; ")).otherwise(F.array_join(F.filter("cells", lambda c: c != ""), " "))
    return rows.select("doc_id", "n", text.alias("line"))


def refined(lines: DataFrame) -> DataFrame:
    """lines (doc_id, page, n, line) with better headings: one that reads like a sentence becomes text, a box a heading of its
    own; page numbers at the edges of pages go."""
    page = Window.partitionBy("doc_id", "page")
    edge = (F.col("n") == F.min("n").over(page)) | (F.col("n") == F.max("n").over(page))
    folio = F.col("line").rlike(r"^\s*(?:-\s*)?\d{1,4}(?:\s*/\s*\d{1,4})?(?:\s*-)?\s*$")
    title = F.regexp_extract("line", "^#{1,6}\\s+(.*)$", 1)
    sentence = title.rlike("[.;,]\\s*$") & (F.size(F.split(title, "\\s+")) >= 8)
    line = F.when((title != "") & sentence, title).when((title == "") & F.col("line").rlike(BOX), F.concat(F.lit("## "), F.trim("line"))).otherwise(F.col("line"))
    return lines.withColumn("__folio", edge & folio).filter("not __folio").withColumn("line", line).drop("__folio")
