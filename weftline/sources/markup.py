"""Raw pages to text, metadata and links."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pages that a task turns into text before it passes them on.
PAGES = 128
BLOCKS = {"p", "div", "br", "li", "tr", "section", "article", "table", "ul", "ol"}
SKIP = {"script", "style", "nav", "footer", "noscript"}


class _Reader(HTMLParser):
    """Markdown of a page: headings, list items, table cells; scripts, styles, navigation and footers left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIP:
            self.skip += 1
        elif tag in BLOCKS:
            self.out.append("\n- " if tag == "li" else "\n")
        elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self.out.append("\n\n" + "#" * min(6, int(tag[1]) + 1) + " ")
        elif tag in ("td", "th"):
            self.out.append(" | ")

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in BLOCKS or (len(tag) == 2 and tag[0] == "h"):
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(data)


def to_markdown(html: str | None) -> str:
    reader = _Reader()
    reader.feed(html or "")
    lines = (" ".join(x.split()) for x in "".join(reader.out).split("\n"))
    out: list[str] = []
    for line in lines:
        if line or (out and out[-1]):
            out.append(line)
    return "\n".join(out).strip()


def page_text(pages: DataFrame) -> DataFrame:
    """page_id, markdown, n_chars."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                part = batch.slice(at, PAGES)
                text = [to_markdown(h.as_py()) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "markdown", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(work, "page_id long, markdown string, n_chars long")


def unescape(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def page_metadata(pages: DataFrame) -> DataFrame:
    """page_id, host, title, lang, n_paragraphs, n_links."""
    html = F.col("html")
    return pages.select("page_id", F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1)).alias("host"), F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(html, '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_count(html, F.lit("<p>")).cast("long").alias("n_paragraphs"), F.regexp_count(html, F.lit("<a href=")).cast("long").alias("n_links"))


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, position, href, anchor: links of a page, the first of each href."""
    href = F.regexp_extract_all("html", F.lit('<a href="([^"]*)">([^<]*)</a>'), F.lit(1))
    anchor = F.regexp_extract_all("html", F.lit('<a href="([^"]*)">([^<]*)</a>'), F.lit(2))
    rows = pages.select("page_id", F.posexplode(F.arrays_zip(href.alias("href"), anchor.alias("anchor"))).alias("position", "x"))
    return rows.groupBy("page_id", F.col("x.href").alias("href")).agg(F.min("position").alias("position"), F.min_by("x.anchor", "position").alias("anchor"))


def allowed_url(url: Column, hosts: list[str]) -> Column:
    """https, a listed host, no user, port, query or fragment."""
    host = F.regexp_extract(url, "^https://([^/?#@:]+)(?:/[^?#@]*)?$", 1)
    return (host != "") & host.isin(hosts)
