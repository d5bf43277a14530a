"""HTML pages: text, metadata, links and Markdown."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_lines, postprocess_markdown
from ..shipping import ship
from . import dom

#: End tags that break a line.
BREAKS = "p|div|tr|br|h[1-6]|li|td|th|dt|dd|blockquote"
#: Entities that pages use without a parser; others need ``texts``.
ENTITIES = [("&copy;?", "©"), ("&middot;?", "·"), ("&quot;?", '"'), ("&lt;?", "<"), ("&gt;?", ">"), ("&nbsp;?", " "), ("&amp;?", "&")]


def unescape(c: Column) -> Column:
    for pattern, to in ENTITIES:
        c = F.regexp_replace(c, pattern, to)
    return c


def html_text(c: Column) -> Column:
    """Text of flat pages with common entities, without leaving the JVM: scripts, styles, comments and tags go, some end
    tags break lines; ``texts`` takes any page."""
    for pattern, to in [
        (r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", ""),
        (r"(?s)<!--.*?-->", ""),
        (rf"(?i)</({BREAKS})\s*>", "\n"),
        (r"(?i)<br\s*/>", "\n"),
        (r"<[!/]?[A-Za-z][^>]*>", ""),
    ]:
        c = F.regexp_replace(c, pattern, to)
    return clean_lines(unescape(c))


def title(c: Column) -> Column:
    return unescape(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1))


def site_name(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")), r"^www\.", "")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = False

    def handle_starttag(self, tag, attrs):
        self.skip |= tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = False
        elif re.fullmatch(BREAKS, tag):
            self.out.append("\n")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def text_of(page: str) -> str:
    """Text of any page, all entities decoded; the general form of ``html_text``."""
    p = _Text()
    p.feed(page)
    lines = (x.strip() for x in "".join(p.out).split("\n"))
    return "\n".join(x for x in lines if x)


def _batched(pages: DataFrame, id_col: str, html_col: str, name: str, kind: str, of) -> DataFrame:
    """(id, ``name``) with ``of(page)`` for each page, null for a null page; whole pages travel in Arrow batches."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [of(x) if x is not None else None for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, arrow)], names=[id_col, name])

    arrow = {"string": pa.string(), "array<string>": pa.list_(pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string())}[kind]
    return pages.select(F.col(id_col).cast("long").alias(id_col), html_col).mapInArrow(run, f"`{id_col}` long, {name} {kind}")


def texts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, ``text``) of any page: ``text_of``."""
    return _batched(pages, id_col, html_col, "text", "string", text_of)


def markdown(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Markdown of each page: id, ``md``. The tree passes run in Arrow batches, the clean-up in the JVM."""
    out = _batched(pages, id_col, html_col, "raw", "string", dom.markdown_of)
    return out.select(id_col, postprocess_markdown(F.col("raw")).alias("md"))


def content_texts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, ``text``): the words of a page's content, without its frame and noise, in single blanks."""

    def of(page: str) -> str:
        root = dom.body_of(dom.parse(page))
        dom.strip_noise(root)
        return " ".join(root.text().split())

    return _batched(pages, id_col, html_col, "text", "string", of)


def metadata(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, ``meta``): a map of what the page's head says."""
    return _batched(pages, id_col, html_col, "meta", "map<string,string>", lambda page: list(dom.head_metadata(dom.parse(page), {}).items()))


def links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Links of a page: ``href``, and whether it leads anywhere."""
    found = _batched(pages, id_col, html_col, "hrefs", "array<string>", lambda page: [n.get("href").strip() for n in dom.parse(page).walk() if n.tag == "a"])
    rows = found.select(id_col, F.explode("hrefs").alias("href"))
    return rows.withColumn("kept", ~((F.col("href") == "") | F.col("href").startswith("#") | F.col("href").startswith("javascript:")))
