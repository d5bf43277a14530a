"""Registries of document schemes and statement parsers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pdf import pdf_markdown
from ..operators.statements import card_transactions, deposit_rows, deposit_transactions
from ..sources.files import archives_markdown, extension, parse


@dataclass(frozen=True)
class Scheme:
    """A transform of files (filename, text or content) into one text per file."""

    name: str
    label: str
    accepts: tuple[str, ...]
    transform: Callable[..., DataFrame]
    raw_input: bool = False
    multi_file: bool = True
    outputs: tuple[str, ...] = ("consolidated", "individual")


@dataclass(frozen=True)
class Parser:
    """A statement layout: a test on the text, and a parser of its rows."""

    name: str
    label: str
    detect: Callable[[Column], Column]
    parse: Callable[..., DataFrame]


#: File types by extension, and what marks the statement layouts.
EXTENSIONS = (".pdf", ".mhtml", ".mht", ".html", ".htm", ".docx", ".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp", ".webp")
SCHEMES: dict[str, Scheme] = {}
PARSERS: dict[str, Parser] = {}


def register(item: Scheme | Parser) -> None:
    (SCHEMES if isinstance(item, Scheme) else PARSERS)[item.name] = item


def _raw(files: DataFrame) -> DataFrame:
    return parse(files).select("filename", "text", "error")


def _card(lines: DataFrame, words: DataFrame, pages: DataFrame, dates: DataFrame) -> DataFrame:
    return card_transactions(lines, dates)


def _deposit(lines: DataFrame, words: DataFrame, pages: DataFrame, dates: DataFrame) -> DataFrame:
    return deposit_transactions(deposit_rows(words, pages), dates.select("doc", "year"))


register(Scheme("raw", "Raw text", EXTENSIONS, _raw))
register(Scheme("mhtml2md", "Web page to Markdown", (".mhtml", ".mht"), archives_markdown, raw_input=True))
register(Scheme("pdf2md", "PDF to Markdown", (".pdf",), pdf_markdown, raw_input=True))
register(Parser("dbscc", "Card statement", lambda c: c.rlike(r"(?i)\bNEW TRANSACTIONS\b"), _card))
register(Parser("dbsdeposit", "Deposit statement", lambda c: c.rlike(r"(?i)DETAILS OF TRANSACTIONS\s+WITHDRAWAL\(\$\)\s+DEPOSIT\(\$\)"), _deposit))


def file_type(name: Column) -> Column:
    """A file's extension with its dot if it is a supported one, else null."""
    ext = F.concat(F.lit("."), extension(name))
    return F.when(ext.isin(*EXTENSIONS), ext)


def auto_detect(text: Column) -> Column:
    """Name of the first parser, by name, whose test holds; null if none does."""
    return F.coalesce(*[F.when(PARSERS[k].detect(text), F.lit(k)) for k in sorted(PARSERS)])


def listing(spark: SparkSession) -> DataFrame:
    rows = [("scheme", x.name, x.label, list(x.accepts)) for x in SCHEMES.values()]
    rows += [("parser", "auto", "Auto-detect", [])] + [("parser", x.name, x.label, []) for x in PARSERS.values()]
    return spark.createDataFrame(rows, "kind string, name string, label string, accepts array<string>")
