"""PDF files to Markdown through providers: a model if one is registered, else the page engine on a reader's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import markdown_name, safe_stem
from ..sources import providers
from . import pages as P


def inputs(files: DataFrame) -> dict[str, DataFrame]:
    """Rows of the readers that the page engine needs, by kind, without error rows."""
    return {kind: providers.rows(files, kind).where("error is null").drop("error") for kind in ("pages", "words", "chars", "tables", "figures", "ocr")}


def pdf_pages(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Markdown (doc, ``text``) and page figures of PDF files (filename, content) that a reader can open."""
    found = inputs(files)
    sheets = found["pages"].select("doc", "page", "width", "height")
    stems = files.select(F.col("filename").alias("doc"), safe_stem(F.col("filename")).alias("stem"))
    return P.convert(sheets, found["words"], found["chars"], found["tables"], P.named_figures(found["figures"], sheets, stems), P.ocr_markdown(found["ocr"]))


def pdf_markdown(files: DataFrame) -> DataFrame:
    """(filename of the output, ``text``) of PDF files; one that no reader can open has a text that says so."""
    text, _ = pdf_pages(files)
    failed = providers.rows(files, "pages").where("error is not null").select("doc", "error")
    out = files.select(F.col("filename").alias("doc")).join(text, "doc", "left").join(failed, "doc", "left")
    said = F.coalesce(F.when(F.col("error").isNull(), F.col("text")), F.concat(F.lit("*Conversion failed: "), "error", F.lit("*\n")), F.lit(""))
    return out.select(markdown_name(F.col("doc"), "pdf2md").alias("filename"), said.alias("text"))
