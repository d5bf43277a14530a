"""Repeated lines, tables of contents, merges and page assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import is_bare_number, is_toc_row, let, normalise_line, strip


def lines_of(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per line: keys, ``line_ord``, ``line``."""
    return df.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_ord", "line"))


def band_lines(pages: DataFrame, band: int = 3, text: str = "text") -> DataFrame:
    """First and last non-blank lines of each page (doc, page): ``band`` (top, bottom), ``line``."""
    full = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"(?U)\S"))
    both = let(
        full,
        lambda a: F.array(
            F.struct(F.lit("top").alias("band"), F.slice(a, 1, band).alias("lines")),
            F.struct(F.lit("bottom").alias("band"), F.when(F.size(a) > band, F.slice(a, -band, band)).otherwise(a).alias("lines")),
        ),
    )
    return pages.select("doc", "page", F.inline(both)).select("doc", "page", "band", F.explode("lines").alias("line"))


def repeated_lines(pages: DataFrame, ratio: float = 0.6, least_pages: int = 5, band: int = 3) -> DataFrame:
    """Fingerprints (doc, norm, n) of headers and footers.

    A line counts once per page and band, so one in both counts twice; documents of fewer
    than ``least_pages`` pages have none, and lines of one character, a masked page number too, do not count.
    """
    seen = band_lines(pages, band).select("doc", "page", "band", normalise_line(F.col("line")).alias("norm")).where("length(norm) >= 2").distinct()
    n_pages = pages.groupBy("doc").agg(F.count_distinct("page").alias("n_pages")).where(F.col("n_pages") >= least_pages)
    counted = seen.groupBy("doc", "norm").agg(F.count("*").alias("n"))
    least = F.greatest(F.lit(2), F.floor(F.col("n_pages") * ratio))
    return counted.join(n_pages, "doc").where(F.col("n") >= least).select("doc", "norm", "n")


#: Fingerprints up to so many, counted first, are sent to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def strip_repeated(lines: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Lines (doc, ..., line) without headers, footers and bare page numbers."""
    rows = lines.where(~is_bare_number(F.col("line"))).withColumn("norm", normalise_line(F.col("line")))
    prints = fingerprints.select("doc", "norm").persist()  # counted, then used
    if prints.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        prints = F.broadcast(prints)
    return rows.join(prints, ["doc", "norm"], "left_anti").drop("norm")


def toc_sections(lines: DataFrame) -> DataFrame:
    """Markdown sections (doc, section) with figures and ``is_toc``.

    A section is a table of contents by its title, or if it has at least five rows, none of
    them a long sentence, and three fifths look like entries.
    """
    heading = F.col("line").rlike(r"^#{1,6}\s")
    rows = lines.withColumn("section", F.sum(heading.cast("int")).over(W.partitionBy("doc").orderBy("line_ord")))
    title = F.min(F.when(heading, F.lower(strip(F.regexp_replace("line", r"^#+", ""))))).alias("title")
    body = ~heading & (strip(F.col("line")) != "") & ~F.col("line").rlike(r"^\s*\|[\s:|-]+\|\s*$")
    out = rows.groupBy("doc", "section").agg(
        title,
        F.count_if(body).alias("n_rows"),
        F.count_if(body & is_toc_row(F.col("line"))).alias("n_toc"),
        F.coalesce(F.bool_or(body & ~strip(F.col("line")).startswith("|") & (F.length("line") > 200)), F.lit(False)).alias("long_row"),
    )
    shaped = (F.col("n_rows") >= 5) & ~F.col("long_row") & (10 * F.col("n_toc") >= 6 * F.col("n_rows"))
    return out.withColumn("is_toc", F.coalesce(F.col("title").isin("contents", "table of contents"), F.lit(False)) | shaped)


def merge_texts(df: DataFrame, keys: list[str], name: str, text: str, separator: str = "\n\n---\n\n") -> DataFrame:
    """Texts of a group under ``=== name ===`` titles, in order of name."""
    part = F.struct(F.col(name).alias("n"), F.concat(F.lit("=== "), F.col(name), F.lit(" ===\n\n"), F.col(text)).alias("t"))
    merged = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda s: s["t"]), separator)
    return df.groupBy(*keys).agg(merged.alias("merged"), F.count("*").alias("n_files"))


def last_upload_wins(files: DataFrame) -> DataFrame:
    """Of files with one name the last counts."""
    rest = [c for c in files.columns if c != "filename"]
    return files.groupBy("filename").agg(F.max_by(F.struct(*rest), "file_ord").alias("r")).select("filename", "r.*")


def fold_records(rows: DataFrame, keys: list[str], order: str, starts: Column, text: str, separator: str = "\n") -> DataFrame:
    """Records that begin at ``starts``: keys, ``record``, ``n``, ``joined``; rows before the first start go."""
    w = W.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("record", F.sum(starts.cast("int")).over(w)).where("record > 0")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("t")))), lambda s: s["t"]), separator)
    return marked.groupBy(*keys, "record").agg(F.count("*").alias("n"), joined.alias("joined"))


def page_confidence(pages: DataFrame, tables: DataFrame, figures: DataFrame) -> DataFrame:
    """Pages with their numbers of tables and figures, 0 where they have none."""
    t = tables.groupBy("doc", "page").agg(F.count("*").alias("table_count"))
    f = figures.groupBy("doc", "page").agg(F.count("*").alias("figure_count"))
    out = pages.join(t, ["doc", "page"], "left").join(f, ["doc", "page"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("table_count", "figure_count")})
