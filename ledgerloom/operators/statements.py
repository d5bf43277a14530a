"""Bank statements: from words, lines or tables of their pages to transactions, and the lookup tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.money import MONTHS, iso, money, month_number, statement_month, statement_year
from ..functions.text import squeeze
from .layout import edge_bucket
from .transactions import categorised, csv_columns, dedupe, fold_card_lines, ordered, parse_tables

_DAY = rf"(?i)^(\d{{2}})\s+({'|'.join(MONTHS)})\b"
#: What the header words of the five columns begin with, and the year of tables without a date.
HEADERS = ["DATE", "DETAILS", "WITHDRAWAL", "DEPOSIT", "BALANCE"]
DEFAULT_YEAR = 2025


def deposit_rows(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows of deposit statements that begin with a date: doc, page, line, and the five columns' texts.

    ``words`` is (doc, page, word_ord, text, x0, top), ``pages`` (doc, page, width). The first word that begins with
    WITHDRAWAL gives the header's height; the header words' left edges, which must all be there and not 0, the columns.
    """
    upper = F.upper("text")
    anchor = words.where(upper.startswith("WITHDRAWAL")).groupBy("doc", "page").agg(F.min_by("top", "word_ord").alias("header_y"))
    near = words.join(anchor, ["doc", "page"]).where(F.abs(F.col("top") - F.col("header_y")) < 3)
    first = [F.min_by("x0", F.when(upper.startswith(h), F.col("word_ord"))).alias(f"x{k}") for k, h in enumerate(HEADERS)]
    edges = near.groupBy("doc", "page").agg(*first).where(" and ".join(f"x{k} <> 0" for k in range(5)))
    edges = edges.join(pages.select("doc", "page", "width"), ["doc", "page"]).select("doc", "page", F.array(*[f"x{k}" for k in range(5)], "width").alias("edges"))
    placed = words.join(edges, ["doc", "page"]).withColumn("col", edge_bucket(F.col("x0"), F.col("edges"))).withColumn("line", F.bround(F.col("top") / 3).cast("long"))
    cell = lambda k: F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("col") == k, F.struct("x0", "word_ord", "text")))), lambda s: s["text"]), " "))
    rows = placed.groupBy("doc", "page", "line").agg(*[cell(k).alias(n) for k, n in enumerate(["date", "desc", "withdrawal", "deposit", "balance"])])
    return rows.where(F.col("date").rlike(_DAY))


def deposit_transactions(rows: DataFrame, years: DataFrame) -> DataFrame:
    """Transactions of ``deposit_rows`` with an amount, a deposit before a withdrawal; ``years`` is (doc, year), null: this year."""
    paid, got = money(F.col("withdrawal")), money(F.col("deposit"))
    out = rows.join(years, "doc", "left").where(paid.isNotNull() | got.isNotNull())
    day = iso(F.coalesce("year", F.lit(date.today().year)), month_number(F.regexp_extract("date", _DAY, 2)), F.regexp_extract("date", _DAY, 1))
    row_ord = F.row_number().over(W.partitionBy("doc").orderBy("page", "line"))
    return out.select("doc", row_ord.alias("row_ord"), day.alias("date"), F.trim("desc").alias("payee"), F.lit("").alias("memo"), F.coalesce(got, paid).alias("amount"), got.isNotNull().alias("credit"))


def statement_dates(texts: DataFrame) -> DataFrame:
    """(doc, ``year``, ``month``) by the text of the first page (doc, text); the month is January without a date."""
    return texts.select("doc", statement_year(F.col("text")).alias("year"), statement_month(F.col("text")).alias("month"))


def card_transactions(lines: DataFrame, dates: DataFrame) -> DataFrame:
    """Transactions of card statements (doc, line_ord, line); without a year of its own a statement counts as of this one."""
    rows = lines.join(dates, "doc", "left")
    out = fold_card_lines(rows, F.coalesce("year", F.lit(date.today().year)), F.coalesce("month", F.lit(1)))
    return out.select("doc", F.col("record").cast("int").alias("row_ord"), "date", "payee", "memo", "amount", "credit")


def table_transactions(tables: DataFrame, dates: DataFrame) -> DataFrame:
    """Transactions of generic tables (doc, page, table_ord, headers, rows)."""
    rows = tables.join(dates.select("doc", "year"), "doc", "left").withColumn("year", F.coalesce("year", F.lit(DEFAULT_YEAR)))
    out = parse_tables(rows.select("doc", "page", "table_ord", "year", "headers", "rows"), F.col("year"))
    place = F.row_number().over(W.partitionBy("doc").orderBy("page", "table_ord", "row_ord"))
    return out.select("doc", place.alias("row_ord"), "date", "payee", "memo", "amount", "credit")


def parse(template: str, texts: DataFrame, lines: DataFrame, words: DataFrame, pages: DataFrame, tables: DataFrame) -> DataFrame:
    """Transactions of statements by one parser, or by ``auto``: a document's generic tables, and where they give none
    the parser that its text (doc, text) fits."""
    from ..plans.registry import PARSERS, auto_detect

    dates = statement_dates(texts)
    if template != "auto":
        if template not in PARSERS:
            raise ValueError(f"Unknown template: {template}. Available: {['auto', *sorted(PARSERS)]}")
        return PARSERS[template].parse(lines, words, pages, dates)
    out = table_transactions(tables, dates)
    left = texts.join(out.select("doc").distinct(), "doc", "left_anti").select("doc", auto_detect(F.col("text")).alias("parser"))
    for name in sorted(PARSERS):
        own = left.where(F.col("parser") == name).select("doc")
        of = lambda df: df.join(own, "doc", "left_semi")  # noqa: B023, E731
        out = out.unionByName(PARSERS[name].parse(of(lines), of(words), of(pages), of(dates)))
    return out


def convert(txns: DataFrame, aliases: DataFrame, dim: DataFrame, single_amount: bool = True) -> DataFrame:
    """CSV columns of one statement's transactions, in their order, neither deduplicated nor sorted."""
    return csv_columns(categorised(txns, aliases, dim), single_amount)


def convert_bulk(txns: DataFrame, aliases: DataFrame, dim: DataFrame, single_amount: bool = True, deduplicate: bool = True, source_file: bool = True) -> DataFrame:
    """CSV columns of many statements' transactions: first arrivals only, sorted."""
    rows = dedupe(txns) if deduplicate else txns
    return csv_columns(ordered(categorised(rows, aliases, dim)), single_amount, source_file)


# Lookup tables ------------------------------------------------------------------------------

_LOOKUP = "payee_categories map<string,string>, payee_aliases map<string,string>"


def load_lookup(spark: SparkSession, path: str, seed: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Category rows (payee, category, dict_ord) and alias rows (alias, payee) of a lookup file.

    A missing file is first copied from ``seed``; a missing or broken one gives empty tables.
    """
    if not exists(spark, path) and seed and exists(spark, seed):
        spark.read.text(seed, wholetext=True).coalesce(1).write.mode("overwrite").text(path)
    if exists(spark, path):
        text = spark.read.text(path, wholetext=True).select(F.from_json("value", _LOOKUP).alias("v")).select("v.*")
    else:
        text = spark.createDataFrame([], _LOOKUP)
    entries = lambda c: F.posexplode(F.map_entries(F.coalesce(c, F.create_map().cast("map<string,string>"))))
    cats = text.select(entries(F.col("payee_categories")).alias("dict_ord", "e")).select(F.col("e.key").alias("payee"), F.col("e.value").alias("category"), "dict_ord")
    aliases = text.select(entries(F.col("payee_aliases")).alias("k", "e")).select(F.col("e.key").alias("alias"), F.col("e.value").alias("payee"))
    return cats, aliases


def lookup_json(cats: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row with the lookup file's text; a lookup table is small by its nature."""
    c = cats.agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("dict_ord", "payee", "category"))), lambda s: F.struct(s["payee"], s["category"]))).alias("payee_categories"))
    a = aliases.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("alias", "payee")))).alias("payee_aliases"))
    return c.crossJoin(a).select(F.to_json(F.struct("payee_categories", "payee_aliases")).alias("value"))  # one row each


def save_lookup(cats: DataFrame, aliases: DataFrame, path: str) -> dict[str, int]:
    """Overwrites a lookup file; returns how many payees and aliases it has."""
    lookup_json(cats, aliases).coalesce(1).write.mode("overwrite").text(path)
    return {"payees": cats.count(), "aliases": aliases.count()}


def exists(spark: SparkSession, path: str) -> bool:
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()).exists(place)


def clean_card_lines(texts: DataFrame) -> DataFrame:
    """(doc, line_ord, ``line``) of statement texts: white space in runs is one blank, blank lines go."""
    rows = texts.select("doc", F.posexplode(F.split("text", "\n")).alias("line_ord", "line"))
    return rows.withColumn("line", squeeze(F.col("line"))).where("line <> ''")


