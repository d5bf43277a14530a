"""Transactions: duplicates, order, categories, CSV columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.money import find_column, is_financial, parse_amount, parse_date
from ..functions.text import strip
from ..functions.payee import derive_payee, indel_ratio
from ..shipping import ship

KEY = ["date", "payee", "memo", "cents", "credit"]
ORDER = ["date", "payee", "memo", "amount", "credit", "file_ord", "row_ord"]
#: Least Indel ratio of a fuzzy category match, in percent.
FUZZY = 80


def dedupe(txns: DataFrame) -> DataFrame:
    """Keeps the first arrival of each (date, payee, memo, amount in cents, credit); the source file is no part of the key.

    A minimum over a struct has map-side partial aggregation, unlike a window.
    """
    rest = [c for c in txns.columns if c not in ("date", "payee", "memo", "credit")]
    first = F.min(F.struct("file_ord", "row_ord", *[c for c in rest if c not in ("file_ord", "row_ord")])).alias("first")
    cents = F.bround(F.col("amount") * 100).cast("long")
    out = txns.withColumn("cents", cents).groupBy(*KEY).agg(first)
    return out.select(*[F.col(c) if c in ("date", "payee", "memo", "credit") else F.col(f"first.{c}") for c in txns.columns])


def ordered(txns: DataFrame) -> DataFrame:
    """Sorted by date, payee, memo, amount, credit; arrival order settles ties."""
    return txns.orderBy(*ORDER)


def file_stats(txns: DataFrame) -> DataFrame:
    return txns.groupBy("source_file").agg(F.count("*").alias("n_transactions"))


def with_canonical(txns: DataFrame, aliases: DataFrame, description: str = "payee") -> DataFrame:
    """Adds ``vendor``: the derived payee, or what an alias of its lower-cased form names.

    Aliases are a lookup table, one row of each counts; a null description has a null vendor.
    """
    a = aliases.groupBy(F.col("alias").alias("_alias")).agg(F.min("payee").alias("_canonical"))
    out = txns.withColumn("vendor", derive_payee(F.col(description)))
    out = out.join(a, F.lower("vendor") == F.col("_alias"), "left")
    return out.withColumn("vendor", F.coalesce("_canonical", "vendor")).drop("_alias", "_canonical")


def categories(payees: DataFrame, dim: DataFrame, least: int = FUZZY) -> DataFrame:
    """(vendor, category, how) of each distinct vendor: exact, then any case, then fuzzy, else ``Other``.

    Of several matches, in one case or another, and of equal fuzzy scores, the first in dictionary
    order counts. Only vendors without a match are compared, with names of lengths within the bound
    that the score implies, so no pair that cannot reach it is formed. A null vendor is ``Other``.
    """
    ship(payees.sparkSession)
    names = payees.select("vendor").distinct()
    first = lambda key: dim.groupBy(key).agg(F.min_by("category", "dict_ord").alias("category"))
    exact = first(F.col("payee").alias("_payee")).withColumnRenamed("category", "_exact")
    folded = first(F.lower("payee").alias("_low")).withColumnRenamed("category", "_folded")
    found = names.join(exact, F.col("vendor") == F.col("_payee"), "left").join(folded, F.lower("vendor") == F.col("_low"), "left")
    left = found.where("_exact is null and _folded is null and vendor is not null").select("vendor", F.lower("vendor").alias("low"))
    # 200 * lcs >= least * (m + n) and lcs <= min(m, n): the longer is at most (200 - least) / least times the shorter.
    n = F.length("low")
    low, high = F.ceil(n * least / (200 - least)), F.floor(n * (200 - least) / least)
    reach = left.select("vendor", "low", F.explode(F.sequence(low, high)).alias("len"))
    other = dim.select(F.lower("payee").alias("name"), "category", "dict_ord", F.length("payee").cast("long").alias("len"))
    pairs = reach.join(other, "len").select("vendor", "low", "name", "category", "dict_ord")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [indel_ratio(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            rows = pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(4), pa.array(score, pa.float64())], names=["vendor", "category", "dict_ord", "score"])
            yield rows.filter(pa.array([x >= least for x in score], pa.bool_()))

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    pairs = pairs.mapInArrow(scored, f"vendor string, category {kinds['category']}, dict_ord {kinds['dict_ord']}, score double")
    fuzzy = pairs.groupBy(F.col("vendor").alias("_vendor")).agg(F.max_by("category", F.struct("score", -F.col("dict_ord"))).alias("_fuzzy"))
    found = found.join(fuzzy, F.col("vendor") == F.col("_vendor"), "left")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_folded").isNotNull(), "case").when(F.col("_fuzzy").isNotNull(), "fuzzy").otherwise("other")
    return found.select("vendor", F.coalesce("_exact", "_folded", "_fuzzy", F.lit("Other")).alias("category"), how.alias("how"))


def categorised(txns: DataFrame, aliases: DataFrame, dim: DataFrame) -> DataFrame:
    """``txns`` with ``vendor`` and ``category``; rows without a description stay."""
    named = with_canonical(txns, aliases)
    found = categories(named, dim).select(F.col("vendor").alias("_vendor"), "category")
    return named.join(found, F.col("vendor").eqNullSafe(F.col("_vendor"))).drop("_vendor")


def csv_columns(txns: DataFrame, single_amount: bool = True, source_file: bool = False) -> DataFrame:
    """The columns of the CSV sink, formatted; debits negative, or outflow and inflow apart."""
    money = lambda c: F.format_string("%.2f", c)
    columns: list[Column] = [
        F.col("date").alias("Date"),
        F.col("payee").alias("Description"),
        F.col("vendor").alias("Payee"),
        F.col("category").alias("Category"),
        F.col("memo").alias("Memo"),
    ]
    if source_file:
        columns.append(F.col("source_file").alias("SourceFile"))
    if single_amount:
        columns.append(money(F.when(F.col("credit"), F.col("amount")).otherwise(-F.col("amount"))).alias("Amount"))
    else:
        columns.append(F.when(F.col("credit"), F.lit("")).otherwise(money(F.col("amount"))).alias("Outflow"))
        columns.append(F.when(F.col("credit"), money(F.col("amount"))).otherwise(F.lit("")).alias("Inflow"))
    return txns.select(*columns)


def write_csv(txns: DataFrame, path: str, **options) -> None:
    """CSV with CRLF line ends and doubled quotes; rows keep their order, one file per sorted range."""
    csv_columns(ordered(txns), **options).write.mode("overwrite").csv(path, header=True, lineSep="\r\n", escape='"', emptyValue="")


def parse_tables(tables: DataFrame, year: Column) -> DataFrame:
    """Transactions of generic statement tables (columns ``headers``, ``rows``, others passed on).

    Rows without a date or an amount go; four layouts: withdrawal and deposit, amount, or either alone.
    """
    keep = [c for c in tables.columns if c not in ("headers", "rows")]
    found = tables.where(is_financial(F.col("headers")))
    roles = {r: find_column(F.col("headers"), r) for r in ("date", "desc", "withdrawal", "deposit", "amount")}
    places = [c.alias(f"at_{r}") for r, c in roles.items()]
    rows = found.select(*keep, F.inline(F.array(F.struct(*places))), F.col("rows").alias("_rows"))
    rows = rows.select(*keep, *[f"at_{r}" for r in roles], F.posexplode("_rows").alias("row_ord", "_cells"))
    # The cells of a row are cut out once, by a generator, which the optimiser does not merge with their uses.
    cells = F.struct(*[F.coalesce(F.get("_cells", F.col(f"at_{r}")), F.lit("")).alias(f"cell_{r}") for r in roles])
    rows = rows.select(*keep, *[f"at_{r}" for r in roles], "row_ord", F.inline(F.array(cells)))
    amounts = F.struct(*[parse_amount(F.col(f"cell_{r}")).alias(f"v_{r}") for r in ("withdrawal", "deposit", "amount")])
    rows = rows.select("*", F.inline(F.array(amounts)))
    w, d, a = (F.col(f"v_{r}") for r in ("withdrawal", "deposit", "amount"))
    cell = lambda r: F.col(f"cell_{r}")
    has = lambda r: F.col(f"at_{r}").isNotNull()
    out = (
        F.when(has("withdrawal") & has("deposit"), w)
        .when(has("amount"), F.when(a < 0, -a))
        .when(has("withdrawal"), w)
    )
    into = (
        F.when(has("withdrawal") & has("deposit"), d)
        .when(has("amount"), F.when(a >= 0, a))
        .when(~has("withdrawal") & has("deposit"), d)
    )
    rows = rows.select(*keep, "row_ord", parse_date(cell("date"), year).alias("date"), strip(cell("desc")).alias("payee"), F.lit("").alias("memo"), out.alias("w"), into.alias("d"))
    rows = rows.where(F.col("date").isNotNull() & (F.col("w").isNotNull() | F.col("d").isNotNull()))
    credit = F.coalesce(F.col("d") > 0, F.lit(False))
    amount = F.abs(F.when(credit, F.col("d")).otherwise(F.coalesce("w", F.lit(0.0))))
    return rows.select(*keep, "row_ord", "date", "payee", "memo", amount.alias("amount"), credit.alias("credit"))


def fold_card_lines(lines: DataFrame, statement_year: Column, statement_month: Column) -> DataFrame:
    """Card statement lines (doc, line_ord, line) -> transactions.

    A date line opens a record; foreign-currency lines become the memo, the first lone amount
    the amount if the date line had none, any other line goes on with the payee.
    """
    c = F.col
    amount = r"([0-9]{1,3}(?:,[0-9]{3})*\.\d{2})(?:\s*(CR))?$"
    date = r"(?i)^(\d{2}) (JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)\b"
    by = W.partitionBy("doc")
    rows = lines.withColumn("line", F.trim(F.regexp_replace("line", r"(?U)\s+", " "))).where("line <> ''")
    start = F.min(F.when(c("line").rlike(r"\bNEW TRANSACTIONS\b"), c("line_ord"))).over(by)
    balance = F.min(F.when(c("line").rlike(r"\bPREVIOUS BALANCE\b"), c("line_ord"))).over(by)
    rows = rows.withColumn("start", F.coalesce(start, balance))
    end = F.min(F.when((c("line_ord") > c("start")) & c("line").rlike(r"^(SUB-TOTAL:|TOTAL:|INSTALMENT PLANS SUMMARY)"), c("line_ord"))).over(by)
    rows = rows.withColumn("end", end).where((c("line_ord") > c("start")) & (c("end").isNull() | (c("line_ord") < c("end"))))
    is_date = c("line").rlike(date)
    rows = rows.withColumn("record", F.sum(is_date.cast("int")).over(by.orderBy("line_ord"))).where("record > 0")
    rest = F.trim(F.regexp_replace("line", date, ""))
    fx = c("line").rlike(r"(?i)(U\. S\. DOLLAR|MALAYSIAN RINGGIT)\s+[0-9]{1,3}(?:,[0-9]{3})*\.\d{2}")
    lone = c("line").rlike("(?i)^" + amount)
    skip = c("line").rlike(r"(?i)^(Credit Cards|DBS Cards|Hotline:|Statement of Account|PDS_|\d+ of \d+)")
    rows = rows.withColumn("kind", F.when(is_date, F.when(rest.rlike(amount), "dated").otherwise("open")).when(fx, "fx").when(lone, "amount").otherwise(F.when(skip, "skip").otherwise("text")))
    # Only the first amount of a record counts; a later one is text.
    nth = F.sum(c("kind").isin("dated", "amount").cast("int")).over(W.partitionBy("doc", "record").orderBy("line_ord"))
    rows = rows.withColumn("kind", F.when((c("kind") == "amount") & (nth > 1), F.when(skip, "skip").otherwise("text")).otherwise(c("kind")))
    piece = F.when(is_date, F.trim(F.regexp_replace(rest, amount, ""))).when(c("kind") == "text", c("line"))
    value = F.when(c("kind") == "dated", rest).when(c("kind") == "amount", F.upper("line"))
    rows = rows.select("doc", "record", "line_ord", "line", piece.alias("piece"), F.when(c("kind") == "fx", c("line")).alias("memo"), value.alias("value"), is_date.alias("is_date"), statement_year.alias("sy"), statement_month.alias("sm"))
    texts = lambda x, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(x).isNotNull() & (F.col(x) != ""), F.struct("line_ord", F.col(x).alias("x"))))), lambda s: s["x"]), sep)
    out = rows.groupBy("doc", "record").agg(
        F.min(F.when(c("is_date"), c("line"))).alias("dated"),
        texts("piece", " ").alias("payee"),
        texts("memo", "; ").alias("memo"),
        F.min("value").alias("value"),
        F.min("sy").alias("sy"),
        F.min("sm").alias("sm"),
    )
    from ..functions.money import infer_year, iso, month_number

    month = month_number(F.regexp_extract("dated", date, 2))
    return out.where("value is not null and payee <> ''").select(
        "doc",
        "record",
        iso(infer_year(month, c("sy"), c("sm")), month, F.regexp_extract("dated", date, 1)).alias("date"),
        F.trim(F.regexp_replace("payee", r"\s{2,}", " ")).alias("payee"),
        "memo",
        F.regexp_replace(F.regexp_extract("value", amount, 1), ",", "").cast("double").alias("amount"),
        (F.regexp_extract("value", amount, 2) != "").alias("credit"),
    )
