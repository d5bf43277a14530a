"""Inputs of the catalogue's queries, rendered from the fixture tables; each has a SQL twin."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bank descriptions by order key; {k} is the key, {seg} the customer's segment.
DESCRIPTIONS = [
    "GRAB*RIDE {k}",
    "TS/{seg} MART - LEVEL 2",
    "SP {seg} STORE",
    "PAYPAL *{seg} SHOP 12345678901",
    "{seg}'S 7-ELEVEN SINGAPORE SG",
    "STARBUCKS {seg} CA",
    "{seg} CAFE @ MALL",
    "AMZN {seg}",
    "GOOGLE {seg}",
    "{seg} TRADERS (BRANCH) 1234",
    "BUS/MRT {k}",
]


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers as statement rows; every order with an odd key occurs in two files."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus", "c_mktsegment")
    choice = F.pmod("o_orderkey", F.lit(len(DESCRIPTIONS)))
    text = F.get(F.array(*map(F.lit, DESCRIPTIONS)), choice.cast("int"))
    text = F.replace(F.replace(text, F.lit("{k}"), F.col("o_orderkey").cast("string")), F.lit("{seg}"), F.col("c_mktsegment"))
    base = rows.select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        text.alias("payee"),
        F.lit("").alias("memo"),
        F.bround("o_totalprice", 2).alias("amount"),
        (F.col("o_orderstatus") == "F").alias("credit"),
        F.explode(F.when(F.pmod("o_orderkey", F.lit(2)) == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("file_ord"),
        F.col("o_orderkey").alias("row_ord"),
    )
    return base.withColumn("source_file", F.concat(F.lit("file"), F.col("file_ord").cast("string"), F.lit(".pdf")))


_CASES = " ".join(
    f"when {k} then replace(replace('{d.replace(chr(39), chr(39) * 2)}', '{{k}}', o_orderkey::varchar), '{{seg}}', c_mktsegment)" for k, d in enumerate(DESCRIPTIONS)
)
TRANSACTIONS = f"""
txns as (
  select strftime(o_orderdate, '%Y-%m-%d') as date, case o_orderkey % {len(DESCRIPTIONS)} {_CASES} end as payee, '' as memo,
    round_even(o_totalprice, 2) as amount, o_orderstatus = 'F' as credit, f as file_ord, o_orderkey as row_ord, 'file' || f || '.pdf' as source_file
  from orders join customer on o_custkey = c_custkey, unnest(case when o_orderkey % 2 = 1 then [0, 1] else [0] end) as t(f)
)"""

#: Category dimension of the queries: payee, category, in dictionary order.
CATEGORIES = [
    ("Grab", "Transport"),
    ("Starbucks", "Food"),
    ("AMAZON", "Shopping"),
    ("Transitlink", "Transport"),
    ("transitlink", "Other Transport"),
    ("Building Stores", "Hardware"),
    ("Machinery Shops", "Hardware"),
    ("Household Cafe", "Food"),
    ("Automobile Stare", "Cars"),
    ("Furniture Trader", "Home"),
]
ALIASES = [("building mart", "Building Supplies"), ("google machinery", "Google Ads")]


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, c, k) for k, (p, c) in enumerate(CATEGORIES)], "payee string, category string, dict_ord int")


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALIASES, "alias string, payee string")


CATEGORY_VALUES = ", ".join(f"('{p}', '{c}', {k})" for k, (p, c) in enumerate(CATEGORIES))
ALIAS_VALUES = ", ".join(f"('{a}', '{p}')" for a, p in ALIASES)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as jobs: the type gives the status, the value the pages and seconds."""
    e = table(spark, sf_dir, "events")
    k = F.pmod("event_id", F.lit(4))
    return e.select(
        F.col("event_id").alias("job_id"),
        F.date_trunc("minute", "ts").alias("created_at"),
        F.when(k == 0, "queued").when(k == 1, "running").when(k == 2, "done").otherwise("failed").alias("status"),
        (F.pmod("event_id", F.lit(9))).cast("int").alias("page_count"),
        (F.pmod("user_id", F.lit(2)) == 0).alias("ocr_expected"),
        F.bround(F.abs("value") + 1, 2).alias("actual_sec"),
        F.when(k >= 2, F.col("ts")).alias("finished_at"),
    )


JOBS = """
jobs as (
  select event_id as job_id, date_trunc('minute', ts) as created_at,
    case event_id % 4 when 0 then 'queued' when 1 then 'running' when 2 then 'done' else 'failed' end as status,
    (event_id % 9)::int as page_count, user_id % 2 = 0 as ocr_expected, round_even(abs(value) + 1, 2) as actual_sec,
    case when event_id % 4 >= 2 then ts end as finished_at
  from events
)"""
NOW = "2024-01-30 00:00:00"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the pages of their sources."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as words on pages: quantity and discount give the place, the part the text."""
    # Dealt by document, as what is done with words is; an order is in one.
    li = table(spark, sf_dir, "lineitem").withColumn("doc", F.pmod("l_orderkey", F.lit(97)).cast("string")).repartition("doc")
    # Of the least row's columns only those that are used, and those that come before them.
    row = F.struct("l_partkey", "l_suppkey", "l_quantity", "l_discount")
    one = li.groupBy("doc", "l_orderkey", "l_linenumber").agg(F.min(row).alias("r"))
    x, y = F.col("r.l_quantity") * 10, F.bround(F.col("r.l_discount") * 1000)
    return one.select(
        "doc",
        F.lit(1).alias("page"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("word_ord"),
        x.alias("x0"),
        y.alias("top"),
        (x + 30).alias("x1"),
        (y + 8).alias("bottom"),
        F.col("r.l_partkey").cast("string").alias("text"),
    )


WORDS = """
words as (
  select (l_orderkey % 97)::varchar as doc, 1 as page, l_orderkey * 100 + l_linenumber as word_ord, r.l_quantity * 10 as x0,
    round_even(r.l_discount * 1000, 0) as top, r.l_quantity * 10 + 30 as x1, round_even(r.l_discount * 1000, 0) + 8 as bottom, r.l_partkey::varchar as text
  from (select l_orderkey, l_linenumber, min({'l_partkey': l_partkey, 'l_suppkey': l_suppkey, 'l_linenumber': l_linenumber, 'l_quantity': l_quantity,
    'l_discount': l_discount, 'l_shipdate': l_shipdate, 'l_extendedprice': l_extendedprice}) as r from lineitem group by 1, 2)
)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    x, y = F.col("p_size") * 8.0, F.pmod("p_partkey", F.lit(90)) * 1.0
    return p.select(F.pmod("p_partkey", F.lit(97)).cast("string").alias("doc"), F.lit(1).alias("page"), x.alias("bx0"), y.alias("by0"), (x + 60).alias("bx1"), (y + 20).alias("by1"))


BOXES = """
boxes as (
  select (p_partkey % 97)::varchar as doc, 1 as page, p_size * 8.0 as bx0, (p_partkey % 90) * 1.0 as by0, p_size * 8.0 + 60 as bx1, (p_partkey % 90) * 1.0 + 20 as by1
  from part
)"""


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as an MHTML file: filename, content."""
    head = "Subject: page\nContent-Type: multipart/related; boundary=\"b0\"\n\n--b0\nContent-Type: text/html\nContent-Transfer-Encoding: base64\n\n"
    body = F.concat(F.lit(head), F.base64(F.encode("html", "UTF-8")), F.lit("\n--b0--\n"))
    return table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".mhtml")).alias("filename"), F.encode(body, "UTF-8").alias("content"))


def _docx(batches):
    for batch in batches:
        made = []
        for key, name, brand in zip(*(batch.column(k).to_pylist() for k in range(3))):
            lines = "".join(f"<w:p><w:r><w:t>{escape(x or '')}</w:t></w:r></w:p>" for x in (name, "", brand))
            with zipfile.ZipFile(out := io.BytesIO(), "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{lines}</w:body></w:document>')
            made.append((f"{key}.docx", out.getvalue()))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in made], kind) for k, kind in enumerate((pa.string(), pa.binary()))], names=["filename", "content"])


def word_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name and brand as the paragraphs of a DOCX file: filename, content."""
    ship(spark)
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand").mapInArrow(_docx, "filename string, content binary")


def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as recognised rows of one to three cells, two words each, forty rows a page."""
    o = table(spark, sf_dir, "orders")
    k, y = F.col("o_orderkey"), F.pmod("o_orderkey", F.lit(40)) * 20.0
    n = 1 + F.pmod("o_custkey", F.lit(3))
    place = F.explode(F.sequence(F.lit(0), (2 * n - 1).cast("int"))).alias("w")
    rows = o.select(F.floor(k / 40).cast("string").alias("doc"), k.alias("k"), "o_custkey", y.alias("y0"), place)
    cell, second = F.floor(F.col("w") / 2), F.pmod("w", F.lit(2))
    x = cell * 200.0 + second * 35.0
    text = F.when(second == 0, F.concat(F.lit("c"), F.col("k").cast("string"))).otherwise(F.concat(F.lit("v"), F.col("o_custkey").cast("string")))
    return rows.select("doc", F.lit(1).alias("page"), (F.col("k") * 10 + F.col("w")).alias("word_ord"), text.alias("text"), x.alias("x0"), "y0", (x + 30).alias("x1"), (F.col("y0") + 10).alias("y1"))


DEPOSIT_WIDTH = 600.0
_DEPOSIT_HEADER = [("DATE", 20.0), ("DETAILS", 80.0), ("OF", 130.0), ("TRANSACTIONS", 150.0), ("WITHDRAWAL($)", 300.0), ("DEPOSIT($)", 380.0), ("BALANCE($)", 460.0)]


def deposit_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the words of deposit statements, thirty rows a page under a header."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    doc, top = F.floor(k / 30).cast("string"), 30.0 + F.pmod(k, F.lit(30)) * 12
    money = F.format_number("o_totalprice", 2)
    word = lambda text, x: F.struct(text.alias("text"), x.alias("x0"))
    words = F.array(
        word(F.date_format("o_orderdate", "dd"), F.lit(20.0)),
        word(F.upper(F.date_format("o_orderdate", "MMM")), F.lit(32.0)),
        word(F.col("o_orderpriority"), F.lit(80.0)),
        word(F.lit("REF"), F.lit(160.0)),
        word(F.when(F.pmod(k, F.lit(7)) == 0, F.lit("-")).otherwise(money), F.when(F.col("o_orderstatus") == "F", 378.5).otherwise(300.0)),
        word(F.lit("1.00"), F.lit(460.0)),
        word(F.lit("margin"), F.lit(5.0)),
    )
    rows = o.select(doc.alias("doc"), k.alias("k"), top.alias("top"), F.posexplode(words).alias("w", "s")).select("doc", (F.col("k") * 10 + F.col("w") + 100).alias("word_ord"), "s.text", "s.x0", "top")
    header = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(x).alias("x0"), F.lit(j).alias("word_ord")) for j, (t, x) in enumerate(_DEPOSIT_HEADER)])
    heads = o.select(doc.alias("doc")).distinct().select("doc", F.inline(header)).select("doc", F.col("word_ord").cast("long").alias("word_ord"), "text", "x0", F.lit(10.0).alias("top"))
    return rows.unionByName(heads).withColumn("page", F.lit(1))


def card_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the lines of card statements, twenty entries each, in four forms."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    day = F.concat(F.date_format("o_orderdate", "dd "), F.upper(F.date_format("o_orderdate", "MMM")))
    m, form = F.format_number("o_totalprice", 2), F.pmod(k, F.lit(4))
    line = lambda *parts: F.concat(*[p if isinstance(p, type(k)) else F.lit(p) for p in parts])
    lines = (
        F.when(form == 0, F.array(line(day, " SOME   CAFE ", m)))
        .when(form == 1, F.array(line(day, " REFUND ", m, " CR")))
        .when(form == 2, F.array(line(day, " SPLIT NAME"), F.lit("CONTINUED"), line("U. S. DOLLAR ", m), F.lit("13.45"), F.lit("2.00")))
        .otherwise(F.array(line(day, " SHOP"), F.lit("Hotline: 123"), F.lit(""), line(m, " cr")))
    )
    doc = F.floor(k / 20).cast("string")
    rows = o.select(doc.alias("doc"), (k * 10 + 100).alias("base"), F.posexplode(lines).alias("j", "line")).select("doc", (F.col("base") + F.col("j")).alias("line_ord"), "line")
    frame = F.array(F.struct(F.lit(0).cast("long").alias("line_ord"), F.lit("01 JAN BEFORE 9.99").alias("line")), F.struct(F.lit(1).cast("long").alias("line_ord"), F.lit("NEW TRANSACTIONS A. BODY").alias("line")))
    tail = F.array(F.struct(F.lit(10**15).alias("line_ord"), F.lit("SUB-TOTAL: 5.00").alias("line")), F.struct(F.lit(10**15 + 1).alias("line_ord"), F.lit("02 JAN AFTER 8.88").alias("line")))
    docs = o.select(doc.alias("doc")).distinct()
    return rows.union(docs.select("doc", F.inline(frame))).union(docs.select("doc", F.inline(tail)))


def footnote_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names in body size, each with its size as a superscript marker, fifty a page; a page's last tenth defines the markers."""
    p = table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    doc, page = F.floor(k / 100).cast("string"), (1 + F.floor(F.pmod(k, F.lit(100)) / 50)).cast("long")
    line = F.pmod(k, F.lit(50))
    chars = lambda s: F.filter(F.split(s, ""), lambda x: x != "")
    body = F.concat(F.transform(chars(F.col("p_name")), lambda c: F.struct(c.alias("text"), F.lit(10.0).alias("size"))), F.transform(chars(size), lambda c: F.struct(c.alias("text"), F.lit(6.0).alias("size"))), F.array(F.struct(F.lit(" ").alias("text"), F.lit(10.0).alias("size"))))
    rows = p.select(doc.alias("doc"), page.alias("page"), line.alias("line"), F.posexplode(body).alias("j", "c"))
    rows = rows.select("doc", "page", (F.col("line") * 1000 + F.col("j")).alias("char_ord"), "c.text", "c.size", (F.col("line") * 12.0).alias("top"), (F.col("j") * 5.0).alias("x0"))
    note = F.concat(F.transform(chars(size), lambda c: F.struct(c.alias("text"), F.lit(6.0).alias("size"))), F.transform(chars(F.concat(F.lit(" note "), F.col("p_brand"))), lambda c: F.struct(c.alias("text"), F.lit(8.0).alias("size"))))
    feet = p.where("p_partkey % 10 = 3").select(doc.alias("doc"), page.alias("page"), line.alias("line"), F.posexplode(note).alias("j", "c"))
    feet = feet.select("doc", "page", (100_000 + F.col("line") * 1000 + F.col("j")).alias("char_ord"), "c.text", "c.size", (850.0 + F.col("line") * 3).alias("top"), (F.col("j") * 5.0).alias("x0"))
    return rows.union(feet).withColumn("x1", F.col("x0") + 5)
