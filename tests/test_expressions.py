"""Expressions on values written by hand."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import money, payee, text
from ledgerloom.operators import series, transactions


def values(spark, xs, f, kind="string"):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], f"k int, x {kind}")
    return [r[0] for r in rows.orderBy("k").select(f(F.col("x"))).collect()]


def test_amounts(spark):
    xs = ["1,234.56", "(1,234.56)", "-5.00", "1234.56", "$12.00", "12.5", " ", None]
    assert values(spark, xs, money.parse_amount) == [1234.56, -1234.56, -5.0, 234.56, 12.0, None, None, None]


def test_dates(spark):
    xs = ["01 Sep", "05 Sep 2024", "31/12/2024", "12/31/2025", "1-2-49", "1-2-50", "2024-02-31", "Sep 01", "99 JAN", " ", "12 Mayor"]
    want = ["2025-09-01", "2025-09-05", "2024-12-31", None, "2049-02-01", "1950-02-01", "2024-02-31", "2025-09-01", "2025-01-99", None, "2025-05-12"]
    assert values(spark, xs, lambda c: money.parse_date(c, F.lit(2025))) == want


def test_payees(spark):
    cases = {
        "BUS/MRT 123": "TransitLink",
        "TS/ABC - MALL": "Abc",
        "SP SHOP": "Shop",
        "PAYPAL *NAME 12345678901": "Name",
        "GOOGLE X": "Google X",
        "CAFE'S 9-TEN SINGAPORE SG": "Cafe'S 9-Ten",
        "FOO @ BAR": "Foo",
        "WWW.FOO.COM": "Www.Foo.Com",
        "WWW.COMMON.COM*FIRST SECOND": "First",
        "008MY PREFERRED PAYMENT PLAN03 (01)": "DBS Payment Plan",
        "NETFLIX SINGAPORE SG 1234": "Netflix Singapore Sg",
        "": "",
    }
    assert values(spark, list(cases), payee.derive_payee) == list(cases.values())


def test_indel_ratio():
    got = [round(payee.indel_ratio(a, b), 4) for a, b in [("abcde", "abxde"), ("abcd", "abxd"), ("starbuck", "starbucks"), ("", "")]]
    assert got == [80.0, 75.0, 94.1176, 100.0]


@pytest.mark.parametrize(
    "headers, deposit", [(["Date", "Description", "Withdrawal", "Deposit"], 1), (["Date", "Details", "Withdrawal", "Deposit"], 3)]
)
def test_deposit_column_meets_description(spark, headers, deposit):
    row = spark.createDataFrame([(headers,)], "h array<string>").select(money.find_column(F.col("h"), "deposit")).first()
    assert row[0] == deposit


def test_upper_median_and_anchors(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 4.0)], "x double")
    assert df.select(series.upper_median(F.col("x"))).first()[0] == 3.0
    tiers = spark.createDataFrame([([20.0, 18.5, 17.0, 15.0],)], "v array<double>").select(series.anchored_tiers(F.col("v"), 2.0)).first()[0]
    assert tiers == [20.0, 17.0]
    groups = spark.createDataFrame([([0.0, 2.0, 4.0, 7.5],)], "v array<double>").select(series.anchored_groups(F.col("v"), 3.0)).first()[0]
    assert groups == [0, 0, 1, 2]


def test_toc_rows(spark):
    xs = ["Intro 3", "| A | 33A |", "|---|---|", "Chapter one ... iv.", "12", "ab 4", "No number"]
    assert values(spark, xs, text.is_toc_row) == [True, True, False, True, False, False, False]


def test_markdown_postprocess(spark):
    raw = "a\n# H\nb\n| x |\n\n| y |\nend  \n\n\n\nz"
    assert values(spark, [raw], text.postprocess_markdown) == ["a\n\n# H\n\nb\n\n| x |\n| y |\n\nend\n\nz"]


def test_card_lines(spark):
    lines = """header
NEW TRANSACTIONS
03 JAN SOME CAFE 12.30
04 JAN REFUND SHOP 5.00 CR
05 FEB SPLIT NAME
CONTINUED
U. S. DOLLAR 9.99
13.45
14.00
Hotline: x
SUB-TOTAL:
06 JAN AFTER 1.00""".split("\n")
    df = spark.createDataFrame([("d", k, x) for k, x in enumerate(lines)], "doc string, line_ord int, line string")
    got = transactions.fold_card_lines(df, F.lit(2025), F.lit(1)).orderBy("record").collect()
    assert [tuple(r)[2:] for r in got] == [
        ("2025-01-03", "SOME CAFE", "", 12.3, False),
        ("2025-01-04", "REFUND SHOP", "", 5.0, True),
        ("2024-02-05", "SPLIT NAME CONTINUED 14.00", "U. S. DOLLAR 9.99", 13.45, False),
    ]
