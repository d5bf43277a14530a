"""Amounts and dates of bank statements; dates stay strings and are never validated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

#: A money string, and the months' names.
MONEY = r"[0-9]{1,3}(?:,[0-9]{3})*\.\d{2}"
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
_MON = "|".join(MONTHS)


def _group(c: Column, pattern: str, k: int) -> Column:
    """A regex group, null without a match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, k))


def money(c: Column) -> Column:
    """First money string as a double; ungrouped thousands lose their head, as ``1234.56`` gives 234.56."""
    return F.regexp_replace(_group(c, f"({MONEY})", 1), ",", "").try_cast("double")


def parse_amount(c: Column) -> Column:
    """Signed amount: parentheses or a leading minus are negative; null if there is none."""
    return let(strip(c), _signed_amount)


def _signed_amount(s: Column) -> Column:
    wrapped = s.startswith("(") & s.endswith(")")
    inner = F.when(wrapped, F.regexp_replace(s, r"(?s)^\((.*)\)$", "$1")).otherwise(s)
    minus = inner.startswith("-")
    value = F.regexp_replace(_group(F.regexp_replace(inner, r"^-", ""), f"({MONEY})", 1), ",", "").try_cast("double")
    return F.when(wrapped | minus, -value).otherwise(value)


def month_number(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, MONTHS)), F.upper(F.substring(c, 1, 3))).cast("int")


def iso(year: Column, month: Column, day: Column) -> Column:
    return F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int"))


def parse_date(c: Column, year: Column) -> Column:
    """ISO string of the first layout that fits: D Mon, D/M/YYYY, D/M/YY, ISO, Mon D; else null.

    Layouts are prefixes. ``D Mon`` takes ``year`` whatever follows; a day is checked only in numeric layouts.
    """
    return let(strip(c), lambda s: _dated(s, year))


def _dated(s: Column, year: Column) -> Column:
    dm, long, short = rf"(?i)^(\d{{1,2}})\s+({_MON})", r"^(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})", r"^(\d{1,2})[/\-](\d{1,2})[/\-](\d{2})"
    md, isod = rf"(?i)^({_MON})\s+(\d{{1,2}})", r"^\d{4}-\d{2}-\d{2}"

    def numeric(pattern: str, full: bool) -> Column:
        d, m, y = (_group(s, pattern, k).cast("int") for k in (1, 2, 3))
        if not full:
            y = y + F.when(y < 50, 2000).otherwise(1900)
        return F.when(m.between(1, 12) & d.between(1, 31), iso(y, m, d))

    return F.coalesce(
        F.when(s.rlike(dm), iso(year, month_number(_group(s, dm, 2)), _group(s, dm, 1))),
        numeric(long, True),
        numeric(short, False),
        _group(s, f"({isod})", 1),
        F.when(s.rlike(md), iso(year, month_number(_group(s, md, 1)), _group(s, md, 2))),
    )


def infer_year(month: Column, statement_year: Column, statement_month: Column) -> Column:
    """Months after the statement's month belong to the year before."""
    return F.when(month > statement_month, statement_year - 1).otherwise(statement_year)


_AS_AT = r"As at \d{1,2}\s+(\w+)\s+(\d{4})"
_DATED = r"(\d{1,2})\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+(\d{4})"


def statement_year(c: Column) -> Column:
    return F.coalesce(_group(c, _AS_AT, 2), _group(c, _DATED, 3), _group(c, r"(\d{4})-\d{2}-\d{2}", 1)).cast("int")


def statement_month(c: Column) -> Column:
    """Month of the statement, 1 without a date."""
    found = F.coalesce(_group(c, _AS_AT, 1), _group(c, _DATED, 2))
    return F.coalesce(F.nullif(month_number(found), F.lit(0)), F.lit(1))


def signed(amount: Column, credit: Column) -> Column:
    """Two digits, debits negative."""
    return F.format_string("%.2f", F.when(credit, amount).otherwise(-amount))


#: What names a column of each role, in lower case.
COLUMN_PATTERNS = {
    "date": ["date", "trans.*date", "posting.*date", "value.*date"],
    "desc": ["desc", "detail", "particular", "narration", "transaction", "payee", "merchant", "reference"],
    "withdrawal": ["withdraw", "debit", "dr", "outflow", "payment", "charge", r"withdrawal\s*\(\$?\)"],
    "deposit": ["deposit", "credit", "cr", "inflow", r"deposit\s*\(\$?\)"],
    "amount": ["^amount$", "^sum$", "^total$"],
    "balance": ["balance", "bal"],
}


def find_column(headers: Column, role: str) -> Column:
    """Zero-based place of the first header of a role, or null."""
    pattern = "|".join(COLUMN_PATTERNS[role])
    at = F.array_position(F.transform(headers, lambda h: F.lower(strip(h)).rlike(pattern)), True)
    return F.nullif(at, F.lit(0).cast("long")).cast("int") - 1


def is_financial(headers: Column) -> Column:
    """At least two headers, a date, and one of withdrawal, deposit and amount."""
    some = find_column(headers, "withdrawal").isNotNull() | find_column(headers, "deposit").isNotNull() | find_column(headers, "amount").isNotNull()
    return (F.size(headers) >= 2) & find_column(headers, "date").isNotNull() & some
