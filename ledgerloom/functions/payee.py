"""Vendor names from bank descriptions, and the similarity that matches them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip, title_case

#: Location and noise endings, removed one after the other.
ENDINGS = [
    r"\s+SINGAPORE\s+\S*$",
    r"\s+JOHOR\s+BAHRU\s+MYS$",
    r"\s+JOHOR\s+MYS$",
    r"\s+KUALA\s+LUMPUR\s+MYS.*$",
    r"\s+BATU\s+PAHAT\s+MYS.*$",
    r"\s+INTERNET\s+HKG$",
    r"\s+PETALING\s+JAYA\s+MYS$",
    r"\s+SAN\s+FRANCISCO\s+CA$",
    r"\s+NEW\s+YORK\s+NY$",
    r"\s+TORONTO\s+ON$",
    r"\s+FORT\s+COLLINS\s+CO$",
    r"\s+IRVINE\s+CA$",
    r"\s+HAMBURG\s+DEU$",
    r"\s+HONGKONG\s+HKG$",
    r"\s+MIAMI\s+FL$",
    r"\s+CAMBRIDGE\s+LND$",
    r"\s+TALLINN\s+DUB.*$",
    r"\s+LUGANO\s+DUB$",
    r"\s+SAN\s+JOSE\s+CA$",
    r"\s+MALAYSIAN\s+RINGGIT\s+[\d.]+$",
    r"\s+EUROPEAN\s+MONETARY.*$",
    r"\s+\d{3,}$",
]

#: Patterns of cleaned descriptions and their vendors, tried in order after the special forms.
VENDORS_BEFORE = [(r"^BUS/MRT", "TransitLink"), (r"^GRAB", "Grab"), (r"TADA\.G|^TADA", "TADA")]
VENDORS_AFTER = [
    (r"^AMZNPRIME", "Amazon Prime"),
    (r"^(AMZN|AMAZON)", "Amazon"),
    (r"SHOPEE", "Shopee"),
    (r"^(Lazada|LAZADA)", "Lazada"),
    (r"(?i)STARBUCKS", "Starbucks"),
    (r"(?i)^MCDONALD", "McDonald's"),
    (r"(?i)^BURGER KING", "Burger King"),
    (r"(?s)TNG.*EWALLET|EWALLET.*TNG", "TNG eWallet"),
]
VENDORS_LAST = [
    (r"^APPLE", "Apple"),
    (r"OPENAI|CHATGPT", "ChatGPT"),
    (r"^PRUDENTIAL", "Prudential"),
    (r"STARHUB", "StarHub"),
    (r"ANNUAL FEE", "Annual Fee"),
    (r"^ACRA", "ACRA"),
    (r"^AGODA", "Agoda"),
]
#: Where a vendor's name ends in any other description.
CUTS = [r"(?s) - .*$", r"\s*@\s*.*$", r"\s*_\S+$", r"\s*\*\s*.*$", r"\s+\(.*$"]


def clean_description(c: Column) -> Column:
    return strip(reduce(lambda s, p: F.regexp_replace(s, p, ""), ENDINGS, strip(c)))


def derive_payee(c: Column) -> Column:
    """Vendor name before aliases; the first rule that fits decides."""
    return let(clean_description(c), lambda d: _vendor(d, c))


def _vendor(d: Column, raw: Column) -> Column:
    """The vendor by a cleaned description; ``raw`` is the description as it came."""
    loan = r"^\d{2,3}(?:CARDS|MY PREFERRED|LAZADA)"
    named = r"^\d{2,3}(.+?)(\s*\(.*)?$"
    loan_name = strip(F.regexp_extract(d, named, 1))
    domain = F.regexp_replace(F.regexp_replace(F.regexp_extract(d, r"^WWW\.(\S+)", 1), r"\*+$", ""), r"\.+$", "")
    starred = F.when(d.contains("*"), strip(F.regexp_replace(d, r"(?s)^[^*]*\*", ""))).otherwise(F.lit(""))
    rest = strip(F.substr(d, F.lit(8)))
    plain = strip(reduce(lambda s, p: F.regexp_replace(s, p, ""), CUTS, d))
    out = (
        F.when(d.rlike(loan) & loan_name.contains("LAZADA"), F.lit("Lazada"))
        .when(d.rlike(loan) & loan_name.contains("CARDS IL"), F.lit("DBS Cards IL"))
        .when(d.rlike(loan) & loan_name.contains("MY PREFERRED"), F.lit("DBS Payment Plan"))
        .when(d.rlike(loan) & d.rlike(named), loan_name)
    )
    for pattern, name in VENDORS_BEFORE:
        out = out.when(d.rlike(pattern), F.lit(name))
    out = (
        out.when(d.startswith("TS/"), title_case(strip(F.regexp_replace(F.regexp_replace(F.substr(d, F.lit(4)), r"(?s) - .*$", ""), r"(?s) COMP.*$", ""))))
        .when(d.startswith("SP "), title_case(strip(F.substr(d, F.lit(4)))))
        .when(d.rlike(r"^PAYPAL ?\*"), title_case(F.regexp_replace(F.regexp_replace(d, r"^PAYPAL\s*\*\s*", ""), r"\s+\d{10,}.*$", "")))
        .when(d.startswith("MICROSOFT"), F.lit("Microsoft"))
        .when(d.startswith("WWW.") & F.upper(domain).contains("TADA"), F.lit("TADA"))
        .when(d.startswith("WWW.") & F.upper(domain).contains("COMMON") & (starred != ""), title_case(F.regexp_extract(starred, r"^(\S+)", 1)))
        .when(d.startswith("WWW.") & F.upper(domain).contains("COMMON"), title_case(domain))
    )
    for pattern, name in VENDORS_AFTER:
        out = out.when(d.rlike(pattern), F.lit(name))
    out = out.when(d.startswith("GOOGLE ") & (rest != ""), F.concat(F.lit("Google "), title_case(rest))).when(d.startswith("GOOGLE "), F.lit("Google"))
    for pattern, name in VENDORS_LAST:
        out = out.when(d.rlike(pattern), F.lit(name))
    return out.when(plain != "", title_case(plain)).otherwise(title_case(F.substring(raw, 1, 20)))


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the usual table as the bits of a number."""
    where: dict[str, int] = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """200 * common subsequence / (both lengths), 100 for two empty strings."""
    both = len(a) + len(b)
    return 200.0 * common_subsequence(a, b) / both if both else 100.0
