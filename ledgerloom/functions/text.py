"""String expressions; Python's ``str`` semantics where they differ from Spark's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = r"(?U)\s"


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` evaluated once, however often ``f`` names it; also keeps generated code small."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column) -> Column:
    """Removes Unicode white space from both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def join_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def clean_lines(c: Column) -> Column:
    """Lines stripped, empty ones dropped."""
    return join_lines(F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != ""))


def title_case(c: Column) -> Column:
    """Capitalises after every non-letter, unlike ``initcap``."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def squeeze(c: Column) -> Column:
    """White space runs become one blank; ends are stripped."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalise_line(c: Column) -> Column:
    """Fingerprint of a line: white space collapsed, short numbers masked, lower case."""
    return F.lower(F.regexp_replace(squeeze(c), r"(?U)\b\d{1,4}\b", "#"))


def normalise_text(c: Column) -> Column:
    """No-break blanks become blanks, zero-width characters go, white space but newlines collapses."""
    c = F.translate(c, "\u00a0\u200b\u200c\u200d\ufeff", " ")
    return F.regexp_replace(c, r"(?U)[^\S\n]+", " ")


def cleanup_markdown(c: Column) -> Column:
    c = F.regexp_replace(c, r"[ \t]+(\n|$)", "$1")
    return F.concat(strip(F.regexp_replace(c, r"\n{3,}", "\n\n")), F.lit("\n"))


def postprocess_markdown(c: Column) -> Column:
    """Blank lines around headings and tables, none within tables, no more than one elsewhere."""
    steps = [
        (r"\n{3,}", "\n\n"),
        (r"(?U)[^\S\n]+(?=\n|\z)", ""),
        (r"([^\n])\n(#{1,6}(?U:\s))", "$1\n\n$2"),
        (r"(#{1,6}(?U:\s)[^\n]+)\n([^\n#])", "$1\n\n$2"),
        (r"(\|[^\n]*)\n\n(\|)", "$1\n$2"),
        (r"(\|[^\n]*)\n\n(\|)", "$1\n$2"),
        (r"([^\n|])\n(\|)", "$1\n\n$2"),
        (r"(\|[^\n]*)\n([^\n|])", "$1\n\n$2"),
        (r"\n{3,}", "\n\n"),
    ]
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return strip(c)


def heading(level: Column, text: Column) -> Column:
    return F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(4), level)).cast("int")), F.lit(" "), strip(text))


def markdown_name(c: Column, scheme: str) -> Column:
    """Output name: ``.mhtm`` and ``.mhtml``, or ``.pdf``, become ``.md``; other names of PDF inputs get it appended."""
    if scheme == "mhtml2md":
        return F.regexp_replace(c, r"(?i)\.mhtml?$", ".md")
    return F.when(c.rlike(r"(?i)\.pdf$"), F.regexp_replace(c, r"(?i)\.pdf$", ".md")).otherwise(F.concat(c, F.lit(".md")))


def safe_stem(c: Column, length: int | None = 40) -> Column:
    """A file's name without its extension as part of another name: single characters replaced and cut to
    ``length``, or with no length, for PDF names, runs of characters replaced."""
    if length is None:
        s = F.regexp_replace(c, r"(?i)\.pdf$", "")
        return F.regexp_replace(F.when(s == "", F.lit("doc")).otherwise(s), r"[^A-Za-z0-9._-]+", "_")
    s = F.substring(F.regexp_replace(F.regexp_replace(c, r"(?<=.)\.[^.]*$", ""), r"[^A-Za-z0-9_\-]", "_"), 1, length)
    return F.when(s == "", F.lit("doc")).otherwise(s)


def url_core(c: Column) -> Column:
    """URL without query, fragment and closing slashes, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r"/+$", ""))


#: What a list item starts with.
LIST_MARKER = r"^\s*(?:[\u2022\u2023\u25E6\u2043\u2219\u25CF\u25CB\u2013\u2014-]|\d+[.)]\s{0}|[a-zA-Z][.)]\s{0}|[ivxIVX]+[.)]\s{0})\s*"


def is_list_item(c: Column) -> Column:
    """Starts with a bullet, a number, a letter or a Roman numeral as list marker."""
    return c.rlike("(?U)" + LIST_MARKER.format(""))


def drop_list_marker(c: Column) -> Column:
    return strip(F.regexp_replace(c, "(?U)" + LIST_MARKER.format("?"), ""))


def is_numbering(c: Column) -> Column:
    """A table cell of at most ten characters that only numbers its row."""
    return (F.length(c) <= 10) & c.rlike(r"^(\d+\.?\d*\.?|[a-zA-Z][.)]\s*|[ivxIVX]+[.)]\s*)$")


def font_size_px(style: Column) -> Column:
    """Font size of an inline style in pixels, null without one; points count 1.333, em and rem 16."""
    pattern = r"(?i)font-size\s*:\s*([\d.]+)\s*(px|pt|em|rem)"
    unit = F.lower(F.regexp_extract(style, pattern, 2))
    factor = F.when(unit == "pt", 1.333).when(unit.isin("em", "rem"), 16.0).otherwise(1.0)
    return F.when(style.rlike(pattern), F.regexp_extract(style, pattern, 1).try_cast("double") * factor)


def splitlines(c: Column) -> Column:
    """Lines as Python's ``splitlines`` has them: all line separators, and none after a last one."""
    parts = F.split(c, "\r\n|[\n\r\u000b\f\u001c-\u001e\u0085\u2028\u2029]")
    cut = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(cut)


def collapse_blank_lines(c: Column) -> Column:
    """Of consecutive blank lines one stays, empty."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"(?m)^[^\S\n]+$", ""), r"\n{3,}", "\n\n"))


_PAGE_CODE = r"^(?:\d{1,4}[A-Z]{0,2}|[ivxIVX]{1,6})$"


def is_toc_row(line: Column) -> Column:
    """A table-of-contents row: text, then a page number or Roman numeral at the end."""
    return let(strip(line), _is_toc_row)


def _is_toc_row(s: Column) -> Column:
    cells = F.filter(F.transform(F.split(F.regexp_replace(s, r"^\|+|\|+$", ""), r"\|"), strip), lambda x: x != "")
    piped = s.startswith("|") & (F.length(s) - F.length(F.replace(s, F.lit("|"))) >= 2)
    rule = F.forall(cells, lambda x: x.rlike(r"^[-: ]*$"))
    in_table = (F.size(cells) >= 2) & ~rule & F.coalesce(F.try_element_at(cells, F.lit(-1)), F.lit("")).rlike(_PAGE_CODE)
    plain = F.regexp_replace(s, r"\.+$", "")
    tail = F.regexp_extract(plain, r"(?Us)^(.*\S)\s+(\S+)\s*$", 2)
    head = F.regexp_extract(plain, r"(?Us)^(.*\S)\s+(\S+)\s*$", 1)
    return F.coalesce(F.when(s == "", False).when(piped, in_table).otherwise(tail.rlike(_PAGE_CODE) & (F.length(head) >= 3)), F.lit(False))


def is_bare_number(line: Column) -> Column:
    return line.rlike(r"(?U)^\s*\d{1,4}\s*$")


def table_markdown(headers: Column, rows: Column) -> Column:
    """Pipe table; rows padded or cut to the headers' width, ``Col{i}`` for missing headers; empty without both."""
    cell = lambda x: strip(F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))
    line = lambda a: F.concat(F.lit("| "), F.array_join(a, " | "), F.lit(" |"))
    first = F.coalesce(F.size(F.try_element_at(rows, F.lit(1))), F.lit(0))
    width = F.when(F.size(headers) > 0, F.size(headers)).otherwise(first)
    head = F.when(F.size(headers) > 0, headers).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(width, F.lit(1))), lambda i: F.concat(F.lit("Col"), i.cast("string"))))
    body = F.transform(rows, lambda r: line(F.transform(F.sequence(F.lit(1), F.greatest(width, F.lit(1))), lambda i: cell(F.try_element_at(r, i)))))
    text = F.concat(F.array(line(F.transform(head, cell)), line(F.array_repeat(F.lit("---"), width))), body)
    return F.when((F.size(headers) == 0) & (F.size(rows) == 0), F.lit("")).otherwise(F.array_join(text, "\n"))


#: Front-matter keys in their order.
FRONT_KEYS = ["title", "source", "site_name", "saved", "published", "description", "author"]


def front_matter(meta: Column) -> Column:
    """YAML front matter of a string map: known keys first, values with special characters quoted."""
    special = r"[:#{}\[\]|>&*!]"
    quoted = lambda v: F.concat(F.lit('"'), v, F.lit('"'))
    known = [
        F.when(
            F.map_contains_key(meta, k),
            F.concat(F.lit(f"{k}: "), F.when(F.element_at(meta, k).rlike(special + r"|^[\"']"), quoted(F.element_at(meta, k))).otherwise(F.element_at(meta, k))),
        )
        for k in FRONT_KEYS
    ]
    rest = F.transform(
        F.filter(F.map_entries(meta), lambda e: ~e["key"].isin(FRONT_KEYS)),
        lambda e: F.concat(e["key"], F.lit(": "), F.when(e["value"].rlike(special), quoted(e["value"])).otherwise(e["value"])),
    )
    lines = F.concat(F.array(F.lit("---")), F.filter(F.array(*known), lambda x: x.isNotNull()), rest, F.array(F.lit("---")))
    return F.when(F.size(F.map_keys(meta)) > 0, join_lines(lines)).otherwise(F.lit(""))
