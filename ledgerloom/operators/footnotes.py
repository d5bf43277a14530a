"""Footnotes of pages: superscript markers in the text, definitions at the foot, and both in Markdown.

Characters are rows (doc, page, char_ord, text, size, top, x0, x1); ``char_ord`` is the place on the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..shipping import ship
from .series import fold_groups, mode_first

#: A superscript is smaller than this part of the body size; how far apart characters of a line,
#: of a run of digits and of a definition's line may be; where the foot of a page begins.
SUPER, SAME_LINE, NEXT_DIGIT, LINE, FOOT = 0.78, 3.0, 2.5, 2.5, 0.80
SENTINEL = "<!-- ========== FOOTNOTES ========== -->"
_CHAR = "struct<char_ord:bigint,text:string,size:double,top:double,x0:double,x1:double>"


def body_sizes(chars: DataFrame) -> DataFrame:
    """(doc, ``body``): the most frequent size, to halves, of each document; of equally frequent ones the first met."""
    rows = chars.where("size > 0").select("doc", (F.bround(F.col("size") * 2) / 2).alias("body"), (F.col("page") * 10_000_000 + F.col("char_ord")).alias("at"))
    return mode_first(rows, ["doc"], "body", "at").select("doc", "body")


def _with_cutoff(rows: DataFrame, chars: DataFrame) -> DataFrame:
    """``rows`` with the ``cutoff`` of their documents.

    Joins of characters are merged: those that were exploded from texts are estimated by the size of the texts'
    table, and so many times too many of them would be broadcast.
    """
    return rows.join(body_sizes(chars).select("doc", (F.col("body") * SUPER).alias("cutoff")).hint("merge"), "doc")


def _is_digit(c: Column) -> Column:
    return c.rlike(r"^(?U)\d$")


def digit_runs(chars: DataFrame) -> DataFrame:
    """Runs of superscript digits on one line: doc, page, ``char_ord`` of the first, ``marker``."""
    rows = _with_cutoff(chars, chars).where(_is_digit(F.col("text")) & (F.col("size") > 0) & (F.col("size") < F.col("cutoff")))
    item = F.struct(F.col("char_ord").cast("long").alias("char_ord"), "text", F.col("size").cast("double").alias("size"), *[F.col(c).cast("double").alias(c) for c in ("top", "x0", "x1")])
    pages = rows.groupBy("doc", "page").agg(F.array_sort(F.collect_list(item)).alias("items"))
    apart = lambda first, last, x: (
        (x["char_ord"] != last["char_ord"] + 1) | (F.abs(x["top"] - first["top"]) >= SAME_LINE) | (x["x0"] - last["x1"] >= NEXT_DIGIT)
    )
    groups = pages.select("doc", "page", F.inline(fold_groups(F.col("items"), _CHAR, apart)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item.char_ord", "item.text"))), lambda s: s["text"]), "")
    return groups.groupBy("doc", "page", "g").agg(F.min("item.char_ord").alias("char_ord"), text.alias("marker")).drop("g")


def body_markers(chars: DataFrame) -> DataFrame:
    """Markers in running text, in order: doc, ``marker``, ``page`` and ``char_ord`` where it is first.

    The character before, white space aside, is on the same line, of body size, a letter or closing punctuation, and
    does not make the digits part of a number or an exponent.
    """
    before = W.partitionBy("doc", "page").orderBy("char_ord").rowsBetween(W.unboundedPreceding, -1)
    full = ~F.col("text").rlike(r"^(?U)\s*$")
    rows = chars.withColumn("prev", F.last(F.when(full, F.struct("text", "size", "top")), ignorenulls=True).over(before))
    rows = rows.withColumn("before_prev", F.last(F.when(full, F.col("prev.text")), ignorenulls=True).over(before))
    # A run begins with a digit, so only digits go on to the joins.
    rows = _with_cutoff(rows.where(_is_digit(F.col("text"))), chars)
    rows = rows.join(digit_runs(chars).hint("merge"), ["doc", "page", "char_ord"])
    t = F.col("prev.text")
    exponent = t.isin("e", "E") & (F.col("before_prev").isNull() | F.col("before_prev").isin("(", ",", "×", "*"))
    decimal = (t == ".") & F.coalesce(_is_digit(F.col("before_prev")), F.lit(False))
    attached = t.rlike(r"^\p{L}$") | t.isin(*").,;:?!'\"")
    good = (F.abs(F.col("prev.top") - F.col("top")) < SAME_LINE) & (F.col("prev.size") >= F.col("cutoff")) & attached & ~exponent & ~decimal & ~_is_digit(t)
    first = rows.where(good).groupBy("doc", "marker").agg(F.min(F.struct("page", "char_ord")).alias("at"))
    return first.select("doc", "marker", "at.*")


def _definitions(chars: list[dict], cutoff: float) -> list[tuple[str, str]]:
    """(marker, text) of the notes among the characters at the foot of a page."""
    lines: list[list[dict]] = []
    for c in sorted(chars, key=lambda c: (c["top"], c["x0"])):
        if lines and abs(c["top"] - lines[-1][0]["top"]) < LINE:
            lines[-1].append(c)
        else:
            lines.append([c])
    small_digit = lambda c: c["text"].isdigit() and 0 < c["size"] < cutoff
    full = [next((k for k, c in enumerate(line) if not c["text"].isspace()), None) for line in lines]
    notes = []
    for at, (line, first) in enumerate(zip(lines, full)):
        if first is None or not small_digit(line[first]):
            continue
        end = first + 1
        while end < len(line) and small_digit(line[end]) and line[end]["x0"] - line[end - 1]["x1"] < NEXT_DIGIT:
            end += 1
        size = next((c["size"] for c in line[end:] if c["size"] > 0 and not c["text"].isspace()), None)
        if size is not None and size >= cutoff * 1.15:
            continue  # a line of the body with a marker in it
        stop = next((k for k in range(end, len(line)) if small_digit(line[k])), len(line))
        parts = ["".join(c["text"] for c in line[end:stop])]
        for more, start in zip(lines[at + 1 :], full[at + 1 :]):
            if start is None:
                continue
            text = "".join(c["text"] for c in more)
            if small_digit(more[start]) or size is not None and abs(more[start]["size"] - size) > 0.5 or text.strip().isdigit():
                break
            parts.append(text)
        text = re.sub(r"\s+\d{1,4}\s*$", "", " ".join(parts).strip())
        if text:
            notes.append(("".join(c["text"] for c in line[first:end]), text))
    return notes


def definitions(chars: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, ``marker``, ``definition``) of the notes in the lowest fifth of the pages (doc, page, height); the first of a marker counts.

    The characters at the foot of a page are one piece of work.
    """
    ship(chars.sparkSession)
    limits = _with_cutoff(pages.select("doc", "page", "height"), chars)
    foot = chars.join(limits.hint("merge"), ["doc", "page"]).where(F.col("top") > FOOT * F.col("height"))
    item = F.struct("text", *[F.col(c).cast("double").alias(c) for c in ("size", "top", "x0", "x1")])
    found = foot.groupBy("doc", "page").agg(F.collect_list(item).alias("chars"), F.first("cutoff").alias("cutoff"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, page, chars, cutoff in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(doc, page, k, m, t) for k, (m, t) in enumerate(_definitions(chars, cutoff))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc", "page", "k", "marker", "definition"])

    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()]
    found = found.select(F.col("doc").cast("string"), F.col("page").cast("long"), "chars", "cutoff").mapInArrow(run, "doc string, page long, k int, marker string, definition string")
    return found.groupBy("doc", "marker").agg(F.min_by("definition", F.struct("page", "k")).alias("definition"))


def resolved(markers: DataFrame, defined: DataFrame) -> DataFrame:
    """Markers that have a definition: doc, marker, definition, ``place`` from 1 in the order of the text."""
    both = markers.join(defined.hint("merge"), ["doc", "marker"])
    place = F.row_number().over(W.partitionBy("doc").orderBy("page", "char_ord"))
    return both.select("doc", "marker", "definition", place.alias("place"))


def _noted(text: str, notes: list[tuple[str, str]]) -> str:
    longest = sorted((m for m, _ in notes), key=len, reverse=True)
    marker = re.compile(r"(?<=[a-z)\].,])(" + "|".join(map(re.escape, longest)) + r")(?![0-9A-Za-z])")
    out, fenced = [], False
    for line in text.splitlines():
        fence = line.lstrip().startswith("```")
        fenced ^= fence
        plain = fence or fenced or line.startswith("    ") or line.lstrip().startswith("|")
        out.append(line if plain else marker.sub(r"[^\1]", line))
    block = [SENTINEL, "", *(f"[^{m}]: {re.sub('^' + re.escape(m) + r'[.\s]+', '', d).strip()}" for m, d in notes), ""]
    return "\n".join(out).rstrip() + "\n\n" + "\n".join(block)


def with_footnotes(docs: DataFrame, notes: DataFrame) -> DataFrame:
    """(doc, ``text``): ``word1`` becomes ``word[^1]`` outside code and tables, and the notes follow at the end.

    Documents without notes stay as they are. ``notes`` is what ``resolved`` gives.
    """
    ship(docs.sparkSession)
    listed = notes.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("place", "marker", "definition"))).alias("notes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, texts, found = (c.to_pylist() for c in batch.columns)
            texts = [_noted(t, [(n["marker"], n["definition"]) for n in own]) if own and t else t for t, own in zip(texts, found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc", "text"])

    return docs.join(listed, "doc", "left").select("doc", "text", "notes").mapInArrow(run, "doc string, text string")
