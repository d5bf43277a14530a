"""Words, characters and boxes on pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .series import upper_median


def words_outside(words: DataFrame, boxes: DataFrame, slack: float = 5.0) -> DataFrame:
    """Words not fully inside any box of their page.

    Words at one place have one answer, so places are looked up, in cells that are at least as large as the box: a
    page's boxes have cells of a power of two as sides, and a box lies in few of them. What has no such cells (ends
    before it begins, isn't finite) is compared with all of its page; ``_w`` is 0 for every box, there for such
    places, and -1 for such boxes. Keys are compared as structs, which are never null: else Spark would filter the
    words that are looked up, and only those, by them, and make them a second time.
    """
    at = ["doc", "page", "x0", "x1", "top", "bottom"]
    ends = [F.col("bx0") - slack, F.col("bx1") + slack, F.col("by0") - slack, F.col("by1") + slack]
    b = boxes.where("doc is not null and page is not null").select(F.struct("doc", "page").alias("_own"), *[c.alias(n) for c, n in zip(ends, ("_x0", "_x1", "_y0", "_y1"))])
    b = b.groupBy("_own", "_x0", "_y0", "_y1").agg(F.max("_x1").alias("_x1")).where("_x0 + _x1 + _y0 + _y1 is not null")
    inf = F.lit(float("inf"))
    side = lambda a, b: F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col(b) - F.col(a), F.lit(1.0)))))
    limited = lambda *names: reduce(lambda a, b: a & b, [(F.col(c) > -inf) & (F.col(c) < inf) for c in names])
    forward = (F.col("_x0") <= F.col("_x1")) & (F.col("_y0") <= F.col("_y1"))
    celled = forward & limited("_x0", "_x1", "_y0", "_y1") & (F.col("_x1") - F.col("_x0") < 1e12) & (F.col("_y1") - F.col("_y0") < 1e12)
    cell = lambda x, n: F.floor(F.col(x) / F.col(n))
    key = ["_w", "_h", "_c", "_r"]
    celled_boxes = b.where(celled).withColumns({"_w": side("_x0", "_x1"), "_h": side("_y0", "_y1")})
    celled_boxes = celled_boxes.withColumn("_c", F.explode(F.sequence(cell("_x0", "_w"), cell("_x1", "_w")))).withColumn("_r", F.explode(F.sequence(cell("_y0", "_h"), cell("_y1", "_h"))))
    rest = F.when(celled, F.array(F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(-1.0)))
    whole = b.withColumn("_w", F.explode(rest)).withColumns({"_h": F.lit(0.0), "_c": F.lit(0).cast("long"), "_r": F.lit(0).cast("long")})
    found = celled_boxes.unionByName(whole)
    sides = found.groupBy("_own").agg(F.collect_set(F.struct("_w", "_h")).alias("sides"))
    odd = ~((F.col("x0") <= F.col("x1")) & (F.col("top") <= F.col("bottom")) & limited("x0", "x1", "top", "bottom"))
    places = words.select(*at).distinct().where(" and ".join(f"{c} is not null" for c in at[2:]))
    places = places.join(sides, F.struct("doc", "page") == F.col("_own")).select(*at, F.inline("sides")).where(odd == (F.col("_w") == 0))
    places = places.withColumns({"_c": F.when(F.col("_w") > 0, cell("x0", "_w")).otherwise(0), "_r": F.when(F.col("_w") > 0, cell("top", "_h")).otherwise(0)})
    p, f = places.alias("p"), found.alias("f")
    same = reduce(lambda a, b: a & b, [F.col(f"p.{k}") == F.col(f"f.{k}") for k in key], F.struct("doc", "page") == F.col("_own"))
    inside = (F.col("x0") >= F.col("_x0")) & (F.col("x1") <= F.col("_x1")) & (F.col("top") >= F.col("_y0")) & (F.col("bottom") <= F.col("_y1"))
    # Merged, as boxes are far more than the estimate for their table once they are in cells.
    covered = p.join(f.hint("merge"), same & inside, "left_semi").select(F.struct(*at).alias("_place")).distinct()
    return words.join(covered, F.struct(*at) == F.col("_place"), "left_anti")


def bucket_lines(words: DataFrame, height: float = 3.0) -> DataFrame:
    """Words of a page joined into lines by ``round(top / height)``, half to even."""
    line = F.bround(F.col("top") / height).cast("long")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_ord", "text"))), lambda s: s["text"]), " ")
    return words.groupBy("doc", "page", line.alias("line")).agg(text.alias("text"), F.count("*").alias("n_words"))


def edge_bucket(x: Column, edges: Column, slack: float = 2.0) -> Column:
    """Number of the column between two ``edges`` that ``x`` lies in, an edge counting ``slack`` further left.

    Null left of the first edge and right of the last, which closes the last column.
    """
    at = F.size(F.filter(edges, lambda e: e <= x + slack)) - 1
    return F.when((at >= 0) & (at < F.size(edges) - 1), at)


def cell_gap(words: DataFrame) -> DataFrame:
    """(doc, page, ``least``): beyond it a gap between words of a row separates cells.

    One figure for a page: four times its upper median of the gaps that are positive and below twice the mean height
    of words (half that height without any), and that height at least.
    """
    w = W.partitionBy("doc", "page", "line").orderBy("x0", "word_ord")
    height = words.groupBy("doc", "page").agg(F.avg(F.col("y1") - F.col("y0")).alias("height"))
    gaps = words.withColumn("gap", F.col("x0") - F.lag("x1").over(w)).where("gap > 0").join(height, ["doc", "page"])
    typical = gaps.where(F.col("gap") < 2 * F.col("height")).groupBy("doc", "page").agg(upper_median(F.col("gap")).alias("typical"))
    out = height.join(typical, ["doc", "page"], "left")
    typical = F.coalesce("typical", 0.5 * F.col("height"))
    return out.select("doc", "page", F.greatest(4.0 * typical, F.col("height")).alias("least"))


def split_cells(words: DataFrame) -> DataFrame:
    """Words (doc, page, line, word_ord, x0, y0, x1, y1, text) of rows joined into cells: doc, page, line, ``cell`` from 0, ``text``."""
    w = W.partitionBy("doc", "page", "line").orderBy("x0", "word_ord")
    rows = words.join(cell_gap(words), ["doc", "page"]).withColumn("gap", F.col("x0") - F.lag("x1").over(w))
    rows = rows.withColumn("cell", F.sum(F.coalesce(F.col("gap") > F.col("least"), F.lit(False)).cast("int")).over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_ord", "text"))), lambda s: s["text"]), " ")
    return rows.groupBy("doc", "page", "line", "cell").agg(text.alias("text"))


def row_runs(rows: DataFrame) -> DataFrame:
    """Consecutive rows of one number of cells above one: doc, ``first``, ``n``, ``n_cells``, ``kind``."""
    w = W.partitionBy("doc").orderBy("line")
    marked = rows.withColumn("_new", F.coalesce(F.lag("n_cells").over(w) != F.col("n_cells"), F.lit(True)))
    marked = marked.withColumn("run", F.sum(F.col("_new").cast("int")).over(w)).where("n_cells > 1")
    out = marked.groupBy("doc", "run").agg(F.min("line").alias("first"), F.count("*").alias("n"), F.min("n_cells").alias("n_cells"))
    return out.withColumn("kind", F.when(F.col("n") >= 2, "table").otherwise("header")).drop("run")


def merge_paragraphs(lines: DataFrame, factor: float = 1.8, least: float = 12.0, keys: tuple[str, ...] = ("doc", "col")) -> DataFrame:
    """Lines of a column joined while the step down is at most ``max(factor * line_gap, least)``; headings stand alone."""
    w = W.partitionBy(*keys).orderBy("top", "line_ord")
    step = F.col("top") - F.lag("top").over(w)
    close = step <= F.greatest(factor * F.col("line_gap"), F.lit(least))
    new = ~F.coalesce(close, F.lit(False)) | F.col("is_heading") | F.coalesce(F.lag("is_heading").over(w), F.lit(False))
    rows = lines.withColumn("para", F.sum(new.cast("int")).over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "line_ord", "text"))), lambda s: s["text"]), " ")
    return rows.groupBy(*keys, "para").agg(text.alias("text"), F.count("*").alias("n_lines"), F.max("top").alias("last_y"))


def detect_columns(words: DataFrame, least_words: int = 40, least: float = 0.55) -> DataFrame:
    """One or two columns per page by the largest relative gap of word centres in the middle of the page.

    ``words`` has doc, page, cx, width. Result: doc, page, ``layout``, ``confidence``, ``split_x``. A gap's score is
    r / (r + 8), r its ratio to the upper median of all gaps, zeros included (1 if that is 0). Pages of
    fewer than ``least_words`` words are single with confidence 1; other single pages have 1 less the best score.
    """
    w = W.partitionBy("doc", "page").orderBy("cx")
    rows = words.withColumn("prev", F.lag("cx").over(w)).withColumn("gap", F.col("cx") - F.col("prev"))
    pages = rows.groupBy("doc", "page").agg(F.count("*").alias("n_words"), upper_median(F.col("gap")).alias("typical"))
    middle = (F.col("cx") + F.col("prev")) / 2
    inner = rows.where(middle.between(0.2 * F.col("width"), 0.8 * F.col("width")) & (F.col("gap") > 0))
    best = inner.groupBy("doc", "page").agg(F.max("gap").alias("gap"), F.max_by(middle, F.struct("gap", -F.col("cx"))).alias("at"))
    out = pages.join(best, ["doc", "page"], "left")
    r = F.col("gap") / F.when(F.col("typical") == 0, 1.0).otherwise(F.col("typical"))
    out = out.withColumn("score", F.coalesce(r / (r + 8), F.lit(0.0)))
    enough = F.col("n_words") >= least_words
    two = enough & (F.col("score") >= least)
    confidence = F.when(two, F.col("score")).when(enough, 1 - F.col("score")).otherwise(1.0)
    return out.select("doc", "page", F.when(two, "two").otherwise("single").alias("layout"), F.bround(confidence, 3).alias("confidence"), F.when(two, F.col("at")).alias("split_x"))


def nearest_char(words: DataFrame, chars: DataFrame, reach: int = 5) -> DataFrame:
    """Font size and name of a character of each word's page that stands where the word begins: doc, page, word_ord, ``size``, ``fontname``.

    Places are tenths of a point. A character may stand up to ``reach`` above or below and from ``reach`` left
    to 19 right; the highest counts, then the leftmost, and of characters at one place the last.
    """
    grid = lambda x: F.bround(F.col(x) * 10).cast("long")
    # Of the characters at one place the last counts, and what stands near a place holds for all words that begin there.
    c = chars.select(F.col("doc").alias("_d"), F.col("page").alias("_p"), grid("top").alias("cy"), grid("x0").alias("cx"), F.struct((-F.col("char_ord")).alias("ord"), "size", "fontname").alias("c"))
    c = c.groupBy("_d", "_p", "cy", "cx").agg(F.min("c").alias("c"))
    # Cells as large as what a place reaches: it lies in two columns and two rows of cells.
    high, wide = 2 * reach, reach + 19
    c = c.withColumns({"_row": F.floor(F.col("cy") / high), "_col": F.floor(F.col("cx") / wide)})
    w = words.select("doc", "page", "word_ord", grid("top").alias("wy"), grid("x0").alias("wx"))
    at = ["doc", "page", "wy", "wx"]
    first = [F.floor((F.col(x) - reach) / n) for x, n in (("wy", high), ("wx", wide))]
    cells = F.array(*[F.struct((first[0] + j).alias("r"), (first[1] + k).alias("c")) for j in (0, 1) for k in (0, 1)])
    places = w.select(*at).distinct().withColumn("_at", F.explode(cells))
    same_cell = (F.col("doc") == F.col("_d")) & (F.col("page") == F.col("_p")) & (F.col("_at.r") == F.col("_row")) & (F.col("_at.c") == F.col("_col"))
    near = same_cell & (F.abs(F.col("cy") - F.col("wy")) <= reach) & (F.col("cx") - F.col("wx")).between(-reach, 19)
    order = F.struct((F.col("cy") - F.col("wy")).alias("dy"), (F.col("cx") - F.col("wx")).alias("dx"), "c")
    best = places.join(c, near).groupBy(*at).agg(F.min(order).alias("best"))
    hit = w.join(best, at).groupBy("doc", "page", "word_ord").agg(F.min("best").alias("best"))
    return hit.select("doc", "page", "word_ord", "best.c.size", "best.c.fontname")


def shrink(pixels: Column, n: int) -> Column:
    """Pixels as ``n`` means of equal stretches."""
    size = F.floor(F.size(pixels) / n).cast("int")
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: mean(F.slice(pixels, k * size + 1, size)))


def average_hash(pixels: Column) -> Column:
    """Bits of an image: whether a pixel is at least the mean; as a string of 0 and 1, first pixel first."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda s, x: s + x) / F.size(pixels)
    return F.array_join(F.transform(pixels, lambda p: F.when(p >= mean, "1").otherwise("0")), "")


def repeated_hashes(figures: DataFrame, least_pages: int = 3) -> DataFrame:
    return figures.groupBy("hash").agg(F.count_distinct("page").alias("n_pages")).where(F.col("n_pages") >= least_pages)


def packed_hash(bits: Column) -> Column:
    """A string of 0 and 1 as bytes, the first bit the lowest of the first byte."""
    octets = F.transform(F.sequence(F.lit(0), F.floor((F.length(bits) + 7) / 8).cast("int") - 1), lambda k: F.reverse(F.rpad(F.substr(bits, k * 8 + 1, F.lit(8)), 8, "0")))
    return F.when(F.length(bits) > 0, F.unhex(F.array_join(F.transform(octets, lambda x: F.lpad(F.conv(x, 2, 16), 2, "0")), ""))).otherwise(F.lit(b""))


def box(bbox: Column) -> Column:
    """(x0, y0, x1, y1) of a map with numbers under one of three sets of names, null without; as an array."""
    layouts = [("x0", "y0", "x1", "y1"), ("x1", "y1", "x2", "y2"), ("left", "top", "right", "bottom")]
    known = lambda names: reduce(lambda a, b: a & b, [F.map_contains_key(bbox, k) for k in names])
    values = lambda names: F.array(*[F.element_at(bbox, k).try_cast("double") for k in names])
    out = F.lit(None).cast("array<double>")
    for names in reversed(layouts):
        out = F.when(known(names), F.when(F.forall(values(names), lambda x: x.isNotNull()), values(names))).otherwise(out)
    return out


def finite(c: Column) -> Column:
    """A number, null for what is none and for NaN."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)
