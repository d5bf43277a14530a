"""From words, characters, tables and figures of pages to Markdown.

All inputs are rows with doc and page. Work is keyed by page up to the last step, which joins a document's
blocks in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import cleanup_markdown, collapse_blank_lines, heading, strip, table_markdown
from .documents import lines_of, repeated_lines, strip_repeated
from .footnotes import body_markers, definitions, resolved, with_footnotes
from .layout import bucket_lines, detect_columns, finite, nearest_char, split_cells, words_outside
from .series import fold_groups, upper_median
from .toc import strip_toc

# A page of fewer characters and no table needs OCR; default line gap; a heading's size by the body's,
# and a bold line's; longest bold heading; least part of a page and least pixels of a figure; figures of a document.
SPARSE_CHARS, LINE_GAP, HEADING_RATIO, BOLD_RATIO, BOLD_LENGTH, LEVELS = 50, 14.0, 1.15, 0.98, 120, 4
FIGURE_PART, FIGURE_PIXELS, MAX_FIGURES = 0.01, 4096, 200
BOLD_FONTS = "Bold|Heavy|Black|Semibold"
FIGURES_SENTINEL = "<!-- ========== FIGURES ========== -->"
# At most so many pages are looked at, a sparse one has fewer characters.
SAMPLED_PAGES, SPARSE_PAGE = 10, 20


def _ordered_text(order: list, text: str, separator: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t")))), lambda s: s["_t"]), separator)


# Recognised words ---------------------------------------------------------------------------

_WORD = "struct<cy:double,word_ord:bigint,x0:double,y0:double,x1:double,y1:double,text:string>"


def ocr_rows(words: DataFrame) -> DataFrame:
    """``words`` (doc, page, word_ord, text, x0, y0, x1, y1) with ``line``: a row begins six tenths of the mean height below its first word."""
    item = F.struct(((F.col("y0") + F.col("y1")) / 2).alias("cy"), F.col("word_ord").cast("long").alias("word_ord"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], "text")
    pages = words.groupBy("doc", "page").agg(F.array_sort(F.collect_list(item)).alias("items"), F.avg(F.col("y1") - F.col("y0")).alias("height"))
    below = lambda first, last, x: F.abs(x["cy"] - first["cy"]) >= 0.6 * F.col("height")
    return pages.select("doc", "page", F.inline(fold_groups(F.col("items"), _WORD, below))).select("doc", "page", F.col("g").alias("line"), "item.*")


def ocr_markdown(words: DataFrame) -> DataFrame:
    """(doc, page, ``text``): rows of one cell are text; rows in a row with as many cells, more than one, a table."""
    cells = split_cells(ocr_rows(words))
    rows = cells.groupBy("doc", "page", "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "text"))), lambda s: s["text"]).alias("cells"))
    by = W.partitionBy("doc", "page").orderBy("line")
    n = F.size("cells")
    first = (n > 1) & ~F.coalesce(F.lag(n).over(by) == n, F.lit(False))
    last = (n > 1) & ~F.coalesce(F.lead(n).over(by) == n, F.lit(False))
    piped = lambda a: F.concat(F.lit("| "), F.array_join(a, " | "), F.lit(" |"))
    row = piped(F.transform("cells", strip))
    row = F.when(F.col("first"), F.concat(F.lit("\n"), row, F.lit("\n"), piped(F.transform("cells", lambda _: F.lit("---"))))).otherwise(row)
    row = F.when(F.col("last"), F.concat(row, F.lit("\n"))).otherwise(row)
    text = F.when(n > 1, row).otherwise(F.get("cells", F.lit(0)))
    rows = rows.withColumns({"first": first, "last": last}).withColumn("md", text).where("trim(md) <> ''")
    return rows.groupBy("doc", "page").agg(collapse_blank_lines(_ordered_text(["line"], "md", "\n")).alias("text"))


# Printed words ------------------------------------------------------------------------------

_PRINTED = "struct<top:double,x0:double,word_ord:bigint,x1:double,text:string>"


def line_words(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """``words`` with ``line``: a line ends where a word is more than ``tolerance`` below the line's first."""
    item = F.struct(F.col("top").cast("double").alias("top"), F.col("x0").cast("double").alias("x0"), F.col("word_ord").cast("long").alias("word_ord"), F.col("x1").cast("double").alias("x1"), "text")
    pages = words.groupBy("doc", "page").agg(F.array_sort(F.collect_list(item)).alias("items"))
    below = lambda first, last, x: F.abs(x["top"] - first["top"]) > tolerance
    return pages.select("doc", "page", F.inline(fold_groups(F.col("items"), _PRINTED, below))).select("doc", "page", F.col("g").alias("line"), "item.*")


def line_gaps(lined: DataFrame) -> DataFrame:
    """(doc, page, ``line_gap``): upper median of the positive steps from line to line, 14 without."""
    tops = lined.groupBy("doc", "page", "line").agg(F.min("top").alias("top"))
    step = F.col("top") - F.lag("top").over(W.partitionBy("doc", "page").orderBy("line"))
    steps = tops.withColumn("step", step)
    gap = upper_median(F.when(F.col("step") > 0, F.col("step")))
    return steps.groupBy("doc", "page").agg(F.coalesce(gap, F.lit(LINE_GAP)).alias("line_gap"))


def size_levels(chars: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Heading sizes of documents: doc, ``body`` size, ``n_levels``, ``levels``: map of twice the size, rounded, to the level.

    Sizes within ``tolerance`` of the next are one cluster, whose mean counts; the body is the cluster of most characters.
    """
    sizes = chars.where("size > 0").groupBy("doc", F.col("size").cast("double").alias("size")).agg(F.count("*").alias("n"))
    by = W.partitionBy("doc").orderBy("size")
    new = ~F.coalesce(F.col("size") - F.lag("size").over(by) <= tolerance, F.lit(False))
    clusters = sizes.withColumn("new", new).withColumn("cluster", F.sum(F.col("new").cast("int")).over(by))
    clusters = clusters.groupBy("doc", "cluster").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("n"))
    found = clusters.groupBy("doc").agg(F.max(F.struct("n", "mean"))["mean"].alias("body"), F.reverse(F.array_sort(F.collect_list("mean"))).alias("means"))
    top = F.slice(F.filter("means", lambda m: m >= HEADING_RATIO * F.col("body")), 1, LEVELS)
    found = found.withColumn("top", top)
    # Of two sizes with one key the smaller level is overwritten by the later one.
    entries = F.transform("top", lambda m, k: F.struct(F.bround(m * 2).cast("int").alias("key"), (k + 1).alias("level")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    levels = F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.array_max(F.transform(F.filter(entries, lambda e: e["key"] == k), lambda e: e["level"])))))
    return found.select("doc", "body", F.size("top").alias("n_levels"), levels.alias("levels"))


def _largest_cluster(sizes: Column, tolerance: float = 0.5) -> Column:
    """Mean of the largest sizes that follow each other within ``tolerance``; 0 without any."""
    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(False).alias("over"))

    def step(acc: Column, x: Column) -> Column:
        over = acc["over"] | F.coalesce(acc["last"] - x > tolerance, F.lit(False))
        return F.struct(x.alias("last"), F.when(over, acc["sum"]).otherwise(acc["sum"] + x).alias("sum"), F.when(over, acc["n"]).otherwise(acc["n"] + 1).alias("n"), over.alias("over"))

    return F.aggregate(F.reverse(F.array_sort(sizes)), start, step, lambda a: F.when(a["n"] > 0, a["sum"] / a["n"]).otherwise(0.0))


def segments(lined: DataFrame, columns: DataFrame, fonts: DataFrame, levels: DataFrame) -> DataFrame:
    """Lines within a column: doc, page, col, line, ``top``, ``text``, ``size``, ``bold``, ``level`` (0: text)."""
    word = lined.join(columns.select("doc", "page", "split_x"), ["doc", "page"], "left").join(fonts, ["doc", "page", "word_ord"], "left")
    right = F.coalesce((F.col("x0") + F.col("x1")) / 2 >= F.col("split_x"), F.lit(False))
    rows = word.withColumn("col", right.cast("int")).withColumn("text", strip(F.col("text")))
    hit = F.col("fontname").isNotNull() | F.col("size").isNotNull()
    out = rows.groupBy("doc", "page", "col", "line").agg(
        F.min("top").alias("top"),
        strip(_ordered_text(["x0", "word_ord"], "text", " ")).alias("text"),
        _largest_cluster(F.collect_list(F.when(hit, F.coalesce("size", F.lit(0.0))))).alias("size"),
        F.coalesce(F.avg(F.when(hit, F.coalesce(F.col("fontname").rlike(BOLD_FONTS), F.lit(False)).cast("int"))) >= 0.5, F.lit(False)).alias("bold"),
    )
    out = out.where("text <> ''").join(levels, "doc", "left")
    by_size = F.coalesce(F.element_at("levels", F.bround(F.col("size") * 2).cast("int")), F.lit(0))
    as_bold = F.col("bold") & (F.length("text") < BOLD_LENGTH) & ~F.col("text").rlike("[.,;:]$") & (F.col("size") >= BOLD_RATIO * F.coalesce("body", F.lit(0.0)))
    deepest = F.when(F.coalesce("n_levels", F.lit(0)) == 0, LEVELS).otherwise(F.least(F.lit(LEVELS), F.col("n_levels")))
    level = F.when(by_size > 0, by_size).when(as_bold, deepest).otherwise(0)
    return out.select("doc", "page", "col", "line", "top", "text", "size", "bold", level.alias("level"))


def _table_blocks(tables: DataFrame) -> DataFrame:
    md = table_markdown(F.col("headers"), F.col("rows"))
    out = tables.select("doc", "page", F.lit(0).alias("col"), F.coalesce("by0", F.lit(0.0)).alias("y"), F.lit(1).alias("rank"), F.col("table_ord").cast("long").alias("ord"), F.lit("table").alias("kind"), md.alias("md"))
    return out.where("md <> ''")


def _figure_blocks(figures: DataFrame) -> DataFrame:
    md = F.concat(F.lit("![Figure (p."), F.col("page").cast("string"), F.lit(")]("), F.col("filename"), F.lit(")"))
    return figures.select("doc", "page", F.lit(0).alias("col"), F.col("top").alias("y"), F.lit(2).alias("rank"), F.col("pic_ord").cast("long").alias("ord"), F.lit("figure").alias("kind"), md.alias("md"))


def named_figures(figures: DataFrame, pages: DataFrame, stems: DataFrame) -> DataFrame:
    """Figures of at least a hundredth of their page, numbered through the document: adds ``filename``.

    ``stems`` is (doc, stem); files are called stem-fig-number-pPAGE.png.
    """
    area = F.greatest(F.lit(0.0), F.col("x1") - F.col("x0")) * F.greatest(F.lit(0.0), F.col("bottom") - F.col("top"))
    kept = figures.join(pages.select("doc", "page", "width", "height"), ["doc", "page"]).where((area > 0) & (area >= FIGURE_PART * F.col("width") * F.col("height")))
    number = F.row_number().over(W.partitionBy("doc").orderBy("page", "pic_ord"))
    out = kept.drop("width", "height").withColumn("number", number).join(stems, "doc")
    name = F.concat("stem", F.lit("-fig-"), F.col("number").cast("string"), F.lit("-p"), F.col("page").cast("string"), F.lit(".png"))
    return out.withColumn("filename", name).drop("stem", "number")


def page_methods(pages: DataFrame, prose: DataFrame, tables: DataFrame, figures: DataFrame) -> DataFrame:
    """Pages with ``extraction_method`` (ocr: under fifty characters outside tables, and none), ``table_count``, ``figure_count``."""
    n = prose.groupBy("doc", "page").agg(F.sum(F.length("text")).alias("n_chars"))
    counts = lambda df, name: df.groupBy("doc", "page").agg(F.count("*").alias(name))
    out = pages.select("doc", "page", "width").join(n, ["doc", "page"], "left")
    out = out.join(counts(tables, "table_count"), ["doc", "page"], "left").join(counts(figures, "figure_count"), ["doc", "page"], "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_chars", "table_count", "figure_count")})
    return out.withColumn("extraction_method", F.when((F.col("n_chars") < SPARSE_CHARS) & (F.col("table_count") == 0), "ocr").otherwise("native"))


def blocks(pages: DataFrame, words: DataFrame, chars: DataFrame, tables: DataFrame, figures: DataFrame, ocr: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Blocks (doc, page, col, y, rank, ord, kind, ``md``) and the pages' figures.

    ``tables`` has bx0 ... by1, null without a box, and ``figures`` a filename. ``ocr`` is (doc, page, text) of what a
    provider read on pages that need it; blank lines part its paragraphs.
    """
    prose = words_outside(words, tables.where("bx0 is not null"))
    stats = page_methods(pages, prose, tables, figures)
    native = stats.where("extraction_method = 'native'").select("doc", "page", "width")
    prose = prose.join(native, ["doc", "page"])
    columns = detect_columns(prose.withColumn("cx", (F.col("x0") + F.col("x1")) / 2))
    lined = line_words(prose)
    own = segments(lined, columns, nearest_char(prose, chars), size_levels(chars))
    rows = own.join(line_gaps(lined), ["doc", "page"]).withColumn("is_heading", F.col("level") > 0).withColumnRenamed("line", "line_ord")
    keys = ("doc", "page", "col")
    by = W.partitionBy(*keys).orderBy("line_ord")
    step = F.col("top") - F.lag("top").over(by)
    near = step <= F.greatest(1.8 * F.col("line_gap"), F.lit(12.0))
    new = ~F.coalesce(near, F.lit(False)) | F.col("is_heading") | F.coalesce(F.lag("is_heading").over(by), F.lit(False))
    rows = rows.withColumn("new", new).withColumn("para", F.sum(F.col("new").cast("int")).over(by))
    joined = rows.groupBy(*keys, "para").agg(
        F.min_by("top", "line_ord").alias("y"), F.min("line_ord").cast("long").alias("ord"), _ordered_text(["line_ord"], "text", " ").alias("text"), F.max("level").alias("level")
    )
    kind = F.when(F.col("level") > 0, "heading").otherwise("paragraph")
    md = F.when(F.col("level") > 0, heading(F.col("level"), F.col("text"))).otherwise(F.col("text"))
    out = joined.select(*keys, "y", F.lit(0).alias("rank"), (F.col("ord") * 2 + F.col("col")).alias("ord"), kind.alias("kind"), md.alias("md"))
    scanned = stats.where("extraction_method = 'ocr'").select("doc", "page")
    flat = scanned.select("doc", "page", F.lit(True).alias("_scanned"))
    extra = _table_blocks(tables).unionByName(_figure_blocks(figures)).join(flat, ["doc", "page"], "left")
    extra = extra.withColumn("y", F.when(F.col("_scanned"), 0.0).otherwise(F.col("y"))).drop("_scanned")
    out = out.unionByName(extra)
    if ocr is not None:
        parts = ocr.join(scanned, ["doc", "page"]).select("doc", "page", F.posexplode(F.split("text", r"\n\s*\n")).alias("ord", "part"))
        out = out.unionByName(
            parts.select("doc", "page", F.lit(0).alias("col"), F.lit(0.0).alias("y"), F.lit(0).alias("rank"), F.col("ord").cast("long").alias("ord"), F.lit("paragraph").alias("kind"), strip(F.col("part")).alias("md")).where("md <> ''")
        )
    headings = own.groupBy("doc", "page").agg(F.count_if(F.col("level") > 0).alias("heading_candidates"))
    stats = stats.join(columns.select("doc", "page", "layout", "confidence"), ["doc", "page"], "left").join(headings, ["doc", "page"], "left")
    stats = stats.select(
        "doc", "page", "extraction_method", "table_count", "figure_count",
        F.coalesce("layout", F.lit("single")).alias("column_layout"), F.coalesce("confidence", F.lit(1.0)).alias("column_confidence"), F.coalesce("heading_candidates", F.lit(0)).alias("heading_candidates"),
    )
    return out, stats


def render(found: DataFrame) -> DataFrame:
    """(doc, ``text``): the blocks of a document in order of page, column and place, with a rule between pages."""
    order = ["page", "col", "y", "rank", "ord"]
    before = F.lag("page").over(W.partitionBy("doc").orderBy(*order))
    rows = found.withColumn("before", before)
    part = F.concat(F.when(F.col("before") != F.col("page"), F.lit("\n---\n\n")).otherwise(F.lit("")), F.col("md"), F.lit("\n"))
    rows = rows.withColumn("part", F.coalesce(part, F.concat("md", F.lit("\n"))))
    return rows.groupBy("doc").agg(cleanup_markdown(_ordered_text(order, "part", "\n")).alias("text"))


def post_process(docs: DataFrame, page_texts: DataFrame, chars: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, ``text``) without repeated headers and footers, bare page numbers and tables of contents, and with footnotes."""
    lines = strip_repeated(lines_of(docs, ["doc"]), repeated_lines(page_texts))
    bare = lines.groupBy("doc").agg(_ordered_text(["line_ord"], "line", "\n").alias("text"))
    bare = docs.select("doc").join(bare, "doc", "left").withColumn("text", F.coalesce("text", F.lit("")))
    notes = resolved(body_markers(chars), definitions(chars, pages))
    return with_footnotes(strip_toc(bare.withColumn("doc", F.col("doc").cast("string"))).select("doc", "text"), notes)


def convert(pages: DataFrame, words: DataFrame, chars: DataFrame, tables: DataFrame, figures: DataFrame, ocr: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Markdown (doc, ``text``) and page figures of documents, without a model."""
    found, stats = blocks(pages, words, chars, tables, figures, ocr)
    texts = line_words(words).groupBy("doc", "page", "line").agg(_ordered_text(["x0", "word_ord"], "text", " ").alias("t"))
    texts = pages.select("doc", "page").join(texts.groupBy("doc", "page").agg(_ordered_text(["line"], "t", "\n").alias("text")), ["doc", "page"], "left")
    return post_process(render(found), texts.withColumn("text", F.coalesce("text", F.lit(""))), chars, pages), stats


# Documents of pages -------------------------------------------------------------------------


def structured_pages(pages: DataFrame, words: DataFrame, tables: DataFrame, ocr: DataFrame | None = None) -> DataFrame:
    """Pages (doc, page, ``text``) outside tables. Documents of under fifty characters and no table take the parts of
    ``ocr`` (doc, text), which blank lines separate, by their place."""
    lines = bucket_lines(words_outside(words, tables.where("bx0 is not null")))
    text = lines.groupBy("doc", "page").agg(_ordered_text(["line"], "text", "\n").alias("text"))
    out = pages.select("doc", "page").join(text, ["doc", "page"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    if ocr is None:
        return out
    whole = out.groupBy("doc").agg(F.sum(F.length("text")).alias("n")).where(F.col("n") < SPARSE_CHARS)
    scanned = whole.join(tables.select("doc").distinct(), "doc", "left_anti").join(ocr, "doc")
    parts = scanned.select("doc", F.posexplode(F.split("text", "\n\n")).alias("place", "part"))
    place = F.row_number().over(W.partitionBy("doc").orderBy("page")) - 1
    out = out.withColumn("place", place).join(parts, ["doc", "place"], "left")
    return out.select("doc", "page", F.coalesce("part", "text").alias("text"))


def structured_documents(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """Documents of pages with text and tables: doc, ``plain_text``, ``markdown``, ``json``, ``table_count``."""
    md = table_markdown(F.col("headers"), F.col("rows"))
    own = tables.groupBy("doc", "page").agg(
        F.array_sort(F.collect_list(F.struct("table_ord", md.alias("md"), F.struct("headers", "rows", "page").alias("as_dict")))).alias("tables")
    )
    rows = pages.join(own, ["doc", "page"], "left").withColumn("tables", F.coalesce("tables", F.array()))
    text = strip(F.col("text"))
    parts = F.filter(F.concat(F.array(text), F.transform("tables", lambda t: t["md"])), lambda x: x != "")
    rows = rows.withColumn("md", F.array_join(parts, "\n\n")).withColumn("blank", text == "")
    each = F.struct("page", "text", F.transform("tables", lambda t: t["as_dict"]).alias("tables"))
    joined = lambda keep, what, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("page", F.col(what).alias("t"))))), lambda s: s["t"]), sep)
    n = F.sum(F.size("tables")).cast("long")
    return rows.groupBy("doc").agg(
        joined(~F.col("blank"), "text", "\n\n").alias("plain_text"),
        joined(F.col("md") != "", "md", "\n\n---\n\n").alias("markdown"),
        F.to_json(F.struct(F.array_sort(F.collect_list(each)).alias("pages"), n.alias("table_count"))).alias("json"),
        n.alias("table_count"),
    )


# Figures of a model's export ----------------------------------------------------------------


def kept_figures(figures: DataFrame, stems: DataFrame) -> DataFrame:
    """Every picture (doc, pic_ord from 1, page, width, height, hash) with ``filename``, null if it is left out.

    Left out are pictures beyond the document's first 200, small ones, and those whose hash is on three pages or
    more. An empty hash says nothing.
    """
    big = (F.col("pic_ord") <= MAX_FIGURES) & (F.col("width") * F.col("height") >= FIGURE_PIXELS)
    candidates = figures.where(big)
    noisy = candidates.where("hash <> ''").groupBy("doc", "hash").agg(F.count_distinct("page").alias("n")).where("n >= 3").select("doc", "hash", F.lit(True).alias("noisy"))
    rows = figures.join(noisy, ["doc", "hash"], "left").withColumn("kept", big & F.col("noisy").isNull())
    number = F.sum(F.col("kept").cast("int")).over(W.partitionBy("doc").orderBy("pic_ord"))
    rows = rows.withColumn("number", number).join(stems, "doc")
    name = F.concat(F.lit("figure-"), F.col("number").cast("string"), F.lit("-p"), F.col("page").cast("string"), F.lit("-"), F.col("stem"), F.lit(".png"))
    return rows.withColumn("filename", F.when(F.col("kept"), name)).drop("noisy", "kept", "number", "stem")


def inject_figures(docs: DataFrame, figures: DataFrame) -> DataFrame:
    """(doc, ``text``): the n-th image mark becomes a reference to the n-th picture's file, or says that it was left out;
    marks beyond the pictures stay. The definitions of the files, with their contents, follow at the end."""
    mark = r"(?i)<!--\s*image\s*-->"
    slots = figures.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pic_ord", "filename", "page", "content"))).alias("slots"))
    rows = docs.join(slots, "doc", "left").withColumn("slots", F.coalesce("slots", F.expr("cast(array() as array<struct<pic_ord:bigint,filename:string,page:bigint,content:binary>>)")))
    names = F.array_distinct(F.filter(F.transform("slots", lambda s: s["filename"]), lambda f: f.isNotNull()))
    rows = rows.withColumn("names", names).withColumn("parts", F.split("text", mark, -1)).withColumn("marks", F.regexp_extract_all("text", F.lit(f"({mark})"), F.lit(1)))
    number = lambda f: F.array_position("names", f).cast("string")
    reference = lambda f: F.concat(F.lit("![Figure "), number(f), F.lit("][fig"), number(f), F.lit("]"))

    def part(text: Column, k: Column) -> Column:
        slot = F.get("slots", k - 1)
        note = F.when(slot.isNull(), F.get("marks", k - 1)).when(slot["filename"].isNull(), "*[figure filtered]*").otherwise(reference(slot["filename"]))
        return F.when(k == 0, text).otherwise(F.concat(note, text))

    body = F.array_join(F.transform("parts", part), "")
    defined = F.transform(
        F.filter("slots", lambda s: s["filename"].isNotNull()),
        lambda s: F.concat(F.lit("<!-- fig"), number(s["filename"]), F.lit(": page "), s["page"].cast("string"), F.lit(" -->\n[fig"), number(s["filename"]), F.lit("]: data:image/png;base64,"), F.base64(s["content"])),
    )
    section = F.concat(F.regexp_replace(body, r"(?U)\s+$", ""), F.lit(f"\n\n{FIGURES_SENTINEL}\n\n"), F.array_join(defined, "\n"), F.lit("\n"))
    return rows.select("doc", F.when(F.size("names") > 0, section).otherwise(body).alias("text"))


# Figures about pages ------------------------------------------------------------------------


def known_pages(*sources: DataFrame) -> DataFrame:
    """All pages (doc, page) that any source names; page 0 stands for none."""
    out = sources[0].select("doc", "page")
    for s in sources[1:]:
        out = out.union(s.select("doc", "page"))
    return out.where("page <> 0").distinct()


def cell_methods(cells: DataFrame) -> DataFrame:
    """(doc, page, ``extraction_method``) by where a page's cells (from_ocr, label) come from: native, ocr or mixed."""
    by_flag = F.lower(F.col("from_ocr").cast("string"))
    read = F.when(by_flag.isin("true", "1"), True).when(by_flag.isin("false", "0"), False).otherwise(F.coalesce(F.lower("label").contains("ocr"), F.lit(False)))
    out = cells.withColumn("read", read).groupBy("doc", "page").agg(F.count_if("read").alias("n_ocr"), F.count_if(~F.col("read")).alias("n_parsed"))
    return out.select("doc", "page", F.when(F.col("n_ocr") == 0, "native").when(F.col("n_parsed") == 0, "ocr").otherwise("mixed").alias("extraction_method"))


SCORES = ["docling_score", "ocr_score", "layout_score", "parse_score", "table_score"]


def heuristic_entries(stats: DataFrame) -> DataFrame:
    """Page figures in the form that all engines share; without a model there are no grades and scores."""
    empty = [F.lit(None).cast("string").alias("docling_grade"), *[F.lit(None).cast("double").alias(c) for c in SCORES]]
    return stats.select(F.col("doc").alias("source"), "page", F.lit("heuristic").alias("engine"), "extraction_method", "table_count", "figure_count", *empty)


def model_entries(pages: DataFrame, methods: DataFrame, tables: DataFrame, figures: DataFrame, scores: DataFrame) -> DataFrame:
    """Page figures of a model's run, scores that are no numbers null."""
    count = lambda df, name: df.groupBy("doc", "page").agg(F.count("*").alias(name))
    out = pages.join(methods, ["doc", "page"], "left").join(count(tables, "table_count"), ["doc", "page"], "left").join(count(figures, "figure_count"), ["doc", "page"], "left").join(scores, ["doc", "page"], "left")
    return out.select(
        F.col("doc").alias("source"), "page", F.lit("docling").alias("engine"), F.coalesce("extraction_method", F.lit("native")).alias("extraction_method"),
        F.coalesce("table_count", F.lit(0)).alias("table_count"), F.coalesce("figure_count", F.lit(0)).alias("figure_count"), "docling_grade", *[finite(F.col(c)).alias(c) for c in SCORES],
    )


def transform_stats(entries: DataFrame, keys: list[str], n_warnings: Column | None = None) -> DataFrame:
    """Totals of pages, tables, figures and engines by ``keys``, and ``stats``: what a reader is told of them."""
    totals = entries.groupBy(*keys).agg(
        F.count("*").alias("n_pages"),
        F.sum(F.coalesce("table_count", F.lit(0))).alias("n_tables"),
        F.sum(F.coalesce("figure_count", F.lit(0))).alias("n_figures"),
        F.count_if(F.col("extraction_method").isin("ocr", "mixed")).alias("n_ocr"),
        F.count_if(F.col("engine") == "docling").alias("n_docling"),
        F.count_if(F.col("engine") == "heuristic").alias("n_heuristic"),
        (F.lit(0) if n_warnings is None else n_warnings).alias("n_warnings"),
    )
    say = lambda c, words: F.concat(F.col(c).cast("string"), F.lit(words))
    some = lambda c: F.col(c) > 0
    engine = F.when(some("n_heuristic") & some("n_docling"), say("n_heuristic", " heuristic-fallback")).when(some("n_heuristic"), "heuristic engine (Docling unavailable)").when(some("n_docling"), "Docling engine")
    bits = F.array(say("n_pages", " pages"), say("n_tables", " tables"), say("n_figures", " figures"), F.when(some("n_ocr"), say("n_ocr", " OCR'd")), engine, F.when(some("n_warnings"), say("n_warnings", " warnings")))
    return totals.withColumn("stats", F.filter(bits, lambda x: x.isNotNull()))


def merged_summary(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Grades of the first document by name, mean of the mean scores and least of the low ones; what is no number does not count."""
    return summaries.groupBy(*keys).agg(
        F.min_by("mean_grade", "source").alias("mean_grade"),
        F.min_by("low_grade", "source").alias("low_grade"),
        F.avg(finite(F.col("mean_score"))).alias("mean_score"),
        F.min(finite(F.col("low_score"))).alias("low_score"),
    )


def probe(pages: DataFrame) -> DataFrame:
    """(doc, ``page_count``, ``ocr_expected``): whether over half of ten pages spread over the document have under twenty characters.

    ``pages`` is (doc, page from 1, n_chars).
    """
    total = F.count("*").over(W.partitionBy("doc"))
    rows = pages.withColumn("total", total)
    sample = F.least(F.col("total"), F.lit(SAMPLED_PAGES))
    stride = F.greatest(F.lit(1), F.floor(F.col("total") / sample))
    seen = (F.pmod(F.col("page") - 1, stride) == 0) & ((F.col("page") - 1) / stride < sample)
    share = F.avg(F.when(seen, (F.col("n_chars") < SPARSE_PAGE).cast("int")))
    return rows.groupBy("doc").agg(F.count("*").alias("page_count"), F.coalesce(share > 0.5, F.lit(False)).alias("ocr_expected"))


def probe_inputs(files: DataFrame, probes: DataFrame) -> DataFrame:
    """Per request (request_id) of files (filename = doc): pages of its PDFs and whether any needs OCR."""
    pdfs = files.where(F.lower("filename").endswith(".pdf")).join(probes, F.col("filename") == F.col("doc"), "left")
    found = pdfs.groupBy("request_id").agg(F.sum("page_count").alias("page_count"), F.bool_or("ocr_expected").alias("ocr_expected"))
    out = files.select("request_id").distinct().join(found, "request_id", "left")
    return out.select("request_id", F.coalesce("page_count", F.lit(0)).alias("page_count"), F.coalesce("ocr_expected", F.lit(False)).alias("ocr_expected"))


