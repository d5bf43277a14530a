"""Page trees, page engines, jobs and providers on small cases with results worked out by hand."""

import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom import engine
from ledgerloom.functions import payee
from ledgerloom.operators import footnotes, layout, statements, toc, transactions
from ledgerloom.operators import pages as P
from ledgerloom.operators.documents import repeated_lines
from ledgerloom.operators.jobs import estimates
from ledgerloom.sources import dom, files, html, providers
from ledgerloom.streaming import jobs as stream
from ledgerloom.streaming.store import DIED, JobStore, engine_of_result, run_worker


def md(page, images=()):
    return "\n".join(x for x in dom.markdown_of(page, images).split("\n") if x.strip())


def words_page(n=30):
    return "<p>" + "word " * n + "</p>"


def test_noise_goes_and_text_behind_it_stays():
    root = dom.parse('<body>a<script>x</script> b<nav>n</nav>c<div style="Display : none">h</div><p class="my-SIDEBAR">s</p><div class="ad">ad</div><form>in <b>form</b></form><!-- c -->d</body>')
    dom.strip_noise(root)
    assert root.text() == "a bcadin formd"
    assert root.find("form") is None and root.find("b") is not None


def test_open_elements_end_where_others_begin():
    root = dom.parse("<ul><li>a<li>b</ul><p>x<p>y<table><tr><td>1<td>2<tr><td>3</table>")
    assert [n.text() for n in root.walk() if n.tag == "li"] == ["a", "b"]
    assert [n.text() for n in root.walk() if n.tag == "p"] == ["x", "y"]
    assert [[c.text() for c in dom.own_cells(r)] for r in dom.own_rows(root.find("table"))] == [["1", "2"], ["3"]]


@pytest.mark.parametrize(
    "table, layout_table",
    [
        ('<table role="presentation"><tr><th>a</th></tr></table>', True),
        ("<table><tr><th>a</th><th>b</th></tr></table>", False),
        ("<table></table>", True),
        ("<table><tr><td>a</td></tr><tr><td>b</td></tr></table>", True),
        ("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>", False),
        ("<table><tr><td>a</td><td></td><td> </td></tr><tr><td>\xa0</td><td>b</td><td>c</td></tr></table>", True),
        ('<table border="0">' + "<tr><td>a</td><td>b</td></tr>" * 6 + "</table>", True),
        ("<table><tr><td><p>a</p></td><td>b</td></tr></table>", True),
        ("<table><tr><td>" + "x" * 500 + "</td><td>b</td></tr></table>", True),
    ],
)
def test_layout_tables(table, layout_table):
    assert dom.is_layout_table(dom.parse(table).find("table")) is layout_table


def test_layout_tables_become_blocks():
    rows = "<tr><td>1</td><td><p>First</p> tail</td><td>more</td></tr><tr><td></td><td></td></tr><tr><td>only</td><td> </td></tr>"
    assert [x.strip() for x in md(f'<body><table role="none">{rows}</table></body>').split("\n")] == ["1.", "First", "tail", "more", "only"]


def test_headings_by_size_and_weight():
    page = '<body><div style="font-size:24px">Top</div><div style="font-size: 18pt">Near</div><div style="font-size:1.2em"><span>Lower</span></div><div><span><b><u>Bold</u></b></span></div><p>some <b>fragment</b> of a longer text</p></body>'
    assert md(page).split("\n") == ["# Top", "# Near", "## Lower", "### Bold", "some **fragment** of a longer text"]
    assert dom.heading_tiers([30.0, 28.5, 27.0, 20.0]) == [(30.0, 1), (28.5, 2), (27.0, 2), (20.0, 3)]


def test_lists_links_marks_and_tables():
    page = '<body><p style="margin-left:2em">1) one</p><p style="margin-left:2em">2) two</p><p><a href="http://x/y">http://x/y</a> <a href="#a">no</a> <a href="/z">t</a> <i>it</i>a*b</p><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2<br>3</td></tr></table><ul><li>a<ul><li>b</li></ul></li></ul></body>'
    assert md(page).split("\n") == ["1. one", "2. two", "http://x/y no [t](/z) *it*a\\*b", "| A | B |", "| --- | --- |", "| 1 | 2 3 |", "- a", "  - b"]


def test_content_root_and_main_part():
    page = f"<body><div>menu text</div><div class='x entry-content'>{words_page(60)}<p>end</p></div><div>{words_page(20)}</div></body>"
    assert dom.content_root(dom.body_of(dom.parse(page))).get("class") == "x entry-content"
    deep = f"<body><p>a</p><div><section>{words_page(60)}</section><p>b</p></div></body>"
    assert dom.content_root(dom.body_of(dom.parse(deep))).tag == "p"
    assert dom.body_of(dom.parse(f"<body>x<main>{words_page()}</main></body>")).tag == "main"


def test_images_are_described():
    page = '<body><p>a<img src="http://h/i.png?x" alt=" Map "> tail<img src="http://h/small.png"><img src="http://h/none.png"></p></body>'
    assert "[Map — not converted]" in md(page, [("http://h/I.png", 6000), ("http://h/small.png", 10)])
    assert md(page, [("http://h/i.png", 4999)]).count("not converted") == 0


def test_head_metadata():
    page = dom.parse('<head><title>Short</title><meta property="og:description" content="d1"><meta name="Description" content="d2"><meta name="author" content=" "><link rel="canonical" href="https://www.site.org/p"></head>')
    assert dom.head_metadata(page, {"title": "Short | Site"}) == {"title": "Short", "description": "d1", "source": "https://www.site.org/p", "site_name": "site.org"}


def test_any_entity_is_decoded(spark):
    pages = spark.createDataFrame([(1, "<p>&eacute;&#39;&mdash;&amp;</p><style>x</style>b<br/>c<br>d"), (2, None)], "page_id long, html string")
    assert {r.page_id: r.text for r in html.texts(pages).collect()} == {1: "é'—&\nb\ncd", 2: None}


def test_archives_to_markdown(spark):
    raw = b'Subject: T\nContent-Location: http://w/x\nContent-Type: multipart/related; boundary="b"\n\n--b\nContent-Type: text/html\n\n<body><h1>H</h1></body>\n--b--\n'
    got = files.archives_markdown(spark.createDataFrame([("a.mhtml", raw), ("b.mht", None)], "filename string, content binary")).collect()
    assert got[0].filename == "a.md" and got[0].text == '---\ntitle: T\nsource: "http://w/x"\nsite_name: w\n---\n\n# H'
    assert got[1].filename == "b.mht"


# Tables of contents and footnotes ---------------------------------------------------------------


def test_toc_sections_are_nested_and_rescanned():
    toc_rows = [f"Chapter {k} .... {k}" for k in range(3, 9)]
    lines = ["# Book", "intro text.", "more of it.", "and more.", "## Contents:", "a", "### inner", "b", "## Next", *toc_rows, "## Last", "prose."]
    assert toc.drop_sections(lines) == (["# Book", "intro text.", "more of it.", "and more.", "## Last", "prose."], 2)


def test_toc_runs_with_rules_and_labels():
    entry = lambda k: f"| Topic {k} | {k} |"
    lines = ["A sentence.", "Page", "from paragraph", "| Head | No |", "|---|---|", entry(1), entry(2), entry(3), "|---|---|", entry(4), "| Annex | see |", entry(5), "", "Prose again."]
    assert toc.drop_runs(lines) == (["A sentence.", "Prose again."], 8)
    assert toc.drop_runs(["x.", entry(1), entry(2), entry(3), entry(4), "y"])[1] == 0


def chars_of(text, size, top, start=0, page=1):
    return [("d", page, start + k, c, size, top, 5.0 * k, 5.0 * k + 5) for k, c in enumerate(text)]


def test_footnotes(spark):
    rows = chars_of("A word", 10.0, 100.0) + [("d", 1, 6, "1", 6.0, 97.5, 30.0, 35.0), ("d", 1, 7, "2", 6.0, 97.5, 35.0, 40.0)]
    rows += chars_of("the body of the page is in size ten", 10.0, 400.0, 200)
    rows += chars_of(" ( e", 10.0, 200.0, 10) + [("d", 1, 14, "7", 6.0, 198.0, 20.0, 25.0)]  # an exponent
    rows += chars_of("b 3.", 10.0, 300.0, 20) + [("d", 1, 24, "9", 6.0, 298.5, 20.0, 25.0)]  # a decimal
    rows += [("d", 1, 40, "1", 6.0, 900.0, 0.0, 5.0), ("d", 1, 41, "2", 6.0, 900.0, 5.0, 10.0)] + [("d", 1, 42 + k, c, 7.0, 901.0, 10.0 + 5 * k, 15.0 + 5 * k) for k, c in enumerate(" note text")]
    rows += [("d", 1, 60 + k, c, 7.0, 910.0, 5.0 * k, 5.0 * k + 5) for k, c in enumerate("goes on 44")] + [("d", 1, 80, "5", 10.0, 950.0, 0.0, 5.0)]
    chars = spark.createDataFrame(rows, "doc string, page long, char_ord long, text string, size double, top double, x0 double, x1 double")
    assert [(r.marker, r.char_ord) for r in footnotes.body_markers(chars).collect()] == [("12", 6)]
    pages = spark.createDataFrame([("d", 1, 1000.0)], "doc string, page long, height double")
    found = footnotes.definitions(chars, pages)
    assert [(r.marker, r.definition) for r in found.collect()] == [("12", "note text goes on")]
    docs = spark.createDataFrame([("d", "A word12 and B12.\n```\nword12\n```\n| word12 |\n    word12"), ("e", "x12")], "doc string, text string")
    got = {r.doc: r.text for r in footnotes.with_footnotes(docs, footnotes.resolved(footnotes.body_markers(chars), found)).collect()}
    assert got["d"] == "A word[^12] and B12.\n```\nword12\n```\n| word12 |\n    word12\n\n" + footnotes.SENTINEL + "\n\n[^12]: note text goes on\n"
    assert got["e"] == "x12"


def test_characters_of_footnotes_are_never_broadcast(spark):
    rows = spark.range(200).select(F.floor(F.col("id") / 50).cast("string").alias("doc"), F.lit(1).cast("long").alias("page"), F.col("id").alias("k"), F.posexplode(F.split(F.lit("word 12"), "")).alias("j", "text"))
    size = F.when(F.col("j") > 4, 6.0).otherwise(10.0)
    chars = rows.select("doc", "page", (F.col("k") * 100 + F.col("j")).alias("char_ord"), "text", size.alias("size"), (F.col("k") * 4.0).alias("top"), (F.col("j") * 5.0).alias("x0"), (F.col("j") * 5.0 + 5).alias("x1"))
    pages = chars.select("doc", "page").distinct().withColumn("height", F.lit(1000.0))
    found = footnotes.resolved(footnotes.body_markers(chars), footnotes.definitions(chars, pages))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


# The page engine ----------------------------------------------------------------------------------


def page_of(spark, lines, width=600.0):
    """lines: (top, x0, text, size, font); words of 5 points a character."""
    words, chars = [], []
    for top, x, text, size, font in lines:
        for w in text.split():
            words.append(("d", 1, len(words), w, x, top, x + 5.0 * len(w), top + size))
            for k, c in enumerate(w):
                chars.append(("d", 1, len(chars), c, size, font, top, x + 5.0 * k, x + 5.0 * k + 5))
            x += 5.0 * len(w) + 5
    return (
        spark.createDataFrame([("d", 1, width, 800.0)], "doc string, page long, width double, height double"),
        spark.createDataFrame(words, "doc string, page long, word_ord long, text string, x0 double, top double, x1 double, bottom double"),
        spark.createDataFrame(chars, "doc string, page long, char_ord long, text string, size double, fontname string, top double, x0 double, x1 double"),
    )


TABLES = "doc string, page long, table_ord long, headers array<string>, rows array<array<string>>, bx0 double, by0 double, bx1 double, by1 double"
FIGURES = "doc string, page long, pic_ord long, x0 double, top double, x1 double, bottom double, filename string"


def test_page_engine(spark):
    lines = [(50.0, 20.0, "Great Title", 20.0, "F"), (80.0, 20.0, "first line of text that is long enough", 10.0, "F"), (92.0, 20.0, "second line of the same paragraph", 10.0, "F")]
    lines += [(130.0, 20.0, "Bold lead", 10.0, "F-Bold"), (150.0, 20.0, "after the lead comes more text", 10.0, "F"), (300.0, 20.0, "inside", 10.0, "F"), (320.0, 20.0, "last words", 10.0, "F")]
    pages, words, chars = page_of(spark, lines)
    tables = spark.createDataFrame([("d", 1, 0, ["A"], [["1"]], 0.0, 290.0, 600.0, 312.0)], TABLES)
    figures = spark.createDataFrame([("d", 1, 0, 0.0, 200.0, 100.0, 260.0, "f.png")], FIGURES)
    text, stats = P.convert(pages, words, chars, tables, figures)
    want = ["# Great Title", "first line of text that is long enough second line of the same paragraph", "# Bold lead", "after the lead comes more text", "![Figure (p.1)](f.png)", "| A |\n| --- |\n| 1 |", "last words"]
    assert text.first().text.strip() == "\n\n".join(want)
    s = stats.first()
    assert (s.extraction_method, s.table_count, s.figure_count, s.column_layout, s.heading_candidates) == ("native", 1, 1, "single", 2)
    entry = P.heuristic_entries(stats).first()
    assert (entry.source, entry.engine, entry.docling_grade) == ("d", "heuristic", None)


def test_two_columns_are_read_one_after_the_other(spark):
    lines = [(20.0 + 12 * k, x, f"{side}{k} alpha beta gamma", 10.0, "F") for k in range(8) for side, x in (("l", 40.0), ("r", 340.0))]
    pages, words, chars = page_of(spark, lines)
    text, stats = P.convert(pages, words, chars, spark.createDataFrame([], TABLES), spark.createDataFrame([], FIGURES))
    left, right = text.first().text.strip().split("\n\n")
    assert left.startswith("l0") and left.count("alpha") == 8 and right.startswith("r0")
    assert stats.first().column_layout == "two"


def test_sparse_pages_take_recognised_text(spark):
    pages, words, chars = page_of(spark, [(50.0, 20.0, "few", 10.0, "F")])
    ocr = spark.createDataFrame([("d", 1, "One\n \nTwo")], "doc string, page long, text string")
    none = spark.createDataFrame([], TABLES), spark.createDataFrame([], FIGURES)
    found, stats = P.blocks(pages, words, chars, *none, ocr)
    assert P.render(found).first().text == "One\n\nTwo\n" and stats.first().extraction_method == "ocr"
    tables = spark.createDataFrame([], TABLES)
    whole = spark.createDataFrame([("d", "A\n\nB")], "doc string, text string")
    assert [r.text for r in P.structured_pages(pages, words, tables, whole).collect()] == ["A"]


def test_pages_are_parted_by_rules(spark):
    rows = [("d", 1, 0, 5.0, 0, 0, "paragraph", "a"), ("d", 2, 0, 5.0, 0, 0, "paragraph", "b"), ("d", 2, 1, 1.0, 0, 0, "paragraph", "c")]
    found = spark.createDataFrame(rows, "doc string, page int, col int, y double, rank int, ord long, kind string, md string")
    assert P.render(found).first().text == "a\n\n---\n\nb\n\nc\n"


def test_size_levels(spark):
    sizes = [10.0] * 9 + [10.4] * 2 + [8.0] * 3 + [12.0, 14.0, 16.0, 18.0, 20.0]
    chars = spark.createDataFrame([("d", s) for s in sizes], "doc string, size double")
    row = P.size_levels(chars).first()
    assert round(row.body, 4) == round((90 + 20.8) / 11, 4) and row.n_levels == 4 and dict(row.levels) == {40: 1, 36: 2, 32: 3, 28: 4}


def test_detect_columns_by_hand(spark):
    few = [("a", 1, float(k * 10), 600.0) for k in range(39)]
    flat = [("b", 1, float(k * 10), 600.0) for k in range(60)]
    same = [("c", 1, 200.0, 600.0) for _ in range(50)] + [("c", 1, 400.0, 600.0)]
    got = {r.doc: r for r in layout.detect_columns(spark.createDataFrame(few + flat + same, "doc string, page int, cx double, width double")).collect()}
    assert (got["a"].layout, got["a"].confidence) == ("single", 1.0)
    assert (got["b"].layout, got["b"].confidence) == ("single", round(1 - 1 / 9, 3))
    assert (got["c"].layout, got["c"].confidence, got["c"].split_x) == ("two", round(200 / 208, 3), 300.0)


def test_fonts_come_from_the_word_s_own_page(spark):
    words = spark.createDataFrame([("d", 2, 1, 10.0, 20.0)], "doc string, page int, word_ord int, x0 double, top double")
    chars = spark.createDataFrame([("d", 1, 0, 10.0, 20.0, 5.0, "A"), ("d", 2, 1, 11.0, 20.2, 7.0, "B"), ("d", 2, 2, 11.0, 20.2, 8.0, "C")], "doc string, page int, char_ord int, x0 double, top double, size double, fontname string")
    assert [(r.size, r.fontname) for r in layout.nearest_char(words, chars).collect()] == [(8.0, "C")]


def rows_joined(df):
    """Rows that the joins of a frame made when it ran."""
    df.collect()
    plans, n = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        p = plans.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            plans.append(p.executedPlan())
        elif name.endswith("QueryStage"):
            plans.append(p.plan())
        elif "Join" in name or name == "CartesianProduct":
            n += p.metrics().apply("numOutputRows").value()
        plans += [p.children().apply(k) for k in range(p.children().size())]
    return n


def test_places_are_matched_once_however_many_words_begin_there(spark):
    words = spark.range(400).select(F.lit("d").alias("doc"), F.lit(1).alias("page"), F.col("id").alias("word_ord"), F.lit(10.0).alias("x0"), F.lit(20.0).alias("top"))
    chars = words.select("doc", "page", F.col("word_ord").alias("char_ord"), "x0", "top", F.col("word_ord").cast("double").alias("size"), F.lit("F").alias("fontname"))
    twice = words.union(words.where("word_ord = 3").withColumn("top", F.lit(19.6)))
    found = layout.nearest_char(twice, chars)
    assert {(r.word_ord, r.size) for r in found.collect()} == {(k, 399.0) for k in range(400)} and found.count() == 400
    assert rows_joined(found) < 1000


def test_words_outside_boxes_are_found_by_cells(spark):
    inf, nan = float("inf"), float("nan")
    values = [-inf, -40.0, -5.0, 0.0, 3.0, 15.0, 40.0, 600.0, inf, nan, None]
    r = random.Random(1)
    spot = lambda: tuple(r.choice(values) if r.random() < 0.15 else r.randint(-60, 60) / 2 for _ in range(4))
    words = [(d, 1, k, *spot()) for k in range(300) for d in "ab"] * 2
    rows = [(r.choice("abc"), 1, *spot()) for _ in range(60)] + [("b", 1, -30.0, 0.0, 30.0, 2.0), ("b", 1, -inf, 0.0, inf, 9.0), ("a", 1, 0.0, 0.0, 1e300, 3.0)]
    w = spark.createDataFrame(words, "doc string, page int, word_ord int, x0 double, top double, x1 double, bottom double")
    b = spark.createDataFrame(rows, "doc string, page int, bx0 double, by0 double, bx1 double, by1 double")
    key = lambda x: (x != x, x if x == x else 0.0)  # noqa: E731  NaN is the largest number, as it is for Spark
    le = lambda a, b: a is not None and b is not None and key(a) <= key(b)
    move = lambda x, by: None if x is None else x + by
    inside = lambda t, v: t[0] == v[0] and le(move(v[2], -5), t[3]) and le(t[5], move(v[4], 5)) and le(move(v[3], -5), t[4]) and le(t[6], move(v[5], 5))
    want = Counter((t[0], t[2]) for t in words if not any(inside(t, v) for v in rows))
    found = layout.words_outside(w, b)
    assert found.columns == w.columns and 0 < len(want) < 600
    assert Counter((x.doc, x.word_ord) for x in found.collect()) == want
    ranges = [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in x and ">=" in x]
    assert ranges and all(len(re.search(r"Join \[([^]]*)\]", x)[1].split(",")) > 2 for x in ranges)


def test_repeated_lines_skip_masks(spark):
    pages = spark.createDataFrame([("d", k, f"Head {k}\n{k}\nx\nbody {k} text") for k in range(6)], "doc string, page int, text string")
    assert {r.norm for r in repeated_lines(pages).collect()} == {"head #", "body # text"}


def test_packed_hash(spark):
    row = spark.createDataFrame([("10000001" + "01",)], "bits string").select(layout.packed_hash(F.col("bits")).alias("h")).first()
    assert bytes(row.h) == bytes([0x81, 0x02])


def test_page_helpers(spark):
    cells = spark.createDataFrame([("d", 1, "true", None), ("d", 2, None, "ocr_text"), ("d", 2, "false", None), ("d", 3, None, "text")], "doc string, page int, from_ocr string, label string")
    assert {r.page: r.extraction_method for r in P.cell_methods(cells).collect()} == {1: "ocr", 2: "mixed", 3: "native"}
    assert sorted(r.page for r in P.known_pages(cells, spark.createDataFrame([("d", 0), ("d", 4)], "doc string, page int")).collect()) == [1, 2, 3, 4]
    figures = spark.createDataFrame([("d", 1, 1, 0.0, 0.0, 60.0, 80.0), ("d", 1, 2, 0.0, 0.0, 10.0, 10.0)], "doc string, page int, pic_ord int, x0 double, top double, x1 double, bottom double")
    pages = spark.createDataFrame([("d", 1, 600.0, 800.0)], "doc string, page int, width double, height double")
    stems = spark.createDataFrame([("d", "s")], "doc string, stem string")
    assert [r.filename for r in P.named_figures(figures, pages, stems).collect()] == ["s-fig-1-p1.png"]
    files_ = spark.createDataFrame([(1, "a.PDF"), (1, "b.txt"), (2, "c.txt")], "request_id int, filename string")
    probes = spark.createDataFrame([("a.PDF", 7, True)], "doc string, page_count int, ocr_expected boolean")
    assert {r.request_id: (r.page_count, r.ocr_expected) for r in P.probe_inputs(files_, probes).collect()} == {1: (7, True), 2: (0, False)}


# Statements ----------------------------------------------------------------------------------------


def test_payees(spark):
    said = {
        "@ MALL SINGAPORE SG": "@ Mall Singapore Sg",
        "  ": "  ",
        "008MY PREFERRED PAYMENT PLAN03 (01)": "DBS Payment Plan",
        "123CARDS (x)": "CARDS",
        "TS/" + "A" * 12_000 + " - B": "A" + "a" * 11_999,
        "GOOGLE " + "b" * 11_000: "Google B" + "b" * 10_999,
    }
    rows = spark.createDataFrame([(k,) for k in said], "d string").select("d", payee.derive_payee(F.col("d")).alias("p")).collect()
    assert {r.d: r.p for r in rows} == said
    assert payee.common_subsequence("starbuck", "starbucks") == 8 and payee.indel_ratio("abcde", "abxde") == 80.0 and payee.indel_ratio("", "") == 100.0


def test_categories_keep_every_row(spark):
    txns = spark.createDataFrame([("GRAB 1",), (None,), ("grab",)], "payee string")
    dim = spark.createDataFrame([("Grab", "Transport", 0), ("Grab", "Twice", 1)], "payee string, category string, dict_ord int")
    aliases = spark.createDataFrame([("x", "Y"), ("x", "Z")], "alias string, payee string")
    got = sorted((str(r.vendor), r.category) for r in transactions.categorised(txns, aliases, dim).collect())
    assert got == [("Grab", "Transport"), ("Grab", "Transport"), ("None", "Other")]


def test_auto_takes_tables_first(spark):
    texts = spark.createDataFrame([("a", "As at 1 Feb 2024"), ("b", "23 Mar 2025\nNEW TRANSACTIONS"), ("c", "nothing")], "doc string, text string")
    lines = spark.createDataFrame([("b", 0, "NEW TRANSACTIONS"), ("b", 1, "03 APR CAFE 1.50")], "doc string, line_ord long, line string")
    words = spark.createDataFrame([], "doc string, page int, word_ord long, text string, x0 double, top double")
    pages = spark.createDataFrame([], "doc string, page int, width double")
    tables = spark.createDataFrame([("a", 1, 0, ["Date", "Memo", "Amount"], [["5 Jan", "x", "-2.00"], ["Total", "", "1.00"]])], "doc string, page int, table_ord int, headers array<string>, rows array<array<string>>")
    got = {r.doc: (r.date, r.amount, r.credit) for r in statements.parse("auto", texts, lines, words, pages, tables).collect()}
    assert got == {"a": ("2024-01-05", 2.0, False), "b": ("2024-04-03", 1.5, False)}
    with pytest.raises(ValueError, match="Unknown template"):
        statements.parse("none", texts, lines, words, pages, tables)


def test_csv_and_lookup_files(spark, tmp_path):
    txns = spark.createDataFrame([("2024-01-02", 'A "b", c', "A", "Food", "", 5.0, False, 0, 1), ("2024-01-01", "z", "Z", "Other", "", 3.5, True, 0, 0)], "date string, payee string, vendor string, category string, memo string, amount double, credit boolean, file_ord int, row_ord int")
    transactions.write_csv(txns.coalesce(1), str(tmp_path / "csv"))
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "csv").glob("part-*"))).decode()
    lines = [x for x in text.split("\r\n") if x and not x.startswith("Date")]
    assert lines == ["2024-01-01,z,Z,Other,,3.50", '2024-01-02,"A ""b"", c",A,Food,,-5.00']
    seed = tmp_path / "seed.json"
    seed.write_text(json.dumps({"payee_categories": {"B": "x", "A": "y"}, "payee_aliases": {"b": "B"}}))
    cats, aliases = statements.load_lookup(spark, str(tmp_path / "lookup"), str(seed))
    assert [(r.payee, r.dict_ord) for r in cats.orderBy("dict_ord").collect()] == [("B", 0), ("A", 1)] and aliases.count() == 1
    assert statements.load_lookup(spark, str(tmp_path / "none"))[0].count() == 0
    broken = tmp_path / "broken.json"
    broken.write_text("{")
    assert statements.load_lookup(spark, str(broken))[0].count() == 0
    assert engine.health(spark, str(tmp_path / "none"))["lookup_exists"] is False and engine.version()["version"]


# Requests, jobs, providers -----------------------------------------------------------------------


def test_requests(spark):
    rows = [(1, "a.html", b"<p>x</p>", 0), (1, "a.html", b"<p>y</p>", 1), (1, "b.bin", b"z", 2), (2, "c.bin", b"", 0), (3, "m.txt", b"", 0)]
    reqs = spark.createDataFrame(rows, "request_id int, filename string, content binary, file_ord int")
    got = {r.request_id: json.loads(r.json) for r in engine.extract(reqs.where("request_id < 3")).collect()}
    assert got[1] == {"scheme": "raw", "errors": [{"filename": "b.bin", "error": "Unsupported file type"}], "text": "y", "filename": "a.html"}
    assert got[2]["detail"].startswith("All extractions failed")
    refused = json.loads(engine.extract(reqs.where("request_id = 3"), "mhtml2md").first().json)
    assert "not accepted by scheme 'mhtml2md'" in refused["detail"]
    with pytest.raises(ValueError, match="Unknown scheme"):
        engine.extract(reqs, "none")
    big = spark.createDataFrame([(9, "a.mhtml", b"x" * (2 * 1024 * 1024 + 1), 0)], "request_id int, filename string, content binary, file_ord int")
    assert [r.type for r in engine.events(big, "mhtml2md").collect()] == ["job_queued"]
    frames = [r.frame for r in engine.events(reqs.where("request_id = 2")).orderBy("seq").collect()]
    assert json.loads(frames[0][6:]) == {"type": "progress", "current": 1, "total": 1, "filename": "c.bin"} and json.loads(frames[1][6:])["type"] == "error"


def test_streamed_requests(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"r{k}").mkdir()
        (tmp_path / f"r{k}" / "p.html").write_text(f"<p>{k}</p>")
    got = stream.stream_events(spark, str(tmp_path)).collect()
    assert sorted((r.request_id, r.type) for r in got) == sorted((f"r{k}", t) for k in range(3) for t in ("progress", "result"))
    query = spark.readStream.format("rate").load().writeStream.format("noop").start()
    assert stream.stop(query)


def test_job_store(spark, tmp_path):
    now = [1_000_000.0]
    store = JobStore(spark, str(tmp_path / "jobs"), lambda: now[0])
    one = spark.createDataFrame([("a.x", b"1"), ("b.x", b"2")], "filename string, content binary")
    state = lambda: {r["id"]: r["status"] for r in store.jobs().collect()}
    first = store.submit("ok", "individual", one, 4)
    now[0] += 1
    second, third = store.submit("bad", "consolidated", one), store.submit("gone", "consolidated", one)
    assert len(first) == 32 and set(state().values()) == {"queued"}
    assert store.get(first).first().estimate_sec == 4 + 12 * 4 and store.get(second).first().estimate_sec == 4

    def fine(files, mode):
        now[0] += 10
        return {"n": files.count(), "mode": mode, "confidence": {"pages": [{"engine": "e"}]}}

    def broken(files, mode):
        raise KeyError("x")

    assert run_worker(store, {"ok": fine, "bad": broken}, lambda: False, poll=0) == 3
    assert state() == {first: "done", second: "failed", third: "failed"}
    shown = {r.id: json.loads(r.json) for r in store.public().collect()}
    assert shown[first]["result"]["n"] == 2 and shown[first]["engine_used"] == "e" and shown[first]["elapsed_sec"] == 10.0 and "error_detail" not in shown[first]
    assert shown[second]["error_detail"].startswith("KeyError") and "result" not in shown[second]
    assert "not found" in shown[third]["error_detail"] and store.load_inputs(first).count() == 0
    assert [(r.job_id, r.actual_sec) for r in store.history().collect()] == [(first, 10.0)]
    fourth = store.submit("ok", "individual", one)
    assert store.claim() == fourth and store.claim() is None
    again = JobStore(spark, str(tmp_path / "jobs"), lambda: now[0])  # a new process
    assert again.recover() == 1 and again.recover() == 0 and again.get(fourth).first().error_detail == DIED
    now[0] += 8 * 24 * 3600
    assert again.cleanup() == 4 and again.cleanup() == 0 and again.jobs().count() == 0 and again.history().count() == 0
    assert engine_of_result({"confidence": {"pages": [{"engine": "a"}, {"engine": "b"}]}}) == "mixed" and engine_of_result({}) is None


def test_estimates_of_odd_page_counts(spark):
    jobs = spark.createDataFrame([(-1, False), (0, True), (None, True), (2, True)], "page_count int, ocr_expected boolean")
    past = spark.createDataFrame([], "page_count int, ocr_expected boolean, actual_sec double, finished_at timestamp")
    assert sorted(r.estimate_sec for r in estimates(jobs, past, F.current_timestamp()).collect()) == [4.0, 4.0, 4.0, 94.0]


def test_providers(spark, monkeypatch):
    sheets = spark.createDataFrame([("a.pdf", b"xx"), ("b.pdf", b"")], "filename string, content binary")
    assert {r.error for r in providers.rows(sheets, "words").collect()} == {"RuntimeError: no provider of words is registered"}

    def loader():
        def read(content):
            if not content:
                raise ValueError("empty")
            return [{"page": 1, "pixels": [float(len(content))]}]

        return read

    monkeypatch.setattr(providers, "_LOADERS", {"pixels": loader})
    got = {r.doc: (r.pixels, r.error) for r in providers.rows(sheets, "pixels").collect()}
    assert got == {"a.pdf": ([2.0], None), "b.pdf": (None, "ValueError: empty")} and providers.available() == ["pixels"] and providers.device() == "cpu"
    with pytest.raises(ValueError):
        providers.register("sounds", loader)
    out = engine.structured(sheets)
    assert out.count() == 0
