"""Trees of web pages, and the passes that turn one into Markdown.

A node holds its text and its child nodes in one list of contents, so removing a node leaves
the text behind it where it is. The passes run in the order of ``markdown_of``; each
works on one tree in place, inside an Arrow batch of whole pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

# Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# Elements that never hold content of the page.
NO_CONTENT = {
    "script", "style", "noscript", "iframe", "svg", "object", "embed",
    "video", "audio", "canvas", "map", "input", "select",
    "textarea", "button",
}
# Elements of the page's frame.
CHROME = {"nav", "footer", "aside", "header"}
# Parts of a class or id, in any case, that mark what is not content.
NOISE = [
    "sidebar", "breadcrumb", "cookie", "menu", "pagination", "toolbar",
    "social-share", "share-buttons", "related-posts", "advertisement",
    "ad-wrapper", "sticky-header", "sticky-footer", "popup", "modal",
    "banner", "toast", "notification", "skip-nav", "back-to-top",
    "announcement", "search-dropdown", "radio-container", "search-source",
    "printer", "print-preview", "icon_printer", "icon_ask_question",
    "linkAskQuestion", "webchat", "footerContainer", "return-to-top",
    "navbar-header", "nav-group", "headerTitle", "rss-feed",
    "aspNetHidden",
]
# Parts of a class that mark the content of a page.
CONTENT = [
    "content-wrapper", "theme-content", "article-content", "post-content",
    "entry-content", "main-content", "page-content", "content-body",
    "content-area", "content-main", "rich-text", "field-body",
]
# Blocks that make a table cell look like layout.
CELL_BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "blockquote", "article", "section"}
# Elements that never become headings, those that may, and those on lines of their own.
NO_HEADING = {"a", "td", "th", "li", "label", "figcaption", "caption", "h1", "h2", "h3", "h4", "h5", "h6"}
MAY_BE_HEADING = {"div", "span", "p", "font", "b", "strong"}
LINE_BLOCKS = {"div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "section", "article", "header"}
FORMATS = {"strong", "b", "u", "em", "i", "span", "font"}
# Fixed value: an image of fewer bytes is an icon.
LEAST_IMAGE = 5000

_NOISE = re.compile("|".join(map(re.escape, NOISE)), re.IGNORECASE)
_CONTENT = re.compile("|".join(map(re.escape, CONTENT)), re.IGNORECASE)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_SIZE = re.compile(r"font-size\s*:\s*([\d.]+)\s*(px|pt|em|rem)", re.IGNORECASE)
_WEIGHT = re.compile(r"font-weight\s*:\s*(bold|[7-9]\d{2})", re.IGNORECASE)
_BLOCK = re.compile(r"display\s*:\s*block", re.IGNORECASE)
_INDENT = re.compile(r"(?:margin|padding)-left\s*:\s*[\d.]+\s*(?:px|pt|em|rem)", re.IGNORECASE)
_NUMBERING = re.compile(r"^(\d+\.?\d*\.?|[a-zA-Z][.)]\s*|[ivxIVX]+[.)]\s*)$")
_BULLETS = "•‣◦⁃∙●○–—-"
_MARKER = re.compile(rf"^\s*(?:[{_BULLETS}]|\d+[.)]\s|[a-zA-Z][.)]\s|[ivxIVX]+[.)]\s)\s*")
_MARKER_CUT = re.compile(rf"^\s*(?:[{_BULLETS}]|\d+[.)]\s?|[a-zA-Z][.)]\s?|[ivxIVX]+[.)]\s?)\s*")
_ZERO_WIDTH = dict.fromkeys(map(ord, "​‌‍﻿"))


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    kids: list = field(default_factory=list)

    def get(self, name: str) -> str:
        return self.attrs.get(name, "")

    def nodes(self) -> list[Node]:
        return [k for k in self.kids if isinstance(k, Node)]

    def walk(self) -> Iterator[Node]:
        """This node and all below it, in the order of the page."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(reversed(node.nodes()))

    def find(self, tag: str) -> Node | None:
        return next((n for n in self.walk() if n.tag == tag and n is not self), None)

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            item = todo.pop()
            if isinstance(item, str):
                out.append(item)
            else:
                todo.extend(reversed(item.kids))
        return "".join(out)

    def lead(self) -> str:
        """The text before the first child node."""
        out = []
        for k in self.kids:
            if isinstance(k, Node):
                break
            out.append(k)
        return "".join(out)


#: What a start tag ends if it is open: the tags, and those that the search does not pass.
_ENDS = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
_ENDS |= dict.fromkeys(["tbody", "thead", "tfoot"], ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}))
_NO_P = "p div ul ol dl table h1 h2 h3 h4 h5 h6 blockquote pre section article aside header footer nav main form hr figure address fieldset".split()
_ENDS |= dict.fromkeys(_NO_P, ({"p"}, {"td", "th", "li", "div", "table", "blockquote", "article", "section", "body"}))


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#page")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        ended, walls = _ENDS.get(tag, ((), ()))
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag in ended:
                if tag not in ("tr", "tbody", "thead", "tfoot"):
                    del self.open[depth:]
                    break
                del self.open[depth:]
            elif self.open[depth].tag in walls:
                break
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].kids.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        self.open[-1].kids.append(data)


def parse(page: str) -> Node:
    """The tree of a page; comments are left out, what is never closed ends with the page."""
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.root


def strip_noise(node: Node) -> None:
    """Takes out scripts, page frame, hidden and noisy nodes; forms go and leave their contents."""
    kept, removed = [], False
    for kid in node.kids:
        if isinstance(kid, str):
            if not removed or kid.strip():
                kept.append(kid)
            continue
        marks = f"{kid.get('class')} {kid.get('id')}"
        removed = kid.tag in NO_CONTENT or kid.tag in CHROME or bool(_HIDDEN.search(kid.get("style"))) or bool(_NOISE.search(marks))
        if not removed:
            strip_noise(kid)
            kept.extend(kid.kids if kid.tag == "form" else [kid])
    node.kids = kept


def content_root(root: Node) -> Node:
    """The node that holds the page's content: the first with a content class and over 40 % of the text, else the
    deepest with over 60 % that is no part of a table or list."""
    whole = len(root.text().strip())
    if whole < 100:
        return root
    for node in root.walk():
        if node.get("class") and _CONTENT.search(node.get("class")) and len(node.text().strip()) > 0.4 * whole:
            return node
    best, depth_of_best = root, 0
    todo = [(root, 0)]
    while todo:
        node, depth = todo.pop()
        if len(node.text().strip()) > 0.6 * whole:
            if depth > depth_of_best and node.tag not in ("td", "th", "tr", "li", "thead", "tbody", "tfoot"):
                best, depth_of_best = node, depth
            todo.extend((kid, depth + 1) for kid in reversed(node.nodes()))
    return best


def own_rows(table: Node) -> list[Node]:
    """A table's rows without those of tables in it: direct ones, then those of heads, then of bodies."""
    found = [k for k in table.nodes() if k.tag == "tr"]
    for part in ("thead", "tbody"):
        found += [r for k in table.nodes() if k.tag == part for r in k.nodes() if r.tag == "tr"]
    return found


def own_cells(row: Node) -> list[Node]:
    return [k for k in row.nodes() if k.tag == "td"] + [k for k in row.nodes() if k.tag == "th"]


def _blank(text: str) -> bool:
    return not text.strip().replace("\xa0", "")


def table_figures(table: Node) -> dict[str, float]:
    """Rows, mean number of cells, and of the cells: number, shares empty and with blocks, mean text length."""
    rows = own_rows(table)
    cells = [c for r in rows for c in own_cells(r)]
    texts = [c.text().strip() for c in cells]
    n = max(1, len(cells))
    return {
        "rows": len(rows),
        "cells": len(cells),
        "columns": len(cells) / max(1, len(rows)),
        "empty": sum(map(_blank, texts)) / n,
        "blocks": sum(any(k.tag in CELL_BLOCKS for k in c.nodes()) for c in cells) / n,
        "text": sum(map(len, texts)) / n,
    }


def is_layout_table(table: Node) -> bool:
    """Whether a table only places things: by its role, its figures and border; one with header cells holds data."""
    if table.get("role").lower() in ("presentation", "none"):
        return True
    if any(k.tag == "th" for r in own_rows(table) for k in r.nodes()):
        return False
    f = table_figures(table)
    if not f["rows"] or f["columns"] < 1.5:
        return True
    crowded = f["columns"] <= 3 and f["blocks"] > 0.4
    sparse = f["cells"] > 4 and f["empty"] > 0.4
    frameless = table.get("border") == "0" and f["rows"] > 5
    return sparse or frameless or crowded or f["text"] > 200


def _contents(cell: Node) -> list:
    """What a cell holds: its contents without leading white space, or its bare text."""
    if not cell.nodes():
        return [cell.text().strip()]
    return cell.kids if cell.lead().strip() else cell.kids[next(k for k, x in enumerate(cell.kids) if isinstance(x, Node)) :]


def _unwrapped(table: Node) -> Node:
    out = Node("div")
    for row in own_rows(table):
        full = [(c, c.text().strip()) for c in own_cells(row)]
        full = [(c, t) for c, t in full if c.find("img") or not _blank(t)]
        if len(full) > 1 and len(full[0][1]) <= 10 and _NUMBERING.match(full[0][1]):
            number = full[0][1]
            number += " " if number[-1] in ".)" else ". "
            rest = list(_contents(full[1][0]))
            if rest and isinstance(rest[0], str):
                rest[0] = rest[0].lstrip()
            extra = [Node("div", {}, list(_contents(c))) for c, _ in full[2:]]
            out.kids.append(Node("div", {}, [number, *rest, *extra]))
        else:
            out.kids += [Node("div", {}, list(_contents(c))) for c, _ in full]
    return out


def unwrap_layout_tables(root: Node, passes: int = 10) -> None:
    """Layout tables become blocks in reading order: empty rows go, a cell that numbers its row leads the next one."""
    for _ in range(passes):
        layout = {id(n) for n in root.walk() if n.tag == "table" and n is not root and is_layout_table(n)}
        if not layout:
            return
        todo = [root]
        while todo:
            node = todo.pop()
            node.kids = [_unwrapped(k) if id(k) in layout else k for k in node.kids]
            todo.extend(node.nodes())


def font_px(node: Node) -> float | None:
    found = _SIZE.search(node.get("style"))
    if not found:
        return None
    return float(found[1]) * {"px": 1.0, "pt": 1.333}.get(found[2].lower(), 16.0)


def heading_tiers(sizes: list[float], tolerance: float = 2.0, levels: int = 4) -> list[tuple[float, int]]:
    """(size, level): the largest size opens level 1; one more than ``tolerance`` below a level's first opens the next."""
    down = sorted(set(sizes), reverse=True)
    tiers: list[float] = []
    for s in down:
        if not tiers or tiers[-1] - s > tolerance:
            tiers.append(s)
    level: dict[float, int] = {}
    for k, tier in enumerate(tiers[:levels], 1):
        level |= {s: k for s in down if abs(s - tier) <= tolerance}
    return list(level.items())


def _bold(node: Node) -> bool:
    return node.tag in ("b", "strong") or bool(_WEIGHT.search(node.get("style")))


def _all_bold(node: Node, text: str) -> bool:
    """Whether no text stands outside child nodes at first and four fifths of it is in bold nodes."""
    if node.lead().strip():
        return False
    return sum(len(n.text().strip()) for n in node.walk() if n.tag in ("b", "strong")) >= 0.8 * len(text)


def _line_block(node: Node) -> bool:
    return node.tag in LINE_BLOCKS or bool(_BLOCK.search(node.get("style")))


def _dissolve(node: Node, tags: set[str]) -> None:
    """Replaces nodes of ``tags`` below ``node`` by their contents."""
    out = []
    for kid in node.kids:
        if isinstance(kid, Node):
            _dissolve(kid, tags)
        out.extend(kid.kids if isinstance(kid, Node) and kid.tag in tags else [kid])
    node.kids = out


def infer_headings(root: Node) -> None:
    """Short nodes in large type become headings by size, short bold lines headings below those."""
    sizes = []
    for n in root.walk():
        px = font_px(n) if n.tag not in NO_HEADING else None
        if px and px > 14 and 0 < len(n.text().strip()) < 200:
            sizes.append(px)
    tiers = heading_tiers(sizes)
    deepest = max((k for _, k in tiers), default=0)
    bold_level = min(deepest + 1, 5) if deepest else 2
    chosen = []
    todo = [(root, None)]
    while todo:
        node, parent = todo.pop()
        todo.extend((k, node) for k in reversed(node.nodes()))
        if node.tag not in MAY_BE_HEADING:
            continue
        text = node.text().strip()
        if not 0 < len(text) <= 200:
            continue
        px = font_px(node)
        level = next((k for s, k in tiers if abs(px - s) <= 2), None) if px else None
        if level is None and len(text) < 100 and _line_block(node) and (_bold(node) or _all_bold(node, text)):
            emphasis = parent is not None and parent.tag == "p" and len(parent.text()) > 2 * len(text)
            level = None if emphasis else bold_level
        if level:
            chosen.append((node, level))
    for node, level in chosen:
        node.tag = f"h{level}"
        for name in ("style", "class", "align"):
            node.attrs.pop(name, None)
        _dissolve(node, FORMATS)


def split_at_breaks(root: Node) -> None:
    """Two or more line breaks with nothing but white space between them become one paragraph break."""
    for node in list(root.walk()):
        out, held = [], []

        def flush(out=out, held=held):
            breaks = [x for x in held if isinstance(x, Node)]
            out.extend([Node("p")] if len(breaks) > 1 else held)
            held.clear()

        for kid in node.kids:
            if isinstance(kid, Node) and kid.tag == "br" or held and isinstance(kid, str) and not kid.strip():
                held.append(kid)
            else:
                flush()
                out.append(kid)
        flush()
        node.kids = out


def infer_lists(root: Node) -> None:
    """Two or more indented siblings in a row that start with list markers become a list."""
    for node in list(root.walk()):
        runs, run = [], []
        for kid in node.nodes():
            if _INDENT.search(kid.get("style")) and _MARKER.match(kid.text().strip()):
                run.append(kid)
            else:
                runs.append(run)
                run = []
        for items in [*runs, run]:
            if len(items) < 2:
                continue
            ordered = re.match(r"\d+[.)]\s", items[0].text().strip())
            entries = [Node("li", {}, [_MARKER_CUT.sub("", k.text().strip(), count=1).strip()]) for k in items]
            at = next(k for k, x in enumerate(node.kids) if x is items[0])
            gone = set(map(id, items))
            before, after = node.kids[:at], [x for x in node.kids[at:] if id(x) not in gone]
            node.kids = [*before, Node("ol" if ordered else "ul", {}, entries), *after]


def _plain(text: str) -> str:
    return re.sub(r"[^\S\n]+", " ", text.replace("\xa0", " ").translate(_ZERO_WIDTH))


def normalise(root: Node, passes: int = 3) -> None:
    """Underlined becomes bold, white space plain, and nodes without contents go, but for void ones, cells and items."""
    for node in root.walk():
        if node.tag == "u":
            node.tag = "strong"
        node.kids = [_plain(k) if isinstance(k, str) else k for k in node.kids]
    for _ in range(passes):
        empty = {id(n) for n in root.walk() if n.tag not in VOID | {"td", "th", "li"} and not n.nodes() and not n.text().strip()}
        for node in list(root.walk()):
            node.kids = [k for k in node.kids if id(k) not in empty]


def url_core(url: str) -> str:
    return url.split("?")[0].split("#")[0].rstrip("/").lower()


def describe_images(root: Node, images: list[tuple[str, int]]) -> None:
    """Images become notes if an archive part (location, bytes) of theirs, the first that fits, is no icon; others go."""
    for node in list(root.walk()):
        out = []
        for kid in node.kids:
            if isinstance(kid, Node) and kid.tag == "img":
                src = kid.get("src")
                fits = (size for at, size in images if src.startswith(at) or at.startswith(src) or url_core(src) == url_core(at))
                if next(fits, 0) >= LEAST_IMAGE:
                    out.append(Node("p", {}, [f"[{kid.get('alt').strip() or 'Figure'} — not converted]"]))
            else:
                out.append(kid)
        node.kids = out


# Markdown ------------------------------------------------------------------------------------

_PARAGRAPHS = {"p", "div", "article", "section", "main", "body", "center", "figure", "address", "dl", "dt", "dd", "fieldset", "figcaption", "details", "summary"}


def _marked(text: str, mark: str) -> str:
    text = re.sub(r"(?:\\\n\s*)+$", " ", text)  # a line break at the end of a mark breaks nothing
    inner = text.strip()
    if not inner:
        return text
    lead, tail = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
    return f"{' ' if lead else ''}{mark}{inner}{mark}{' ' if tail else ''}"


def _table(node: Node) -> str:
    rows = [r for k in [node, *[n for n in node.nodes() if n.tag in ("thead", "tbody", "tfoot")]] for r in k.nodes() if r.tag == "tr"]
    lines = []
    for k, row in enumerate(rows):
        cells = [c for c in row.nodes() if c.tag in ("td", "th")]
        texts = [re.sub(r"\s*\n\s*", " ", write(c, cell=True).strip()) for c in cells]
        rule = "| " + " | ".join(["---"] * max(1, len(cells))) + " |"
        line = "| " + " | ".join(texts) + " |"
        if k == 0 and all(c.tag == "th" for c in cells):
            lines += [line, rule]
        elif k == 0:
            lines += ["| " + " | ".join([""] * len(cells)) + " |", rule, line]
        else:
            lines.append(line)
    return "\n\n" + "\n".join(lines) + "\n\n"


def _items(node: Node, ordered: bool) -> str:
    out, number = [], int(node.get("start")) if node.get("start").isdigit() else 1
    for kid in node.nodes():
        if kid.tag != "li":
            out.append(write(kid).strip())
            continue
        mark = f"{number}. " if ordered else "- "
        number += 1
        text = re.sub(r"\n{2,}", "\n", write(kid).strip())
        out.append(mark + text.replace("\n", "\n" + " " * len(mark)))
    return "\n\n" + "\n".join(out) + "\n\n"


def _one(node: Node, cell: bool) -> str:
    tag = node.tag
    if tag == "br":
        return " " if cell else "\\\n"
    if tag == "hr":
        return "\n\n---\n\n"
    if tag in ("head", "title", "img", "script", "style"):
        return ""
    if tag == "table":
        return _table(node)
    if tag in ("ul", "ol"):
        return _items(node, tag == "ol")
    if tag == "pre":
        return f"\n\n```\n{node.text().strip(chr(10))}\n```\n\n"
    if tag in ("code", "kbd", "samp"):
        return _marked(node.text(), "`")
    text = write(node, cell)
    if re.fullmatch("h[1-6]", tag):
        line = re.sub(r"\s+", " ", text.replace("\\\n", " ")).strip()
        return f"\n\n{'#' * int(tag[1])} {line}\n\n" if line else ""
    if tag in ("b", "strong"):
        return _marked(text, "**")
    if tag in ("i", "em"):
        return _marked(text, "*")
    if tag in ("del", "s"):
        return _marked(text, "~~")
    if tag == "a":
        href = node.get("href").strip()
        if not href or href.startswith(("#", "javascript:")):
            return text
        return href if text.strip() == href else f"[{text.strip()}]({href})"
    if tag == "blockquote":
        return "\n\n" + "\n".join(f"> {x}".rstrip() for x in text.strip().split("\n")) + "\n\n"
    if tag in _PARAGRAPHS:
        return f"\n\n{text.strip()}\n\n"
    return text


def write(node: Node, cell: bool = False) -> str:
    """Markdown of a node's contents; marks in the text are escaped."""
    out = []
    for kid in node.kids:
        if isinstance(kid, Node):
            out.append(_one(kid, cell))
        else:
            text = re.sub(r"[ \t]+", " ", re.sub(r"[ \t\r\n]*[\r\n][ \t\r\n]*", "\n", kid))
            if not text.strip() and (not out or out[-1].endswith("\n")):
                continue
            out.append(re.sub(r"([*_])", r"\\\1", text))
    return "".join(out)


def body_of(page: Node) -> Node:
    """The part of a page to convert: its body, or the main or article part that holds over half of the body's text."""
    body = page.find("body") or page
    for tag in ("main", "article"):
        part = body.find(tag)
        if part is not None and len(part.text()) > 0.5 * len(body.text()):
            return part
    return body


def cleaned(page: str, images: list[tuple[str, int]] = ()) -> Node:
    root = body_of(parse(page))
    strip_noise(root)
    unwrap_layout_tables(root)
    root = content_root(root)
    infer_headings(root)
    split_at_breaks(root)
    infer_lists(root)
    normalise(root)
    describe_images(root, list(images))
    return root


def markdown_of(page: str, images: list[tuple[str, int]] = ()) -> str:
    """Markdown of a page before the clean-up of blank lines."""
    root = cleaned(page, images)
    return _one(root, False)


# Names of head entries and the metadata they fill, the first of each counting.
_HEAD = {
    "description": "description",
    "og:description": "description",
    "og:site_name": "site_name",
    "og:title": "title",
    "og:url": "source",
    "author": "author",
    "date": "published",
    "article:published_time": "published",
    "dcterms.date": "published",
}


def head_metadata(page: Node, known: dict[str, str]) -> dict[str, str]:
    """``known`` with what the page's head adds: the title if it is shorter, entries not known yet, the site by its address."""
    meta = dict(known)
    title = page.find("title")
    title = title.lead().strip() if title is not None else ""
    if title and ("title" not in meta or len(title) < len(meta["title"])):
        meta["title"] = title
    for node in page.walk():
        key = _HEAD.get((node.get("name") or node.get("property")).lower()) if node.tag == "meta" else None
        if key and node.get("content").strip():
            meta.setdefault(key, node.get("content").strip())
    links = (n.get("href").strip() for n in page.walk() if n.tag == "link" and n.get("rel") == "canonical" and n.get("href"))
    if "source" not in meta and (link := next(links, "")):
        meta["source"] = link
    if "site_name" not in meta and (host := re.match(r"https?://(?:www\.)?([^/]+)", meta.get("source", ""))):
        meta["site_name"] = host[1]
    return meta
