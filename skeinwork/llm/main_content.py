"""The main body of a page, by layout-aware rendering.

The page's tree is rendered as a reader would see it: elements that are not shown (scripts, styles, noscript, templates,
hidden ones) vanish, block elements end lines, list items get a dash, the cells of data tables are aligned in columns.
Each rendered block remembers the element it stands in. The main body is the element that directly holds the most
running text: blocks of a list or a quotation count for the element around them, link text counts nothing, and
elements marked as navigation, banner, side matter or footer are left out while others remain.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.dom import BLOCK, Node, parse

# fixed values: elements never shown, and marks of side matter
UNSEEN = frozenset("script style noscript template head title meta link base svg iframe object datalist select textarea".split())
SIDE_TAGS = frozenset("nav header footer aside dialog".split())
SIDE_ROLES = frozenset("navigation banner complementary contentinfo dialog alertdialog search menu menubar".split())
_INNER = frozenset("p ul ol li dl dt dd blockquote pre h1 h2 h3 h4 h5 h6 figure figcaption address center details summary table caption thead tbody tfoot tr hr small form fieldset menu dir".split())

_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")


def shown(node: Node) -> bool:
    if node.tag in UNSEEN or "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true":
        return False
    style = node.attrs.get("style")
    return not (style and _HIDDEN.search(style))


class Block:
    """A rendered block: its text, the element it stands in, the characters of it that are link text, list mark, cells."""

    __slots__ = ("text", "node", "linked", "mark", "cells")

    def __init__(self, text: str, node: Node, linked: int = 0, mark: str = "", cells: list[str] | None = None):
        self.text, self.node, self.linked, self.mark, self.cells = text, node, linked, mark, cells


def blocks_of(root: Node) -> list[Block]:
    """The visible blocks of a tree in reading order."""
    out: list[Block] = []
    parts: list[str] = []
    state = {"linked": 0, "mark": ""}

    def flush(node: Node) -> None:
        text = "".join(parts)
        parts.clear()
        if text and not text.isspace():
            if any(n.tag == "pre" for n in _up(node)):
                text = text.strip("\r\n")
            else:
                text = _SPACE.sub(" ", text).strip()
            out.append(Block(text, node, state["linked"], state["mark"]))
            state["mark"] = ""
        state["linked"] = 0

    # an explicit stack: (node, None) enters, (node, "end") leaves; (rows, "rows") are those of a data table
    stack: list[tuple] = [(root, None, False, root)]
    while stack:
        node, phase, in_link, block = stack.pop()
        if isinstance(node, str):
            parts.append(node)
            if in_link:
                state["linked"] += len(node.strip())
            continue
        if phase == "end":
            flush(node)
            continue
        if phase == "rows":
            flush(block)
            for cells in node:
                text = " ".join(c for c in cells if c)
                if text:
                    out.append(Block(text, block, 0, "", cells))
            continue
        if not shown(node):
            continue
        if node.tag == "br":
            flush(block)
            continue
        is_block = node.tag in BLOCK
        if is_block:
            flush(block)
            if node.tag == "li":
                state["mark"] = "- "
            if node.tag == "table" and (parted := _data_table(node)) is not None:
                rows, rest = parted
                stack.append((rows, "rows", in_link, node))
                for child in reversed(rest):
                    stack.append((child, None, in_link, node))
                continue
            stack.append((node, "end", in_link, node))
        inner = node if is_block else block
        linked = in_link or node.tag == "a"
        for child in reversed(node.children):
            stack.append((child, None, linked, inner))
    flush(root)
    return out


def _up(node: Node) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def _shown_text(node: Node) -> str:
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif shown(n):
            stack.extend(reversed(n.children))
    return "".join(out)


def _data_table(table: Node) -> tuple[list[list[str]], list] | None:
    """The shown cells of a table that holds data, and what stands in it outside its cells (caption, stray text).

    None for a table that lays out the page (blocks or spans in its cells).
    """
    rows: list[list[str]] = []
    rest: list = []
    stack = list(reversed(table.children))
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            rest.append(part)
        elif not shown(part):
            continue
        elif part.tag == "tr":
            cells = []
            for cell in part.children:
                if isinstance(cell, str) or cell.tag not in ("td", "th"):
                    rest.append(cell)
                elif shown(cell):
                    if any(n.tag in BLOCK for n in cell.walk() if n is not cell):
                        return None
                    cells.append(_SPACE.sub(" ", _shown_text(cell)).strip())
            rows.append(cells)
        elif part.tag != "caption" and part.first("tr") is not None:
            stack.extend(reversed(part.children))
        else:
            rest.append(part)
    return rows, rest


def _container(node: Node) -> Node:
    """The element that a block's text counts for."""
    while node.parent is not None and node.tag in _INNER:
        node = node.parent
    return node


def _is_side(node: Node) -> bool:
    return any(n.tag in SIDE_TAGS and not (n.tag == "header" and n.parent is not None and n.parent.tag == "article") or (n.attrs.get("role") or "").lower() in SIDE_ROLES for n in _up(node))


def main_element(blocks: list[Block]) -> Node | None:
    """The element that holds the main body; None for a page without visible text."""
    weight: dict[int, float] = {}
    nodes: dict[int, Node] = {}
    for b in blocks:
        c = _container(b.node)
        nodes[id(c)] = c
        own = max(0, len(b.text) - b.linked)
        weight[id(c)] = weight.get(id(c), 0) + (own if own > 0 else 0) * (1.0 if own >= 40 or b.linked == 0 else 0.2)
    if not weight:
        return None
    best = [k for k in weight if not _is_side(nodes[k])] or list(weight)
    marked = [k for k in best if any(n.tag in ("article", "main") or (n.attrs.get("role") or "") == "main" for n in _up(nodes[k]))]
    titled = {id(_container(b.node)) for b in blocks if b.node.tag == "h1"}
    pool = marked or best
    return nodes[max(pool, key=lambda k: (weight[k] + (200 if k in titled else 0), -list(weight).index(k)))]


def within(node: Node, main: Node) -> bool:
    return any(n is main for n in _up(node))


def _aligned(rows: list[list[str]]) -> list[str]:
    width = max(len(r) for r in rows)
    sizes = [max((len(r[k]) for r in rows if k < len(r)), default=0) for k in range(width)]
    return ["  ".join(c.ljust(sizes[k]) for k, c in enumerate(r)).rstrip() for r in rows]


def render(blocks: list[Block]) -> str:
    """Blocks as text: a blank line between blocks, none between items of a list and rows of a table."""
    out: list[str] = []
    k = 0
    while k < len(blocks):
        b = blocks[k]
        if b.cells is not None:
            end = k
            while end < len(blocks) and blocks[end].node is b.node and blocks[end].cells is not None:
                end += 1
            out.append("\n".join(_aligned([x.cells for x in blocks[k:end]])))
            k = end
            continue
        line = b.mark + b.text
        if b.mark and k and blocks[k - 1].mark and out:
            out[-1] += "\n" + line
        else:
            out.append(line)
        k += 1
    return "\n\n".join(out)


def main_text(page: str | None) -> str | None:
    """The main body of a page as text; null for null, empty or text-less pages."""
    if not page:
        return None
    blocks = blocks_of(parse(page))
    main = main_element(blocks)
    if main is None:
        return None
    return render([b for b in blocks if within(b.node, main)]) or None


#: How extractors join the items of a list to a line.
SEPARATORS = (" · ", " | ", " - ", " / ", " > ", ", ", " ")

_BULLET = re.compile(r"^(?:[-*•]|\d+[.)]|#{1,6})\s+")


def line_key(line: str) -> int:
    """What a line has in common with the block it was made from: hash without list marks and runs of spaces."""
    return xxhash.xxh64_intdigest(_BULLET.sub("", _SPACE.sub(" ", line).strip())) - (1 << 63)


def page_lines(blocks: list[Block], main: Node | None) -> tuple[set[int], set[int]]:
    """Keys of the lines within and outside the main body; lists outside also joined the ways extractors join them."""
    inside: set[int] = set()
    outside: set[int] = set()
    lists: dict[int, list[str]] = {}
    for b in blocks:
        into = inside if main is None or within(b.node, main) else outside
        into.update(line_key(x) for x in b.text.split("\n") if x.strip())
        if into is outside and b.mark:
            lists.setdefault(id(b.node.parent), []).append(b.text)
    for items in lists.values():
        outside.update(line_key(sep.join(items)) for sep in SEPARATORS)
    return inside, outside - inside


def page_sides(pages: DataFrame) -> DataFrame:
    """``url, page_id, outside`` (line keys from outside the main body) of pages (url, page_id, html) with an address and html."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for u, p, h in zip(pdf["url"], pdf["page_id"], pdf["html"]):
                blocks = blocks_of(parse(h))
                rows.append((u, p, list(page_lines(blocks, main_element(blocks))[1])))
            yield pd.DataFrame(rows, columns=["url", "page_id", "outside"])

    own = pages.filter(F.col("url").isNotNull() & (F.length("html") > 0)).select("url", "page_id", "html")
    return own.mapInPandas(read, "url string, page_id long, outside array<long>")


def foreign_lines(docs: DataFrame, sides: DataFrame) -> DataFrame:
    """``uid, line_no`` of the lines of docs (uid, url, rec_id, content) from outside the main body of the page of their url.

    sides: url, page_id, outside (see ``page_sides``). Of several deliveries the one of the least id counts, of pages the first with html. Each
    side is reduced to hashes of its lines before the join, so no page or text is shuffled. Null contents, urls and
    pages give nothing; blank lines are no lines.
    """

    def read_docs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r, u, url, t in zip(pdf["rec_id"], pdf["uid"], pdf["url"], pdf["content"]):
                lines = [(k, line_key(x)) for k, x in enumerate(t.split("\n")) if x.strip()]
                rows.append((r, u, url, [k for k, _ in lines], [h for _, h in lines]))
            yield pd.DataFrame(rows, columns=["rec_id", "uid", "url", "nos", "keys"])

    sides = sides.groupBy("url").agg(F.min_by("outside", "page_id").alias("outside"))
    texts = docs.filter(F.col("content").isNotNull() & F.col("url").isNotNull()).select("rec_id", "uid", "url", "content")
    lines = texts.mapInPandas(read_docs, "rec_id long, uid string, url string, nos array<int>, keys array<long>")
    lines = lines.groupBy("uid").agg(F.min_by(F.struct("url", "nos", "keys"), "rec_id").alias("d")).select("uid", "d.*")
    met = lines.join(sides, "url")
    hit = F.filter(F.arrays_zip("nos", "keys"), lambda x: F.array_contains("outside", x["keys"]))
    return met.select("uid", F.explode(hit).alias("x")).select("uid", F.col("x.nos").alias("line_no"))
