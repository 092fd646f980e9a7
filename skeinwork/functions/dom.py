"""A tolerant HTML tree builder in plain Python: one regular expression cuts the page into tags, comments and text.

Implied end tags (p, li, dt, dd, option, tr, td, th and their groups), void elements, raw-text elements, stray end
tags and unclosed elements are handled as browsers do for the cases that occur in crawled pages; there is no
adoption agency and no foster parenting.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul"
BLOCK = frozenset((_BLOCK + " body html li dt dd tr td th thead tbody tfoot caption option").split())
_CLOSES_P = frozenset(_BLOCK.split())
#: tag: (open elements that its start ends, elements that stop the search)
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
}
_HEAD_ONLY = frozenset("head title meta link base".split())
#: an end tag does not reach beyond these
_SCOPE = frozenset("table td th caption html".split())


class Node:
    """An element: tag (lower case), attrs (lower-case names, first wins), children (Node or str), parent."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: "Node | None" = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    def get(self, name: str, default: str | None = None) -> str | None:
        return self.attrs.get(name, default)

    def walk(self) -> Iterator["Node"]:
        """This element and all below, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if not isinstance(c, str))

    def find_all(self, *tags: str) -> list["Node"]:
        return [n for n in self.walk() if n.tag in tags and n is not self]

    def first(self, *tags: str) -> "Node | None":
        return next((n for n in self.walk() if n.tag in tags and n is not self), None)

    def text(self, skip: frozenset = frozenset()) -> str:
        """All text below in document order, without elements whose tag is in skip."""
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in skip:
                stack.extend(reversed(node.children))
        return "".join(out)

    def outer_html(self) -> str:
        out: list[str] = []
        stack: list = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                out.append(node[0])
            elif isinstance(node, str):
                out.append(_html.escape(node, quote=False))
            else:
                attrs = "".join(f' {k}="{_html.escape(v)}"' for k, v in node.attrs.items())
                out.append(f"<{node.tag}{attrs}>")
                if node.tag not in VOID:
                    stack.append((f"</{node.tag}>",))
                    if node.tag in ("script", "style"):
                        out.append("".join(c for c in node.children if isinstance(c, str)))
                    else:
                        stack.extend(reversed(node.children))
        return "".join(out)

    def inner_html(self) -> str:
        return "".join(_html.escape(c, quote=False) if isinstance(c, str) else c.outer_html() for c in self.children)


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(text):
        value = a or b or c
        out.setdefault(name.lower(), _html.unescape(value) if "&" in value else value)
    return out


def parse(page: str | None) -> Node:
    """The html element of a page; an empty one for null and empty pages."""
    root = Node("html")
    open_: list[Node] = [root]
    page = page or ""
    at = 0

    def add_text(text: str) -> None:
        if text:
            open_[-1].children.append(_html.unescape(text) if "&" in text else text)

    def close_to(k: int) -> None:
        del open_[k:]

    for m in iter(lambda: _TOKEN.search(page, at), None):
        add_text(page[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        tag = name.lower()
        if m.group(1):  # an end tag
            if tag in ("html", "body"):
                continue
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == tag:
                    close_to(k)
                    break
                if open_[k].tag in _SCOPE and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                    break
            continue
        rest = m.group(3)
        attrs = attributes(rest) if rest and not rest.isspace() else {}
        if tag == "html":
            for key, value in attrs.items():
                root.attrs.setdefault(key, value)
            continue
        if len(open_) > 1 and open_[1].tag == "head" and tag not in _HEAD_ONLY and tag not in ("script", "style", "noscript", "template") and not any(n.tag in ("noscript", "template") for n in open_):
            close_to(1)
        if tag == "body" and (known := next((c for c in root.children if isinstance(c, Node) and c.tag == "body"), None)):
            for key, value in attrs.items():
                known.attrs.setdefault(key, value)
            continue
        if tag in _CLOSES_P:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == "p":
                    close_to(k)
                    break
                if open_[k].tag in BLOCK:
                    break
        if tag in _ENDS:
            ended, stop = _ENDS[tag]
            k = len(open_) - 1
            cut = None
            while k > 0 and open_[k].tag not in stop:
                if open_[k].tag in ended:
                    cut = k
                k -= 1
            if cut is not None:
                close_to(cut)
        if len(open_) == 1 and tag not in _HEAD_ONLY and tag not in ("body", "head", "frameset") and not (tag in ("script", "style") and not any(isinstance(c, Node) and c.tag == "body" for c in root.children)):
            body = next((c for c in root.children if isinstance(c, Node) and c.tag == "body"), None)
            if body is None:
                body = Node("body", parent=root)
                root.children.append(body)
            open_.append(body)
        node = Node(tag, attrs, open_[-1])
        open_[-1].children.append(node)
        if tag in VOID:
            continue
        if rest.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            text = page[at : end.start() if end else len(page)]
            if text:
                node.children.append(_html.unescape(text) if tag in ("title", "textarea") and "&" in text else text)
            at = end.end() if end else len(page)
            continue
        if len(open_) < 512:  # deeper elements are siblings, so no page can exhaust the stack
            open_.append(node)
    add_text(page[at:])
    return root
