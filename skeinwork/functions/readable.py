"""Main text by element scores, heading blocks, reduced HTML and Markdown of a page tree."""

from __future__ import annotations

import re

from skeinwork.functions.dom import VOID, Node
from skeinwork.functions.selectors import first_of_each

# fixed values: elements without content, and words in class and id that speak for and against content
SKIPPED = frozenset("head script style noscript iframe svg nav footer header aside form button input select textarea".split())
NEGATIVE = "sidebar nav navigation menu footer header comment comments ad ads advertisement social share related recommended popular trending breadcrumb pagination widget".split()
POSITIVE = "article content main post entry text body story".split()
ROOTS = ["article", "main", "[role='main']", "[role='article']", ".article", ".post", ".content", "#content", "#main", ".entry-content", ".post-content"]
GARBAGE = ["self.__next_f", "__next_f.push", "self.__next_data", "$Sreact.", '"$undefined"', "static/chunks/"]
MIN_PARAGRAPH, MIN_ROOT, MIN_SCORE = 25, 200, 50.0
BLOCK_SKIPPED = frozenset("script style nav footer header aside noscript iframe svg canvas form button input select textarea".split())
BLOCK_ROOTS = ["main", "article", "[role='main']", "#content", "#main", ".content", ".main", "body"]
KEPT = frozenset("h1 h2 h3 h4 h5 h6 p blockquote hr br a img ul ol li pre code table thead tbody tr td th strong em b i".split())
STRIPPED = frozenset("script style noscript svg head".split())
BOILERPLATE = frozenset("nav footer header aside".split())
_LEAVES = frozenset("p div section article blockquote li".split())
_HEADINGS = {f"h{k}": k for k in range(1, 7)}


def _bytes(text: str) -> int:
    return len(text.encode())


def _unwanted(node: Node) -> bool:
    name = node.attrs.get("class", "").lower()
    return node.tag in SKIPPED or any(w in name for w in NEGATIVE)


def element_text(root: Node) -> str:
    """The text of an element: paragraphs, sections and list items are leaves, headings get their signs, code its fences."""
    parts: list[str] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if _unwanted(node):
            continue
        text = None
        if node.tag in _LEAVES:
            text = node.text(SKIPPED).strip()
            text = text if _bytes(text) >= MIN_PARAGRAPH else ""
        elif node.tag in _HEADINGS:
            own = node.text(SKIPPED).strip()
            text = own and "#" * _HEADINGS[node.tag] + " " + own
        elif node.tag in ("ul", "ol"):
            parts += [f"- {own}" for li in node.find_all("li") if (own := li.text(SKIPPED).strip())]
            continue
        elif node.tag in ("pre", "code"):
            own = node.text(SKIPPED).strip()
            text = own and f"```\n{own}\n```"
        if text is None:
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
        elif text:
            parts.append(text)
    return "\n\n".join(parts)


def content_score(node: Node) -> float:
    """How much an element looks like content: its names, its paragraphs and how many links it has for its text."""
    names = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".lower()
    score = 25.0 * (sum(w in names for w in POSITIVE) - sum(w in names for w in NEGATIVE))
    for p in node.find_all("p"):
        words = len(p.text().split())
        score += 3.0 + (10.0 if words > 100 else 5.0 if words > 50 else 0.0)
    size = _bytes(node.text(frozenset(("script", "style", "noscript"))))
    if size:
        density = len(node.find_all("a")) / (size / 100.0)
        if density > 0.5:
            score -= 10.0 * density
    return score


def is_garbage(text: str) -> bool:
    """Serialised data of page frameworks: two of its marks, or in longer texts more than 2 % escaped quotes and backslashes."""
    if sum(mark in text for mark in GARBAGE) >= 2:
        return True
    return _bytes(text) > 500 and (text.count('\\"') + text.count("\\\\")) / _bytes(text) > 0.02


def extract_content(root: Node) -> str:
    """The first semantic container with more than 200 bytes of text, else the best-scored section with a score over 50, else the body."""
    for hit in first_of_each(root, ROOTS):
        if hit is not None and _bytes(text := element_text(hit)) > MIN_ROOT:
            return text
    best, most = None, 0.0
    for node in root.find_all("div", "section", "article"):
        if (score := content_score(node)) > most:
            best, most = node, score
    if best is not None and most > MIN_SCORE:
        return element_text(best)
    body = root.first("body")
    if body is None:
        return ""
    text = element_text(body)
    if not text:
        parts: list[str] = []
        stack: list = [body]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                parts.append(node.strip())
            elif not _unwanted(node):
                stack.extend(reversed(node.children))
        text = " ".join(" ".join(parts).split())
    return "" if is_garbage(text) else text


def clean_text(text: str) -> str:
    return " ".join(text.split())


def heading_blocks(root: Node, least: int = 2, most: int = 6, min_bytes: int = 50, max_blocks: int = 0) -> tuple[list[dict], bool]:
    """Blocks between headings of the levels least..most, each with the headings above it; whether the limit was reached.

    Text before the first heading is a block of its own; a splitting heading's text is no content, another's is. Blocks of fewer
    than min_bytes bytes are left out before numbering; max_blocks 0 stands for all.
    """
    top = next((hit for hit in first_of_each(root, BLOCK_ROOTS) if hit is not None), None)
    if top is None:
        return [], False
    above: dict[int, str] = {}
    inside = {id(n) for n in top.walk()}
    outer = next((t for h in root.find_all("h1") if id(h) not in inside and (t := h.text().strip())), None)
    if outer:
        above[1] = outer
    blocks: list[dict] = []

    def fresh(heading: str | None = None, level: int | None = None, anchor: str | None = None) -> dict:
        return {"parts": [], "heading": heading, "heading_level": level, "anchor": anchor, **{f"h{k}": above.get(k) for k in range(1, 7)}}

    current = fresh()
    stack: list = list(reversed(top.children))
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            if node.strip():
                current["parts"].append(node.strip())
            continue
        level = _HEADINGS.get(node.tag)
        if level:
            text = node.text().strip()
            above = {k: v for k, v in above.items() if k < level} | {level: text}
            if level == 1 and current["h1"] is None:
                current["h1"] = text
            if least <= level <= most:
                if current["parts"]:
                    blocks.append(current)
                current = fresh(text, level, node.attrs.get("id"))
                continue
        if node.tag not in BLOCK_SKIPPED:
            stack.extend(reversed(node.children))
    if current["parts"]:
        blocks.append(current)
    out = []
    for b in blocks:
        content = " ".join(b.pop("parts"))
        if _bytes(content.strip()) >= min_bytes:
            out.append({"index": len(out), "content": content, **b})
    cut = out[:max_blocks] if max_blocks else out
    return cut, bool(max_blocks) and len(cut) >= max_blocks


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def mini_html(root: Node, main_only: bool = False) -> str:
    """The page reduced to semantic elements; of attributes only href, src and alt stay."""
    dropped = STRIPPED | BOILERPLATE if main_only else STRIPPED
    out: list[str] = []
    stack: list = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            out.append(node[0])
        elif isinstance(node, str):
            out.append(_escape(node))
        elif node.tag not in dropped:
            if node.tag in KEPT:
                names = {"a": ("href",), "img": ("src", "alt")}.get(node.tag, ())
                attrs = "".join(f' {k}="{_escape(node.attrs[k])}"' for k in names if k in node.attrs)
                if node.tag in VOID:
                    out.append(f"<{node.tag}{attrs} />")
                    continue
                out.append(f"<{node.tag}{attrs}>")
                stack.append((f"</{node.tag}>",))
            stack.extend(reversed(node.children))
    pieces = re.split(r"(<[^>]*>)", "".join(out))
    return "".join(p if p.startswith("<") else re.sub(r"[ \t\n\r\f]+", " ", p) for p in pieces).strip()


_BLOCKS = frozenset("p div section article main header footer aside nav figure figcaption address form fieldset details summary dl dd dt body html center".split())


def markdown(root: Node, main_only: bool = False) -> str:
    """The page as Markdown: ATX headings, dashes and ordinals, fenced code, quotes, pipes for tables, links and images with alt text."""
    dropped = STRIPPED | BOILERPLATE if main_only else STRIPPED

    def inline(node: Node) -> str:
        out = []
        for c in node.children:
            if isinstance(c, str):
                out.append(re.sub(r"\s+", " ", c))
            elif c.tag in dropped:
                continue
            elif c.tag == "br":
                out.append("\n")
            elif c.tag == "img":
                if c.attrs.get("alt") and not c.attrs.get("src", "").startswith("/_next/"):
                    out.append(f"![{c.attrs['alt']}]({c.attrs.get('src', '')})")
            elif c.tag == "a":
                text = inline(c).strip()
                href = c.attrs.get("href")
                out.append(f"[{text}]({href})" if text and href is not None else text)
            elif c.tag in ("strong", "b", "em", "i"):
                text = inline(c)
                sign = "**" if c.tag in ("strong", "b") else "*"
                out.append(f"{sign}{text.strip()}{sign}" if text.strip() else text)
            elif c.tag == "code":
                out.append(f"`{c.text()}`")
            else:
                out.append(inline(c))
        return "".join(out)

    def nested(c: Node) -> bool:
        return any(n.tag in _BLOCKS or n.tag in _HEADINGS or n.tag in ("ul", "ol", "table", "pre", "blockquote", "hr") for n in c.walk() if n is not c)

    def block(node: Node, depth: int) -> list[str]:
        """Markdown paragraphs of the children of a block."""
        out: list[str] = []
        run: list = []

        def flush() -> None:
            if run:
                shell = Node("span")
                shell.children = list(run)
                text = "\n".join(" ".join(x.split()) for x in inline(shell).split("\n")).strip()
                if text:
                    out.append(text)
                run.clear()

        for c in node.children:
            if isinstance(c, str) or c.tag not in dropped and c.tag not in _BLOCKS and c.tag not in _HEADINGS and c.tag not in ("ul", "ol", "table", "pre", "blockquote", "hr", "li") and not nested(c):
                run.append(c)
                continue
            flush()
            if c.tag in dropped:
                continue
            if c.tag in _HEADINGS:
                text = " ".join(inline(c).split())
                if text:
                    out.append("#" * _HEADINGS[c.tag] + " " + text)
            elif c.tag in ("ul", "ol"):
                lines = []
                for n, li in enumerate((x for x in c.children if isinstance(x, Node) and x.tag == "li"), 1):
                    body = block(li, depth + 1) if depth < 100 else [clean_text(li.text())]
                    mark = "- " if c.tag == "ul" else f"{n}. "
                    if body:
                        lines.append(mark + "\n".join(body).replace("\n", "\n" + " " * len(mark)))
                if lines:
                    out.append("\n".join(lines))
            elif c.tag == "pre":
                out.append("```\n" + c.text().strip("\n") + "\n```")
            elif c.tag == "blockquote":
                body = "\n\n".join(block(c, depth + 1)) if depth < 100 else clean_text(c.text())
                if body:
                    out.append("\n".join("> " + x if x else ">" for x in body.split("\n")))
            elif c.tag == "hr":
                out.append("---")
            elif c.tag == "table" and not any(nested(cell) for cell in c.find_all("td", "th")):
                rows = [[" ".join(inline(x).split()).replace("|", "\\|") for x in tr.children if isinstance(x, Node) and x.tag in ("td", "th")] for tr in c.find_all("tr")]
                rows = [r for r in rows if r]
                if rows:
                    width = max(map(len, rows))
                    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
                    out.append("\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]))
            elif depth < 100:
                out += block(c, depth + 1)
            else:
                out.append(clean_text(c.text()))
        flush()
        return out

    return "\n\n".join(block(root, 0))


def markdown_to_text(text: str) -> str:
    """Markdown without its signs, lines joined by spaces; code lines stay as they are."""
    out, fenced = [], False
    for line in text.splitlines():
        if line.startswith("```"):
            fenced = not fenced
        elif fenced:
            out.append(line)
        else:
            line = re.sub(r"[*_]", "", line.lstrip("#"))
            line = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", line).strip()
            line = re.sub(r"^(?:-\s+|\d+\.\s+)", "", line).strip()
            if line:
                out.append(line)
    return " ".join(out).strip()
