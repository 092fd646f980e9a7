"""CSS selectors over the page tree, field extraction by selectors, and transforms of extracted values.

Supported: type, ``*``, ``#id``, ``.class``, ``[attr]`` and its six comparisons, ``:first-child``, ``:last-child``, ``:not(compound)``,
descendant, child, neighbour and sibling combinators, and lists. Anything else is a ValueError when compiled.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from skeinwork.functions.dom import Node, parse

_PART = re.compile(
    r"""(?P<tag>\*|[a-zA-Z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)
    |\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<q>[^"]*)"|'(?P<s>[^']*)'|(?P<b>[^\]\s]+))\s*)?\]
    |:not\((?P<not>[^)]*)\)|:(?P<pseudo>first-child|last-child)""",
    re.X,
)
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")
Test = Callable[[Node], bool]


def _elements(node: Node) -> list[Node]:
    return [c for c in node.children if isinstance(c, Node)]


def _compare(name: str, op: str | None, value: str) -> Test:
    checks = {
        None: lambda v: True,
        "=": lambda v: v == value,
        "~=": lambda v: value in v.split(),
        "|=": lambda v: v == value or v.startswith(value + "-"),
        "^=": lambda v: bool(value) and v.startswith(value),
        "$=": lambda v: bool(value) and v.endswith(value),
        "*=": lambda v: bool(value) and value in v,
    }
    check = checks[op]
    return lambda n: name in n.attrs and check(n.attrs[name])


def _compound(text: str) -> Test:
    tests: list[Test] = []
    at = 0
    while at < len(text):
        m = _PART.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"not a selector: {text!r}")
        at = m.end()
        if m["tag"]:
            tests.append((lambda n: True) if m["tag"] == "*" else lambda n, t=m["tag"].lower(): n.tag == t)
        elif m["id"]:
            tests.append(lambda n, v=m["id"]: n.attrs.get("id") == v)
        elif m["cls"]:
            tests.append(lambda n, v=m["cls"]: "class" in n.attrs and v in n.attrs["class"].split())
        elif m["attr"]:
            tests.append(_compare(m["attr"].lower(), m["op"], next((m[k] for k in "qsb" if m[k] is not None), "")))
        elif m["not"] is not None:
            tests.append(lambda n, t=_compound(m["not"].strip()): not t(n))
        else:
            end = 0 if m["pseudo"] == "first-child" else -1
            tests.append(lambda n, e=end: n.parent is not None and _elements(n.parent)[e] is n)
    if not text:
        raise ValueError("empty selector")
    if len(tests) == 1:
        return tests[0]
    return lambda n: all(t(n) for t in tests)


def _split(text: str, separator: str) -> list[str]:
    """Split at a character outside brackets, parentheses and quotes."""
    out, depth, quote, begin = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[(":
            depth += 1
        elif c in "])":
            depth -= 1
        elif c == separator and not depth:
            out.append(text[begin:i])
            begin = i + 1
    return [*out, text[begin:]]


def _complex(text: str) -> Test:
    steps: list[tuple[str, Test]] = []
    at, combinator = 0, ""
    while at < len(text):
        end, depth = at, 0
        while end < len(text) and (depth or not _COMBINATOR.match(text, end)):
            depth += (text[end] in "[(") - (text[end] in "])")
            end += 1
        steps.append((combinator, _compound(text[at:end])))
        m = _COMBINATOR.match(text, end) if end < len(text) else None
        combinator = (m.group(1) or " ") if m else ""
        at = m.end() if m else end

    def fits(node: Node, k: int) -> bool:
        combinator, test = steps[k]
        if not test(node):
            return False
        if k == 0:
            return True
        if combinator in ("+", "~"):
            if node.parent is None:
                return False
            own = _elements(node.parent)
            i = next(j for j, n in enumerate(own) if n is node)
            before = own[max(0, i - 1) : i] if combinator == "+" else own[:i]
            return any(fits(n, k - 1) for n in before)
        parent = node.parent
        if combinator == ">":
            return parent is not None and fits(parent, k - 1)
        while parent is not None:
            if fits(parent, k - 1):
                return True
            parent = parent.parent
        return False

    if len(steps) == 1:
        return steps[0][1]
    return lambda n: fits(n, len(steps) - 1)


@functools.lru_cache(maxsize=1024)
def compile_selector(text: str) -> Test:
    parts = [p.strip() for p in _split(text, ",")]
    if not all(parts):
        raise ValueError(f"not a selector: {text!r}")
    tests = [_complex(p) for p in parts]
    return tests[0] if len(tests) == 1 else lambda n: any(t(n) for t in tests)


def select(root: Node, selector: str) -> list[Node]:
    """Elements below root (not root itself) that fit, in document order."""
    test = compile_selector(selector)
    return [n for n in root.walk() if n is not root and test(n)]


def first_of_each(root: Node, selectors: list[str]) -> list[Node | None]:
    """The first of what ``select`` finds for each selector, in one walk."""
    out: list[Node | None] = [None] * len(selectors)
    open_ = [(k, compile_selector(s)) for k, s in enumerate(selectors)]
    for node in root.walk():
        if node is root:
            continue
        for entry in open_:
            if entry[1](node):
                out[entry[0]] = node
                open_ = [e for e in open_ if e is not entry]
        if not open_:
            break
    return out


@dataclass(frozen=True)
class FieldRule:
    """How a field is extracted. mode: text, html, outer_html, attribute, first, list, list_of_objects, count."""

    selectors: tuple[str, ...]
    mode: str = "text"
    attribute: str | None = None
    default: Any = None
    transforms: tuple[tuple, ...] = ()
    fields: dict[str, "FieldRule"] = field(default_factory=dict, hash=False)


def _single(node: Node, rule: FieldRule, strip: bool) -> Any:
    if rule.mode == "html":
        return node.inner_html()
    if rule.mode == "outer_html":
        return node.outer_html()
    if rule.mode == "attribute":
        return node.attrs.get(rule.attribute or "")
    return node.text().strip() if strip else node.text()


def extract_field(root: Node, rule: FieldRule) -> Any:
    """The value of the first selector that fits anything, transformed; None without one."""
    for selector in rule.selectors:
        found = select(root, selector)
        if not found:
            continue
        if rule.mode == "count":
            value: Any = len(found)
        elif rule.mode == "list":
            value = [n.text() for n in found]
        elif rule.mode == "list_of_objects":
            value = [{name: _single(hit[0], r, True) for name, r in rule.fields.items() if (hit := select(n, r.selectors[0]))} for n in found]
        else:
            value = _single(found[0], rule, False)
        return transform(value, rule.transforms)
    return None


def extract_fields(root: Node, rules: dict[str, FieldRule]) -> tuple[dict[str, Any], list[str]]:
    """Values by field (defaults where nothing was found) and the names of missing fields."""
    values, missing = {}, []
    for name, rule in rules.items():
        try:
            value = extract_field(root, rule)
        except ValueError:
            value = None
        value = rule.default if value is None else value
        if value is None:
            missing.append(name)
        else:
            values[name] = value
    return values, missing


def _number(s: str) -> int | float | None:
    try:
        n = float(re.sub(r"[^0-9.\-]", "", s))
    except ValueError:
        return None
    return int(n) if n.is_integer() else n


def _matched(s: str, pattern: str) -> str | None:
    if len(pattern) > 1024:
        return None
    try:
        m = re.search(pattern, s)
    except re.error:
        return None
    return None if not m else m.group(1) if m.re.groups and m.group(1) is not None else m.group(0)


_ON_STRING: dict[str, Callable] = {
    "trim": lambda s: s.strip(),
    "lowercase": lambda s: s.lower(),
    "uppercase": lambda s: s.upper(),
    "normalize_whitespace": lambda s: " ".join(s.split()),
    "parse_number": _number,
    "parse_boolean": lambda s: s.lower() in ("true", "yes", "1", "on"),
    "strip_tags": lambda s: parse(s).text(),
    "truncate": lambda s, n: s[:n],
    "split": lambda s, sep: [p.strip() for p in s.split(sep)],
    "replace": lambda s, a, b: s.replace(a, b),
    "regex": _matched,
}


def transform(value: Any, steps: tuple[tuple, ...]) -> Any:
    """Apply (name, *arguments) in turn. Steps on strings leave other values alone; trim also works within lists, join on them.
    A pattern that does not match, is malformed or is longer than 1,024 characters gives None and ends the chain."""
    for name, *args in steps:
        if name == "join":
            value = args[0].join(v for v in value if isinstance(v, str)) if isinstance(value, list) else value
        elif isinstance(value, str):
            value = _ON_STRING[name](value, *args)
            if name == "regex":
                return value
        elif name == "trim" and isinstance(value, list):
            value = [v.strip() if isinstance(v, str) else v for v in value]
    return value
