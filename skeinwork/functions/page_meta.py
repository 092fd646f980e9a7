"""Metadata, links and structured data of a page tree."""

from __future__ import annotations

import json
import re
from datetime import date, datetime, timezone
from urllib.parse import urljoin, urlsplit

from skeinwork.functions.dom import Node


def title_of(root: Node) -> str | None:
    """The title element, else og:title, else the first h1; trimmed and not empty."""
    for node in root.find_all("title")[:1]:
        if text := node.text().strip():
            return text
    for node in root.find_all("meta"):
        if node.attrs.get("property") == "og:title" and (text := node.attrs.get("content", "").strip()):
            return text
    h1 = root.first("h1")
    return (h1.text().strip() or None) if h1 is not None else None


def meta_map(root: Node) -> dict[str, str]:
    """name or property of each meta element to its content; the last of a name counts."""
    out = {}
    for node in root.find_all("meta"):
        name = node.attrs.get("name") or node.attrs.get("property")
        content = node.attrs.get("content")
        if name and content is not None:
            out[name] = content
    return out


def rich_metadata(root: Node) -> dict:
    """Maps meta, open_graph, twitter, dublin_core and alternates; feeds; canonical_url, favicon and fields with fallbacks."""
    meta, og, twitter, dc = {}, {}, {}, {}
    for node in root.find_all("meta"):
        name = next((node.attrs[k] for k in ("name", "property", "itemprop") if k in node.attrs), None)
        content = node.attrs.get("content")
        if name and content and content.strip():
            key, value = name.lower(), content.strip()
            for prefix, target in (("og:", og), ("twitter:", twitter), ("dc.", dc), ("dc:", dc), ("dcterms.", dc)):
                if key.startswith(prefix):
                    target[key[len(prefix) :]] = value
                    break
            else:
                meta[key] = value
        if "charset" in node.attrs:
            meta["charset"] = node.attrs["charset"]
        if "http-equiv" in node.attrs and content is not None:
            meta["http-equiv:" + node.attrs["http-equiv"].lower()] = content
    canonical = favicon = None
    alternates, feeds = {}, []
    for node in root.find_all("link"):
        rel, href = node.attrs.get("rel", "").lower(), node.attrs.get("href", "").strip()
        if not rel or not href:
            continue
        if rel == "canonical":
            canonical = href
        elif rel in ("icon", "shortcut icon", "apple-touch-icon"):
            favicon = favicon or href
        elif rel == "alternate":
            kind = node.attrs.get("type", "").lower()
            feed = "rss" if "rss" in kind else "atom" if "atom" in kind else None
            if feed:
                feeds.append({"url": href, "feed_type": feed, "title": node.attrs.get("title")})
            if "hreflang" in node.attrs:
                alternates[node.attrs["hreflang"]] = href

    def first(*values: str | None) -> str | None:
        return next((v for v in values if v is not None), None)

    head = root.first("title")
    return {
        "title": first((head.text().strip() or None) if head is not None else None, og.get("title"), twitter.get("title")),
        "description": first(og.get("description"), twitter.get("description"), meta.get("description")),
        "author": first(meta.get("author"), dc.get("creator"), meta.get("article:author")),
        "robots": meta.get("robots"),
        "keywords": [k for x in meta.get("keywords", "").split(",") if (k := x.strip())],
        "published_date": first(meta.get("article:published_time"), dc.get("date"), meta.get("date"), meta.get("pubdate")),
        "modified_date": first(meta.get("article:modified_time"), meta.get("lastmod")),
        "canonical_url": canonical,
        "favicon": favicon,
        "meta": meta,
        "open_graph": og,
        "twitter": twitter,
        "dublin_core": dc,
        "alternates": alternates,
        "feeds": feeds,
    }


def flat_metadata(m: dict) -> dict[str, str]:
    """One map with prefixed names and the plain fields that are set."""
    out = {f"{p}:{k}": v for p, part in (("meta", "meta"), ("og", "open_graph"), ("twitter", "twitter"), ("dc", "dublin_core")) for k, v in m[part].items()}
    out |= {k: m[k] for k in ("canonical_url", "title", "description", "author", "robots", "published_date", "modified_date") if m[k]}
    return out | ({"keywords": ", ".join(m["keywords"])} if m["keywords"] else {})


#: JSON-LD nested deeper than this is not read.
DEPTH = 128
_SURROGATE = re.compile("[\ud800-\udfff]")


def json_ld(root: Node) -> list:
    """The values of all JSON-LD scripts that can be read."""
    out = []
    for node in root.find_all("script"):
        if node.attrs.get("type", "").strip().lower() == "application/ld+json" and (text := node.text().strip()):
            try:
                out.append(_readable(json.loads(text)))
            except (ValueError, RecursionError):  # deeper than a reader can follow counts as absent
                continue
    return out


def _readable(value: object) -> object:
    """A value without halves of surrogate pairs, which no encoding takes; raises RecursionError beyond DEPTH levels."""
    text = json.dumps(value, ensure_ascii=False)
    if _SURROGATE.search(text):
        value = json.loads(_SURROGATE.sub("\ufffd", text))
    level, todo = 0, [value]
    while todo:
        level += 1
        if level > DEPTH:
            raise RecursionError
        todo = [c for v in todo if isinstance(v, (dict, list)) for c in (v.values() if isinstance(v, dict) else v)]
    return value


def plain_type(name: str) -> str:
    return re.sub(r"https?://schema\.org/", "", name.strip())


def _timestamp(text: str) -> int | None:
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        try:
            d = date.fromisoformat(text)
        except ValueError:
            return None
        return int(datetime(d.year, d.month, d.day, tzinfo=timezone.utc).timestamp())
    try:
        at = datetime.fromisoformat(text)
    except ValueError:
        return None
    return int(at.timestamp()) if at.tzinfo is not None and re.search(r"[T ]\d{2}:\d{2}:\d{2}", text) else None


def with_timestamps(value: object) -> object:
    """A copy in which strings under names with date or time are seconds since 1970, where they can be read as such."""
    if isinstance(value, dict):
        out = {}
        for k, v in value.items():
            if "date" in k.lower() or "time" in k.lower():
                seconds = _timestamp(v) if isinstance(v, str) else None
                out[k] = v if seconds is None else seconds
            else:
                out[k] = with_timestamps(v)
        return out
    return [with_timestamps(v) for v in value] if isinstance(value, list) else value


def schema_items(values: list, only: frozenset[str] = frozenset(), dates: bool = False) -> list[tuple[str, dict]]:
    """(type, object) of each typed object in lists and ``@graph``; an object of several types once for each."""
    out, stack = [], list(reversed(values))
    while stack:
        v = stack.pop()
        if isinstance(v, list):
            stack.extend(reversed(v))
        elif isinstance(v, dict):
            if "@graph" in v:
                stack.append(v["@graph"])
                continue
            kinds = v.get("@type")
            for kind in [kinds] if isinstance(kinds, str) else kinds if isinstance(kinds, list) else []:
                if isinstance(kind, str) and (not only or plain_type(kind) in only):
                    out.append((plain_type(kind), with_timestamps(v) if dates else v))
    return out


# fixed values: the attribute that holds an element's microdata value
_VALUE = {"meta": "content", "link": "href", "a": "href", "area": "href", "img": "src", "audio": "src", "video": "src", "source": "src", "object": "data", "time": "datetime", "data": "value", "meter": "value"}


def _properties(scope: Node) -> dict:
    out: dict = {}
    if "itemtype" in scope.attrs:
        out["@type"] = plain_type(scope.attrs["itemtype"])
    stack = [c for c in reversed(scope.children) if isinstance(c, Node)]
    while stack:
        node = stack.pop()
        name = node.attrs.get("itemprop")
        if name:
            if "itemscope" in node.attrs:
                value: object = _properties(node)
            else:
                value = node.attrs.get(_VALUE.get(node.tag, ""))
                value = node.text().strip() if value is None else value
            if name not in out:
                out[name] = value
            else:
                out[name] = (out[name] if isinstance(out[name], list) else [out[name]]) + [value]
        if "itemscope" not in node.attrs:
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def microdata(root: Node, only: frozenset[str] = frozenset()) -> list[tuple[str, dict]]:
    """(type, properties) of each typed item that lies in no other."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if "itemscope" in node.attrs:
            kind = plain_type(node.attrs.get("itemtype", ""))
            if "itemtype" in node.attrs and (not only or kind in only):
                try:
                    out.append((kind, _properties(node)))
                except RecursionError:  # items within items beyond any reader's depth count as absent
                    pass
            continue
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def join_url(base: str, href: str) -> str | None:
    """A reference resolved against its base; None where that is no address."""
    try:
        joined = urljoin(base, href.strip())
        parts = urlsplit(joined)
    except ValueError:
        return None
    return joined if parts.scheme else None


def links(root: Node, base: str) -> list[tuple[str, str | None]]:
    """(address, anchor text) of each a[href] that leads to an http(s) address, in order, with repetitions."""
    out = []
    for a in root.find_all("a"):
        href = a.attrs.get("href")
        url = join_url(base, href) if href is not None else None
        if url and url.split(":", 1)[0].lower() in ("http", "https"):
            out.append((url, " ".join(a.text().split()) or None))
    return out
