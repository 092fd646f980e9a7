"""Sitemaps: reading of urlset and index files, plain or compressed, with bounds on depth, size and number."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BYTES, MAX_URLS, MAX_DEPTH = 50 << 20, 100_000, 3
_SCHEMA = "source string, kind string, loc string, lastmod string, changefreq string, priority double"


def parse_sitemap(data: bytes | str | None) -> tuple[str, list[dict]]:
    """(kind, entries): kind is urlset, sitemapindex or error (unreadable, empty, or more than MAX_BYTES when unpacked)."""
    if not data:
        return "error", []
    raw = data.encode() if isinstance(data, str) else bytes(data)
    try:
        if raw[:2] == b"\x1f\x8b":
            with gzip.GzipFile(fileobj=io.BytesIO(raw)) as f:
                raw = f.read(MAX_BYTES + 1)
        if len(raw) > MAX_BYTES or b"<!ENTITY" in raw[:4096]:
            return "error", []
        root = ElementTree.fromstring(raw)
    except (OSError, EOFError, ElementTree.ParseError, ValueError):
        return "error", []
    kind = root.tag.rpartition("}")[2].lower()
    out = []
    for node in root:
        own = {c.tag.rpartition("}")[2].lower(): (c.text or "").strip() for c in node}
        if own.get("loc"):
            try:
                priority = float(own["priority"])
            except (KeyError, ValueError):
                priority = None
            out.append({"loc": own["loc"], "lastmod": own.get("lastmod") or None, "changefreq": (own.get("changefreq") or "").lower() or None, "priority": priority})
    return (kind if kind in ("urlset", "sitemapindex") else "error"), out


def read_sitemaps(files: DataFrame, source_col: str, data_col: str) -> DataFrame:
    """Entries of sitemap files: ``source, kind, loc, lastmod, changefreq, priority``; unreadable files give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["source", "kind", "loc", "lastmod", "changefreq", "priority"]
        for pdf in batches:
            rows = []
            for s, d in zip(pdf["source"], pdf["data"]):
                kind, entries = parse_sitemap(d)
                rows += [(s, kind, *e.values()) for e in entries]
            yield pd.DataFrame(rows, columns=names).astype({"priority": "float64"})

    return files.select(F.col(source_col).alias("source"), F.col(data_col).alias("data")).mapInPandas(run, _SCHEMA)


def follow_sitemaps(files: DataFrame, start: DataFrame, source_col: str, data_col: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Pages reachable from start (one column ``source``) through index files that files holds, in at most max_depth steps."""
    entries = read_sitemaps(files, source_col, data_col)
    front = start.select("source").distinct()
    seen, pages = front, None
    for _ in range(max_depth + 1):
        own = entries.join(front, "source", "left_semi")
        found = own.filter("kind = 'urlset'")
        pages = found if pages is None else pages.unionByName(found)
        front = own.filter("kind = 'sitemapindex'").select(F.col("loc").alias("source")).distinct().join(seen, "source", "left_anti")
        seen = seen.union(front)
    return pages.dropDuplicates(["loc"])


def by_priority(entries: DataFrame, limit: int = MAX_URLS) -> DataFrame:
    """The entries of the highest priority (0.5 where none is given), ties by address."""
    return entries.withColumn("priority", F.coalesce("priority", F.lit(0.5))).orderBy(F.desc("priority"), "loc").limit(limit)


def parse_date(value: Column | str) -> Column:
    """A sitemap date: with offset, without one (UTC), or a day alone."""
    v = F.col(value) if isinstance(value, str) else value
    return F.coalesce(*[F.try_to_timestamp(v, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")])
