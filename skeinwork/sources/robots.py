"""robots.txt: rules by host, the longest matching rule decides; crawl delays; sitemaps named in it."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _lines(text: str) -> Iterator[tuple[str, str]]:
    for line in text.splitlines():
        name, sep, value = line.split("#", 1)[0].partition(":")
        if sep:
            yield name.strip().lower(), value.strip()


@functools.lru_cache(maxsize=4096)
def rules_for(text: str, agent: str) -> tuple[tuple[bool, str], ...]:
    """(allow, path pattern) of the groups for the agent's name, else of those for ``*``."""
    groups: dict[str, list[tuple[bool, str]]] = {}
    current: list[str] = []
    open_ = False
    for name, value in _lines(text):
        if name == "user-agent":
            if not open_:
                current = []
            current.append(re.split(r"[/\s]", value.lower())[0])
            open_ = True
        else:
            open_ = False
            if name in ("allow", "disallow") and value:
                for a in current:
                    groups.setdefault(a, []).append((name == "allow", value))
        for a in current:
            groups.setdefault(a, [])
    own = re.split(r"[/\s]", agent.lower())[0]
    return tuple(groups[own] if own in groups else groups.get("*", []))


@functools.lru_cache(maxsize=65536)
def _pattern(rule: str) -> re.Pattern:
    end = rule.endswith("$")
    return re.compile(".*".join(map(re.escape, rule.rstrip("$").split("*"))) + ("$" if end else ""))


def is_allowed(text: str | None, agent: str, path: str) -> bool:
    """Of the rules that match, the longest decides, an allowing one among equals; without any, and without robots.txt, allowed."""
    best: tuple[int, bool] = (-1, True)
    for allow, rule in rules_for(text or "", agent):
        if _pattern(rule).match(path or "/"):
            best = max(best, (len(rule), allow))
    return best[1]


def crawl_delay_ms(text: str | None, agent: str) -> int | None:
    """The first delay in a group for ``*`` or the agent; None without one and for values that are no finite positive numbers."""
    mine = False
    for name, value in _lines(text or ""):
        if name == "user-agent":
            mine = value.lower() in ("*", agent.lower())
        elif mine and name == "crawl-delay":
            try:
                seconds = float(value)
            except ValueError:
                continue
            return int(seconds * 1000) if math.isfinite(seconds) and seconds >= 0 else None
    return None


def allowed_urls(urls: DataFrame, robots: DataFrame, agent: str, url_col: str = "url", host_col: str = "host") -> DataFrame:
    """urls with ``allowed`` and ``crawl_delay_ms``. robots: ``host, body``, one row per host; hosts without one allow everything.

    The join is left to the optimiser, which broadcasts the rules only while they are small.
    """

    @F.pandas_udf("allowed boolean, crawl_delay_ms long")
    def judge(body: pd.Series, path: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"allowed": [is_allowed(b, agent, p) for b, p in zip(body, path)], "crawl_delay_ms": pd.array([crawl_delay_ms(b, agent) for b in body], dtype="Int64")})

    path = F.regexp_extract(F.col(url_col), r"^(?i:[a-z][a-z0-9+.\-]*:)?//[^/?#]*([^?#]*)", 1)
    j = urls.join(robots.select(F.col("host").alias("__host"), F.col("body").alias("__body")), F.col(host_col) == F.col("__host"), "left")
    j = j.withColumn("__j", judge.asNondeterministic()(F.coalesce("__body", F.lit("")), F.coalesce(path, F.lit("/"))))
    return j.select(*[c for c in urls.columns if c not in ("allowed", "crawl_delay_ms")], "__j.allowed", "__j.crawl_delay_ms")


def named_sitemaps(body: Column | str, host: Column | str) -> Column:
    """Addresses of the sitemaps named in a robots.txt; without any, ``/sitemap.xml`` of the host."""
    b, h = (F.col(c) if isinstance(c, str) else c for c in (body, host))
    found = F.regexp_extract_all(F.coalesce(b, F.lit("")), F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), 1)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.concat(F.lit("https://"), h, F.lit("/sitemap.xml"))))
