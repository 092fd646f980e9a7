"""URL functions as native column expressions. The normalisers differ on purpose; each is the key of another operator."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: extensions of files that are no pages
NON_PAGE = "png jpg jpeg gif svg webp ico bmp tiff pdf doc docx xls xlsx ppt pptx odt ods mp4 mp3 avi mov wmv flv webm mkv wav ogg zip tar gz rar 7z bz2 xz css js mjs map woff woff2 ttf eot otf xml rss atom json jsonld".split()
# fixed values: second-level domains under which names are registered
SECOND_LEVEL = ["co.uk", "co.jp", "com.au", "co.nz", "com.br"]


def _c(url: Column | str) -> Column:
    return F.col(url) if isinstance(url, str) else url


def _slashes(u: Column) -> Column:
    return F.length(u) - F.length(F.replace(u, F.lit("/"), F.lit("")))


def _serialised(u: Column, lowered: bool = False) -> Column:
    """What a URL parser would write: host in lower case, no default port, at least the path ``/``."""
    if not lowered:
        prefix = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0)
        u = F.concat(F.lower(prefix), F.substr(u, F.length(prefix) + 1))
    u = F.regexp_replace(u, r"^(http://[^/?#]*?):(?:80)?(?=[/?#]|$)|^(https://[^/?#]*?):(?:443)?(?=[/?#]|$)", "$1$2")
    return F.regexp_replace(u, r"^([a-z][a-z0-9+.\-]*://[^/?#]+)(?=[?#]|$)", "$1/")


def dedup_key(url: Column | str) -> Column:
    """Lower case; without fragment; without trailing slashes while more than two slashes are left; then without query."""
    u = F.regexp_replace(F.lower(_c(url)), "#.*$", "")
    stripped = F.regexp_replace(u, "^((?:[^/]*/){2}(?:.*[^/])?)/+$", "$1")
    return F.regexp_replace(_serialised(stripped, lowered=True), r"\?.*$", "")


def crawl_url(url: Column | str) -> Column:
    """http(s) only (else null); without fragment and query; without one trailing slash of a path longer than ``/``."""
    u = F.regexp_replace(_serialised(F.trim(_c(url))), r"[?#].*$", "")
    root = u.rlike(r"^https?://[^/]*/$")
    return F.when(u.rlike("^https?://"), F.when(root, u).otherwise(F.regexp_replace(u, "/$", "")))


def graph_key(url: Column | str) -> Column:
    """Trimmed; without fragment; without one trailing slash if there are more than three slashes; query and case stay."""
    u = F.regexp_replace(F.trim(_c(url)), "#.*$", "")
    return F.when(u.endswith("/") & (_slashes(u) > 3), F.regexp_replace(u, "/$", "")).otherwise(u)


def history_key(url: Column | str) -> Column:
    return F.lower(F.trim(_c(url)))


def map_key(url: Column | str) -> Column:
    """Without fragment."""
    return F.regexp_replace(_serialised(_c(url)), "#.*$", "")


def extract_domain(url: Column | str) -> Column:
    """The host of an address; of a malformed one what stands before its first slash."""
    u = _c(url)
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), "^.*@", ""), r":\d*$", "")
    fallback = F.split(F.regexp_replace(u, "^(http://)+|^(https://)+", ""), "/")[0]
    return F.when(host != "", F.lower(host)).otherwise(fallback)


def normalize_domain(domain: Column | str) -> Column:
    return F.regexp_replace(F.lower(_c(domain)), r"^www\.", "")


def registered_domain(domain: Column | str) -> Column:
    """The last two labels, three under a known second-level domain."""
    labels = F.split(_c(domain), r"\.")
    last_two = F.array_join(F.slice(labels, -2, 2), ".")
    return (
        F.when(F.size(labels) <= 2, _c(domain))
        .when(last_two.isin(SECOND_LEVEL), F.array_join(F.slice(labels, -3, 3), "."))
        .otherwise(last_two)
    )


def index_name(url: Column | str) -> Column:
    """Without scheme, www. and trailing slashes; other than ASCII letters and digits as single hyphens; at most 511 characters."""
    u = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(_c(url)), "^(https://)+", ""), "^(http://)+", ""), r"^(www\.)+", "")
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(u, "/+$", ""), "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")
    return F.substring(name, 1, 511)


def url_tags(url: Column | str) -> Column:
    """``/a``, ``/a/b``, … for the segments of the path."""
    path = F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    tags = F.transform(parts, lambda _, i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i + 1), "/")))
    return F.when(F.size(parts) > 0, tags).otherwise(F.array().cast("array<string>"))


def error_status(error: Column | str) -> Column:
    """The status code a message speaks of, by the first of three forms that fits; null without one."""
    found = [F.regexp_extract(_c(error), p, 1) for p in (r"^(\d{3})\s", r"HTTP\s+(\d{3})", r"status[:\s]+(\d{3})")]
    return F.coalesce(*[F.when(x != "", x.cast("int")) for x in found])


def is_skipped_link(href: Column | str) -> Column:
    """Empty links and those of schemes that lead to no page."""
    h = F.trim(_c(href))
    return (h == "") | h.rlike("^(javascript:|mailto:|tel:|data:|#)")


def is_non_page(url: Column | str) -> Column:
    """Whether what follows the last dot before query and fragment is an extension of a file that is no page."""
    path = F.regexp_replace(_c(url), r"[?#].*$", "")
    return F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1)).isin(NON_PAGE)


def in_scope(domain: Column | str, base: Column | str, allowed: list[str] = (), follow_subdomains: bool = True, follow_external: bool = False) -> Column:
    """A whitelist decides alone; else the same domain, its subdomains if followed, all others if external ones are."""
    d, b = normalize_domain(domain), normalize_domain(base)
    if allowed:
        return d.isin([re.sub(r"^www\.", "", a.lower()) for a in allowed])
    inside = d == b
    if follow_subdomains:
        inside = inside | d.endswith(F.concat(F.lit("."), b))
    return inside | F.lit(follow_external)


def glob(url: Column | str, pattern: str, sitemap: bool = False) -> Column:
    """Whether a pattern fits. One ``**``: prefix and suffix. Else with ``*``: the parts occur in order from anywhere after
    the start, and unless the pattern has ``**`` no slash stands before any of them. Else equality. For sitemaps every
    pattern but one with a single ``**`` (which fits as above) stands for itself, and one with more never fits."""
    u = _c(url)
    parts = pattern.split("**")
    if len(parts) == 2:
        return u.startswith(parts[0]) & (u.endswith(parts[1]) if parts[1] else F.lit(True))
    if sitemap:
        return F.lit(False) if len(parts) > 2 else u == pattern
    if "*" in pattern:
        gap = "(?s).*?" if len(parts) > 2 else "[^/]*?"
        pieces = [p for p in pattern.split("*") if p]
        # each part is taken where it first occurs, so a later gap never reaches back: possessive groups
        return u.rlike("^" + "".join(f"(?>{gap}{re.escape(p)})" for p in pieces)) if pieces else F.lit(True)
    return u == pattern


def admitted(url: Column | str, include: list[str] = (), exclude: list[str] = (), sitemap: bool = False) -> Column:
    """Excluding patterns win; without including ones everything else is admitted."""
    fits = F.lit(not include)
    for p in include:
        fits = fits | glob(url, p, sitemap)
    for p in exclude:
        fits = fits & ~glob(url, p, sitemap)
    return fits


def is_fetchable(url: Column | str) -> Column:
    """http(s) addresses whose host is no bare IP address."""
    u = _c(url)
    host = F.regexp_replace(F.regexp_extract(u, r"^https?://([^/?#]*)", 1), "^.*@", "")
    ip = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}(:\d*)?$") | host.rlike(r"^\[")
    return u.rlike("^https?://") & (host != "") & ~ip


def store_key(url: Column | str) -> Column:
    """The object name of a stored page."""
    host = F.when(extract_domain(url) != "", extract_domain(url)).otherwise(F.lit("unknown"))
    return F.concat(F.lit("pages/"), host, F.lit("/"), F.substring(F.sha2(_c(url).cast("string"), 256), 1, 16), F.lit(".html"))


def document_uid(url: Column | str) -> Column:
    """UUIDv5 of an address under the DNS namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8")), F.encode(_c(url), "UTF-8")))
    part = lambda a, n: F.substring(digest, a, n)
    variant = F.substring(F.lit("89ab"), F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(3) + 1, F.lit(1))
    return F.lower(F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12)))


def crawl_seeds(start_urls: Column, allowed: Column, include: Column) -> tuple[Column, Column]:
    """Defaults of a crawl: the whitelist (else the distinct hosts of the start addresses, lower case) and the including
    patterns (else ``scheme://host/path/*`` of each start address that is not a root)."""
    hosts = F.array_distinct(F.transform(start_urls, lambda u: extract_domain(u)))
    deep = F.filter(start_urls, lambda u: F.regexp_extract(u, r"^https?://[^/?#]*(/[^?#]*)", 1).rlike("^/+[^/]"))
    auto = F.array_distinct(F.transform(deep, lambda u: F.concat(F.regexp_replace(F.regexp_replace(u, r"[?#].*$", ""), "/+$", ""), F.lit("/*"))))
    return F.when(F.size(allowed) > 0, allowed).otherwise(hosts), F.when(F.size(include) > 0, include).otherwise(auto)
