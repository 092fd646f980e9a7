"""Host of an address, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host_of(url: Column | str) -> Column:
    """Lower-cased host without user part, port and one leading ``www.``; null for null or host-less addresses.

    Addresses without a scheme are read from their first character (``example.org/a`` has the host ``example.org``).
    """
    u = F.col(url) if isinstance(url, str) else url
    rest = F.regexp_replace(F.trim(u), r"^(?i:[a-z][a-z0-9+.\-]*:)?//", "")
    authority = F.regexp_extract(rest, r"^[^/?#\\]*", 0)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", "")
    cleaned = F.regexp_replace(F.lower(host), r"^www\.", "")
    return F.when(cleaned != "", cleaned)
