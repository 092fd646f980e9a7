"""Small text functions as native expressions: JSON out of answers, truncation at character boundaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_payload(answer: Column | str) -> Column:
    """The JSON text of an answer: itself if it can be read, else what stands between its first and last braces (brackets,
    without braces) once code fences are gone; null if that cannot be read either."""
    a = F.col(answer) if isinstance(answer, str) else answer
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(a), r"^```(?:json)?", ""), r"```$", ""))
    braces = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    brackets = F.regexp_extract(bare, r"(?s)\[.*\]", 0)
    cut = F.when(bare.contains("{") & (braces != ""), braces).when(~bare.contains("{") & (brackets != ""), brackets).otherwise(bare)
    readable = lambda c: F.try_parse_json(c).isNotNull()
    return F.when(readable(a), a).when(readable(cut), cut)


def truncate_bytes(text: Column | str, most: int = 24_000) -> Column:
    """The longest beginning of a text with at most so many bytes in UTF-8."""
    t = F.col(text) if isinstance(text, str) else text
    data = F.encode(t, "UTF-8")
    # a cut within a character leaves one to three continuation bytes and a lead byte at the end: step back to the lead
    lead = lambda k: F.conv(F.hex(F.substring(data, most + 1 - k, 1)), 16, 10).cast("int")
    back = F.lit(0)
    for k in (3, 2, 1, 0):  # the first byte left out is a continuation byte: its character began k bytes before
        inside = F.lit(True)
        for j in range(k):
            inside = inside & (lead(j).bitwiseAND(0xC0) == 0x80)
        back = F.when(inside & (lead(k).bitwiseAND(0xC0) != 0x80), F.lit(k)).otherwise(back)
    return F.when(F.octet_length(t) <= most, t).otherwise(F.decode(F.substr(data, F.lit(1), F.lit(most) - back), "UTF-8"))
