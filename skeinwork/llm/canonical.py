"""One form for texts that look the same.

Text columns are copied out of Arrow into one numpy array of code points per batch. Lookup tables over all code
points give each one its expansion (canonical decomposition, wide and narrow forms, Latin ligatures, look-alike
letters of other alphabets, kinds of spaces and hyphens; invisible characters expand to nothing). The expansions are
gathered with prefix-sum offsets, combining marks are put in canonical order with one sort per batch and then composed
by searching the table of canonical pairs. No step calls a string function per row.

Rules (fixed): line ends become LF; tabs and LF stay, all other control characters vanish; runs of spaces keep
their length; letter case, accents, digits and dashes wider than a hyphen stay.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.session import cut_lineage

_TOP = 0x110000
# fixed values: invisible characters besides the control characters (category Cc) and formats listed here
INVISIBLE = [(0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0xE0000, 0xE0FFF)]
# fixed values: spaces that take one place, hyphens that look like U+002D, apostrophes that look like U+0027
SPACES = [(0x00A0, 0x00A0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
HYPHENS = [0x2010, 0x2011, 0xFE63, 0xFF0D, 0x02D7]
# fixed values: Cyrillic, Greek, Armenian and Cherokee letters with the Latin letters they look like
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ү": "Y", "Ӏ": "I",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "ρ": "p", "α": "a", "ι": "i", "υ": "u", "γ": "y", "օ": "o", "հ": "h", "ս": "u", "Ս": "U", "Օ": "O",
}


@functools.cache
def _tables() -> dict[str, np.ndarray]:
    """Expansion of each code point as (offset, length) into one pool; combining classes; canonical pairs."""
    special: dict[int, str] = {}
    for cp in range(_TOP):
        d = unicodedata.decomposition(chr(cp))
        if d and not 0xAC00 <= cp < 0xD7A4:
            tag, _, rest = d.rpartition(">")
            if not tag or tag in ("<wide", "<narrow"):
                special[cp] = unicodedata.normalize("NFKD" if tag else "NFD", chr(cp))
    for cp in [*range(0xFB00, 0xFB07), *range(0xFB13, 0xFB18), *range(0x0132, 0x0134), *range(0x01C4, 0x01CD), *range(0x01F1, 0x01F4)]:
        special[cp] = unicodedata.normalize("NFKD", chr(cp))
    for cp in HYPHENS:
        special[cp] = "-"
    for lo, hi in SPACES:
        special |= dict.fromkeys(range(lo, hi + 1), " ")
    special |= {ord(a): b for a, b in LOOKALIKES.items()}
    for cp, text in list(special.items()):
        special[cp] = "".join(LOOKALIKES.get(c, c) for c in text)
    for lo, hi in INVISIBLE:
        special |= dict.fromkeys(range(lo, hi + 1), "")
    special |= {cp: "" for cp in [*range(0x20), *range(0x7F, 0xA0)] if cp not in (9, 10)}
    size = np.ones(_TOP, dtype=np.int64)
    start = np.arange(_TOP, dtype=np.int64)  # an ordinary code point expands to itself
    pool = [np.arange(_TOP, dtype=np.uint32)]
    at = _TOP
    for cp, text in special.items():
        own = np.array([ord(c) for c in text], dtype=np.uint32)
        size[cp], start[cp] = len(own), at
        pool.append(own)
        at += len(own)
    ccc = np.zeros(_TOP, dtype=np.uint8)
    pairs: dict[int, int] = {}
    for cp in range(_TOP):
        c = unicodedata.combining(chr(cp))
        if c:
            ccc[cp] = c
        d = unicodedata.decomposition(chr(cp))
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", chr(cp)) == chr(cp):
            a, b = (int(x, 16) for x in d.split())
            key = (ord(LOOKALIKES.get(chr(a), chr(a))) << 21) | b
            # of characters that now look alike, the one of the Latin letter stands for all, else the first by code point
            if chr(a) not in LOOKALIKES or key not in pairs:
                pairs[key] = cp
    keys = np.array(sorted(pairs), dtype=np.int64)
    later = np.zeros(_TOP, dtype=bool)  # starters that compose with the one before
    later[[k & 0x1FFFFF for k in keys.tolist() if not ccc[k & 0x1FFFFF]]] = True
    return {"later": later, "size": size, "start": start, "pool": np.concatenate(pool), "ccc": ccc, "pair": keys, "composed": np.array([pairs[k] for k in keys.tolist()], dtype=np.uint32)}


def _compose(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order the marks behind each starter and compose them with it. row: the text of each code point."""
    t = _tables()
    ccc = t["ccc"][cp]
    if not ccc.any():
        return cp, row
    first = np.append(True, row[1:] != row[:-1])
    run = np.cumsum((ccc == 0) | first)
    near = np.flatnonzero(ccc > 0)
    order = near[np.lexsort((near, ccc[near], run[near]))]
    cp = cp.copy()
    cp[near], ccc[near] = cp[order], ccc[order]
    run_of, began = run[near], np.flatnonzero(np.append(True, run[near][1:] != run[near][:-1]))
    rank = np.arange(len(near)) - np.repeat(began, np.diff(np.append(began, len(near))))
    base = np.searchsorted(run, run_of, side="left")  # where the run begins
    starter = ccc[base] == 0
    gone = np.zeros(len(cp), dtype=bool)
    last = np.zeros(int(run[-1]) + 1, dtype=np.uint8)  # class of the last mark kept in each run
    for k in range(int(rank.max()) + 1):
        m = np.flatnonzero((rank == k) & starter)
        pos, b, r = near[m], base[m], run_of[m]
        key = (cp[b].astype(np.int64) << 21) | cp[pos]
        i = np.minimum(np.searchsorted(t["pair"], key), len(t["pair"]) - 1)
        ok = (t["pair"][i] == key) & (last[r] < ccc[pos])
        cp[b[ok]] = t["composed"][i[ok]]
        gone[pos[ok]] = True
        last[r[~ok]] = ccc[pos[~ok]]
    return cp[~gone], row[~gone]


def _join_starters(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compose starters with the starter right behind them (vowel signs of several Indic scripts), as long as any do."""
    t = _tables()
    while len(cp) > 1 and t["later"][cp].any():
        key = (cp[:-1].astype(np.int64) << 21) | cp[1:]
        i = np.minimum(np.searchsorted(t["pair"], key), len(t["pair"]) - 1)
        at = np.flatnonzero((t["pair"][i] == key) & t["later"][cp[1:]] & (row[1:] == row[:-1]))
        at = at[np.append(True, np.diff(at) > 1)] if len(at) else at  # of a chain the front first
        if not len(at):
            break
        cp = cp.copy()
        cp[at] = t["composed"][i[at]]
        keep = np.ones(len(cp), dtype=bool)
        keep[at + 1] = False
        cp, row = cp[keep], row[keep]
    return cp, row


def _hangul(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join conjoining jamo to syllables (the arithmetic of the Unicode standard)."""
    if not ((cp >= 0x1100) & (cp < 0x1200)).any():
        return cp, row
    for second, count in ((0x1161, 21), (0x11A8, 27)):
        lead = cp[:-1].astype(np.int64)
        v = cp[1:].astype(np.int64) - second
        fits = (v >= 0) & (v < count) & (row[1:] == row[:-1])
        if count == 21:
            fits &= (lead >= 0x1100) & (lead < 0x1113)
            made = 0xAC00 + ((lead - 0x1100) * 21 + v) * 28
        else:
            fits &= (lead >= 0xAC00) & (lead < 0xD7A4) & ((lead - 0xAC00) % 28 == 0)
            made = lead + v + 1
        at = np.flatnonzero(fits)
        cp = cp.copy()
        cp[at] = made[at]
        keep = np.ones(len(cp), dtype=bool)
        keep[at + 1] = False
        cp, row = cp[keep], row[keep]
    return cp, row


def canonical_array(texts: pa.Array) -> pa.Array:
    """The canonical form of each text of an Arrow string array; null stays null, empty stays empty."""
    t = _tables()
    texts = texts.cast(pa.large_string())
    valid = texts.is_valid()
    filled = texts.fill_null("")
    n = len(filled)
    offsets = np.frombuffer(filled.buffers()[1], dtype=np.int64, count=n + 1, offset=filled.offset * 8)
    data = np.frombuffer(filled.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    ends = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]  # in code points
    row = np.repeat(np.arange(n), np.diff(ends))

    cr = cp == 13
    if cr.any():
        drop = cr & np.append((cp[1:] == 10) & (row[1:] == row[:-1]), False)
        cp = np.where(cr, np.uint32(10), cp)[~drop]
        row = row[~drop]

    size = t["size"][cp]
    if len(cp) and (size != 1).any() or (t["start"][cp] != cp).any():
        total = int(size.sum())
        begin = np.cumsum(size) - size
        within = np.arange(total) - np.repeat(begin, size)
        cp = t["pool"][np.repeat(t["start"][cp], size) + within]
        row = np.repeat(row, size)
    if len(cp):
        cp, row = _compose(*_join_starters(cp, row))
        cp, row = _hangul(*_join_starters(cp, row))
    counts = np.bincount(row, minlength=n)
    out = cp.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    byte_ends = np.concatenate(([0], np.cumsum(width)))[np.concatenate(([0], np.cumsum(counts)))]
    made = pa.LargeStringArray.from_buffers(n, pa.py_buffer(byte_ends.astype(np.int64).tobytes()), pa.py_buffer(out))
    return pa.compute.if_else(valid, made, pa.scalar(None, pa.large_string()))


def canonical_text(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """df with the canonical form of text_col added as out_col (null for null; replaces an out_col df may have)."""
    kept = [f for f in df.schema.fields if f.name != out_col]
    schema = T.StructType([*kept, T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # a few megabytes of text at a time bound the memory of the code-point arrays
            step = max(1, int(b.num_rows * (4 << 20) / max(b.column(text_col).nbytes, 1)))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                cols = [part.column(f.name) for f in kept] + [canonical_array(part.column(text_col)).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[*(f.name for f in kept), out_col])

    return df.mapInArrow(run, schema)


def lookalike_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pairs ``id_a < id_b`` of rows whose texts differ but have the same canonical form with a visible character.

    Forms are computed once; digests of 16 bytes are written to the shared folder while the query is built. Within a form the
    different texts are paired first and their rows then put in, so exact copies are never paired with each other. Null texts
    and texts without a visible character have no partners; an empty table gives no pairs.
    """
    forms = canonical_text(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "form")
    rows = cut_lineage(forms.filter(F.col("form").rlike(r"[^\s]")).select("id", F.unhex(F.md5("text")).alias("raw"), F.unhex(F.md5("form")).alias("form")))
    several = rows.groupBy("form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).filter(F.col("lo") != F.col("hi")).select("form")
    kinds = rows.join(several, "form", "left_semi").select("form", "raw").distinct()
    unlike = kinds.select("form", F.col("raw").alias("raw_a")).join(kinds.select("form", F.col("raw").alias("raw_b")), "form").filter(F.col("raw_a") < F.col("raw_b"))
    pairs = unlike.join(rows.select(F.col("raw").alias("raw_a"), F.col("id").alias("x")), "raw_a").join(rows.select(F.col("raw").alias("raw_b"), F.col("id").alias("y")), "raw_b")
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
