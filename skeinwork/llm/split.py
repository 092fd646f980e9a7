"""Cutting long texts at topic boundaries (lexical cohesion).

Between any two neighbouring sentences or lines of a text, the words of the BLOCK units before and after are compared by
cosine. Where the similarity is a valley between two higher sides lies a topic boundary, the deeper the more
certain. A text is cut from the front: within the window of sizes allowed for the next piece, the cut is the deepest
valley among the paragraph, line and sentence ends (of equally deep ones the paragraph end, else the line end, else the last);
without any such end, the last word end; without that, the limit. Each piece but the first begins ``overlap`` characters before its predecessor's end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 4
#: A piece is at least this part of the limit, so that the number of pieces stays near the least possible.
LEAST = 0.5

_WORD = re.compile(r"[^\W_]+")
_END = re.compile(r"(\r?\n[ \t]*(?:\r?\n[ \t]*)+|\r\r+)|(\r\n|\n|\r)|([.!?…。！？]+[\"'”’»)\]]*\s+)")
_SPACE = re.compile(r"\s+")


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets behind each unit end, and its rank: 3 paragraph, 2 line, 1 sentence."""
    at, rank = [], []
    for m in _END.finditer(text):
        at.append(m.end())
        rank.append(3 if m.group(1) else 2 if m.group(2) or "\n" in m.group() else 1)
    return np.array(at, dtype=np.int64), np.array(rank, dtype=np.int64)


def valley_depths(text: str, at: np.ndarray) -> np.ndarray:
    """The depth of the similarity valley at each boundary."""
    if not len(at):
        return np.empty(0)
    ids: dict[str, int] = {}
    cols, rows = [], []
    starts = np.concatenate(([0], at, [len(text)]))
    for k in range(len(starts) - 1):
        for w in _WORD.findall(text[starts[k] : starts[k + 1]].lower()):
            cols.append(ids.setdefault(w, len(ids)))
            rows.append(k)
    units = len(starts) - 1
    row, col = np.array(rows, dtype=np.int64), np.array(cols, dtype=np.int64)
    sim = np.zeros(len(at))
    begin = np.searchsorted(row, np.arange(units + 1))
    for g in range(len(at)):  # the gap behind unit g
        a = col[begin[max(0, g + 1 - BLOCK)] : begin[g + 1]]
        b = col[begin[g + 1] : begin[min(units, g + 1 + BLOCK)]]
        if len(a) and len(b):
            ua, ca = np.unique(a, return_counts=True)
            ub, cb = np.unique(b, return_counts=True)
            _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
            sim[g] = (ca[ia] * cb[ib]).sum() / np.sqrt((ca**2).sum() * (cb**2).sum())
    # the peaks reached by climbing from each gap as long as the similarity does not fall
    left, right = sim.copy(), sim.copy()
    for g in range(1, len(sim)):
        if sim[g - 1] >= sim[g]:
            left[g] = max(left[g - 1], sim[g])
    for g in range(len(sim) - 2, -1, -1):
        if sim[g + 1] >= sim[g]:
            right[g] = max(right[g + 1], sim[g])
    return np.round((left - sim) + (right - sim), 9)  # equal depths are ties, whatever the order of the sums


def split_points(text: str, max_size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each piece; one piece for a text within the limit, none for an empty one."""
    if max_size < 1 or not 0 <= overlap < max_size:
        raise ValueError("0 <= overlap < max_size must hold")
    if not text:
        return []
    if len(text) <= max_size:
        return [(0, len(text))]
    at, rank = boundaries(text)
    depth = valley_depths(text, at)
    pieces, start = [], 0
    while len(text) - start > max_size:
        low, high = max(start + overlap + 1, start + int(max_size * LEAST)), start + max_size
        i, j = np.searchsorted(at, low), np.searchsorted(at, high, side="right")
        if j > i:
            end = int(at[i + np.lexsort((at[i:j], rank[i:j], depth[i:j]))[-1]])
        else:
            last = None
            for m in _SPACE.finditer(text, low - 1, high):
                if m.end() >= low:
                    last = m.end()
            end = last or high
        pieces.append((start, end))
        start = end - overlap
    pieces.append((start, len(text)))
    return pieces


def split_texts(df: DataFrame, text_col: str, max_size: int, overlap: int, out: str = "piece") -> DataFrame:
    """df without text_col, one row per piece, with the columns ``<out>_no, <out>_start, <out>_end, <out>_text``.

    Offsets count code points. Null texts give no row, empty ones neither; a text within the limit gives itself. Joined
    without each piece's first ``overlap`` characters (but the first's) the pieces are the text again. Columns of df with
    the names of the result are replaced.
    """
    made = [f"{out}_no", f"{out}_start", f"{out}_end", f"{out}_text"]
    kept = [f for f in df.schema.fields if f.name not in (text_col, *made)]
    schema = T.StructType([*kept, *(T.StructField(m, T.IntegerType()) for m in made[:3]), T.StructField(made[3], T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                rows = [(k, n, b, e, t[b:e]) for k, t in enumerate(part[text_col]) if t for n, (b, e) in enumerate(split_points(t, max_size, overlap))]
                own = part[[f.name for f in kept]].iloc[[r[0] for r in rows]].reset_index(drop=True)
                for c, name in enumerate(made):
                    own[name] = pd.Series([r[c + 1] for r in rows], dtype="object" if c == 3 else "int32")
                yield own

    return df.filter(F.length(text_col) > 0).select(*[f.name for f in kept], text_col).mapInPandas(run, schema)
