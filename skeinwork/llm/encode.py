"""Token ids of whole texts by a public byte-level BPE, long texts by tree concatenation.

A text over LEAF characters is cut in halves, down to leaves; the leaves are encoded in parallel threads (the
tokenizer releases the interpreter lock) and joined pairwise. Two properties make the joins exact:

* The splitting pattern is matched from left to right without look-behind, so once a scan of the joined text
  arrives at a position where the right half also has a piece boundary, both agree to the end. A boundary in the left
  half stands if at least MARGIN characters and a whole piece follow it, for the pattern looks at most that far ahead.
  The window around a join is re-encoded and doubled until such boundaries are found on both sides; the ids of the halves
  outside it stay as they are.
* Within one unsplit piece, a token sequence is the encoding of its bytes if and only if every two neighbouring
  tokens are the encoding of their concatenation. Halves of a piece are joined by re-encoding a window of
  tokens around the join, doubled until its first token is the left half's and its last token the right half's.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS_DIR = os.environ.get("SKEINWORK_TOKENIZERS", "/opt/tokenizers")
# fixed value: the pattern that splits text before the merges of the byte-level vocabularies
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 1024
PIECE_LEAF = 512
MARGIN = 3
WINDOW = 64

_SPLIT = regex.compile(PATTERN)
#: No piece goes on with a space after a character that is none, so between these there is always a boundary.
_SURE = regex.compile(r"\S(?=\s)")


@functools.lru_cache(maxsize=4)
def tokenizer(name: str, folder: str = TOKENIZERS_DIR) -> tiktoken.Encoding:
    """A vocabulary of ranks by file name without ending; ids as in the file, no special tokens."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode_piece(enc: tiktoken.Encoding, piece: bytes, leaf: int = PIECE_LEAF) -> list[int]:
    """The ids of one unsplit piece (no splitting pattern), by tree concatenation over ``leaf`` bytes."""
    if len(piece) <= max(leaf, 2):
        return enc._encode_single_piece(piece)
    half = len(piece) // 2
    left, right = encode_piece(enc, piece[:half], leaf), encode_piece(enc, piece[half:], leaf)
    w = 4
    while True:
        i, j = max(0, len(left) - w), min(len(right), w)
        middle = enc._encode_single_piece(enc.decode_bytes(left[i:] + right[:j]))
        left_ok = i == 0 or (middle[0] == left[i] and len(middle) > 1)
        right_ok = j == len(right) or (middle[-1] == right[j - 1] and len(middle) > 1)
        if left_ok and right_ok:
            return left[:i] + middle + right[j:]
        w *= 2


class _Encoded:
    """A stretch of text and its ids."""

    __slots__ = ("text", "ids")

    def __init__(self, text: str, ids: list[int]):
        self.text, self.ids = text, ids


def _leaf(enc: tiktoken.Encoding, text: str) -> _Encoded:
    return _Encoded(text, enc.encode_ordinary(text))


def _pieces(enc: tiktoken.Encoding, text: str, begin: int, stop: int) -> tuple[list[int], list[list[int]]]:
    """Where each unsplit piece of text[begin:stop] ends, and its ids."""
    ends, ids = [], []
    for m in _SPLIT.finditer(text, begin, stop):
        ends.append(m.end())
        ids.append(encode_piece(enc, m.group().encode("utf-8", "replace")))
    return ends, ids


def _last_piece(enc: tiktoken.Encoding, a: _Encoded) -> tuple[int, int]:
    """(character, id) offset of a boundary of a that stands whatever follows: a whole piece and MARGIN characters lie behind it."""
    n, w = len(a.text), WINDOW
    while w < n:
        sure = _SURE.search(a.text, n - w, n)
        if sure:
            ends, ids = _pieces(enc, a.text, sure.end(), n)
            for k in range(len(ends) - 2, -2, -1):
                at = ends[k] if k >= 0 else sure.end()
                if n - at >= MARGIN and k + 1 < len(ends) - 1:
                    return at, len(a.ids) - sum(map(len, ids[k + 1 :]))
        w *= 2
    return 0, 0


def _join(enc: tiktoken.Encoding, a: _Encoded, b: _Encoded) -> _Encoded:
    n, text = len(a.text), a.text + b.text
    begin, kept = _last_piece(enc, a)
    w = WINDOW
    while True:
        stop = min(len(text), n + w)
        mine, mine_ids = _pieces(enc, text, begin, stop)
        right, right_ids = _pieces(enc, b.text, 0, stop - n)
        sums = {0: 0}
        for k, end in enumerate(right):
            if stop == len(text) or (k + 1 < len(right) - 1 and stop - n - end >= MARGIN):
                sums[end] = sum(map(len, right_ids[: k + 1]))
        for k, end in enumerate(mine):
            whole = stop == len(text) or (k + 1 < len(mine) - 1 and stop - end >= MARGIN)
            if end >= n and whole and end - n in sums:
                return _Encoded(text, a.ids[:kept] + [x for ids in mine_ids[: k + 1] for x in ids] + b.ids[sums[end - n] :])
        w *= 2


def encode_text(enc: tiktoken.Encoding, text: str | None, leaf: int = LEAF, pool: ThreadPoolExecutor | None = None) -> list[int]:
    """The ids of a whole text; [] for null and empty texts."""
    if not text:
        return []
    if len(text) <= leaf:
        return enc.encode_ordinary(text)
    cuts = [text]
    while len(cuts[0]) > leaf:
        cuts = [x for c in cuts for x in (c[: len(c) // 2], c[len(c) // 2 :])]
    parts = list((pool.map if pool else map)(functools.partial(_leaf, enc), cuts))
    while len(parts) > 1:
        parts = [_join(enc, parts[k], parts[k + 1]) for k in range(0, len(parts), 2)]
    return parts[0].ids


def encode_corpus(df: DataFrame, text_col: str, out_col: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZERS_DIR) -> DataFrame:
    """df without text_col and with out_col, the ids of each text: ``[]`` for null and for empty texts.

    No special tokens are made; their strings are ordinary text. Other columns stay as they are (one named out_col is replaced).
    """
    kept = [f for f in df.schema.fields if f.name not in (text_col, out_col)]
    schema = T.StructType([*kept, T.StructField(out_col, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokenizer(name, folder)
        with ThreadPoolExecutor(2) as pool:
            for pdf in batches:
                for at in range(0, max(len(pdf), 1), 512):
                    part = pdf.iloc[at : at + 512]
                    ids = [encode_text(enc, t, pool=pool) for t in part[text_col]]
                    yield part[[f.name for f in kept]].assign(**{out_col: ids})

    return df.select(*[f.name for f in kept], text_col).mapInPandas(run, schema)


def token_counts(df: DataFrame, text_col: str, out_col: str = "n_tokens", name: str = "byte_bpe_50k", folder: str = TOKENIZERS_DIR) -> DataFrame:
    """df with the number of ids of each text (0 for null and empty texts)."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        enc = tokenizer(name, folder)
        return pd.Series([len(encode_text(enc, t)) for t in texts], dtype="int32")

    return df.withColumn(out_col, count(F.col(text_col)))


def decode_ids(df: DataFrame, ids_col: str, out_col: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS_DIR) -> DataFrame:
    """df with out_col, the text of the ids: the way back of ``encode_corpus``. Null ids give null, none give an empty text."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        enc = tokenizer(name, folder)
        return pd.Series([None if x is None else enc.decode([int(k) for k in x]) for x in ids], dtype="object")

    return df.withColumn(out_col, text(F.col(ids_col)))
