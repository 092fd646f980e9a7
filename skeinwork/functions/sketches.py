"""SimHash and MinHash of texts, on Arrow batches with numpy; 64-bit values are stored as signed bigints (same bits).

Token hashes: ``sip13`` (SipHash-1-3 with zero keys over the UTF-8 bytes and a closing 0xFF byte), ``xxhash64`` (fast) and
``md5hex`` (the first 16 hex digits of the MD5 digest, which other engines have as well).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

_U = np.uint64
SEED_BASE = 0x12345678


def _blocks(messages: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit words of each message, its length in the last one's top byte; how many words each has."""
    n = len(messages)
    lengths = np.fromiter(map(len, messages), dtype=np.int64, count=n)
    blocks = lengths // 8 + 1
    width = 8 * (int(blocks.max()) if n else 0)
    words = np.frombuffer(b"".join(m.ljust(width, b"\0") for m in messages), dtype="<u8").astype(np.uint64).reshape(n, -1)
    words[np.arange(n), blocks - 1] |= (lengths.astype(np.uint64) & _U(0xFF)) << _U(56)
    return words, blocks


def sip13(messages: list[bytes], k0: int | np.ndarray = 0, k1: int | np.ndarray = 0) -> np.ndarray:
    """SipHash-1-3 of each message; with arrays of keys a column for each pair of keys."""
    words, blocks = _blocks(messages)
    k0, k1 = np.asarray(k0, dtype=np.uint64), np.asarray(k1, dtype=np.uint64)
    shape = (len(messages), *k0.shape)
    # fixed values: the constants of the published algorithm
    v = [np.broadcast_to(k ^ _U(c), shape).copy() for k, c in ((k0, 0x736F6D6570736575), (k1, 0x646F72616E646F6D), (k0, 0x6C7967656E657261), (k1, 0x7465646279746573))]

    def rotate(x: np.ndarray, b: int) -> np.ndarray:
        return (x << _U(b)) | (x >> _U(64 - b))

    def rounds(s: list[np.ndarray], count: int) -> None:
        for _ in range(count):
            s[0] = s[0] + s[1]
            s[2] = s[2] + s[3]
            s[1] = rotate(s[1], 13) ^ s[0]
            s[3] = rotate(s[3], 16) ^ s[2]
            s[0] = rotate(s[0], 32)
            s[2] = s[2] + s[1]
            s[0] = s[0] + s[3]
            s[1] = rotate(s[1], 17) ^ s[2]
            s[3] = rotate(s[3], 21) ^ s[0]
            s[2] = rotate(s[2], 32)

    with np.errstate(over="ignore"):
        for b in range(words.shape[1]):
            live = np.flatnonzero(b < blocks)
            word = words[live, b].reshape(-1, *[1] * k0.ndim)
            s = [x[live] for x in v]
            s[3] = s[3] ^ word
            rounds(s, 1)
            s[0] = s[0] ^ word
            for k in range(4):
                v[k][live] = s[k]
        v[2] = v[2] ^ _U(0xFF)
        rounds(v, 3)
    return v[0] ^ v[1] ^ v[2] ^ v[3]


def token_hashes(tokens: list[str], kind: str = "sip13") -> np.ndarray:
    if kind == "sip13":
        messages = [t.encode() + b"\xff" for t in tokens]
        out = np.empty(len(messages), dtype=np.uint64)
        # alike lengths together, so that one long token does not widen all
        sizes = np.fromiter((len(m) // 8 + 1 for m in messages), dtype=np.int64, count=len(messages))
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            out[own] = sip13([messages[i] for i in own])
        return out
    if kind == "xxhash64":
        return np.array([xxhash.xxh64_intdigest(t) for t in tokens], dtype=np.uint64)
    if kind == "md5hex":
        return np.array([int(hashlib.md5(t.encode()).hexdigest()[:16], 16) for t in tokens], dtype=np.uint64)
    raise ValueError(f"unknown token hash {kind}")


def normal_words(text: str) -> list[str]:
    """Words of the text in lower case with all but letters, digits and white space deleted (not spaced)."""
    return "".join([c for c in text.lower() if c.isalnum() or c.isspace()]).split()


def shingles(text: str) -> list[str]:
    """Runs of three words, with repetitions; the words themselves if there are fewer than three."""
    w = normal_words(text)
    return [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else w


def simhash_many(token_lists: list[list[str]], kind: str = "sip13") -> list[int]:
    """The majority of each bit over each list's token hashes; ties and empty lists give 0 bits."""
    sizes = np.fromiter(map(len, token_lists), dtype=np.int64, count=len(token_lists))
    out = [0] * len(token_lists)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    h = token_hashes([t for tokens in token_lists for t in tokens], kind)
    starts = (np.cumsum(sizes) - sizes)[full]
    ones = np.stack([np.add.reduceat(((h >> _U(63 - b)) & _U(1)).astype(np.int64), starts) for b in range(64)], axis=1)
    found = np.packbits(2 * ones > sizes[full][:, None], axis=1).view(">i8")[:, 0]
    for k, v in zip(full.tolist(), found.tolist()):
        out[k] = v
    return out


def simhash_tokens(tokens: list[str], kind: str = "sip13") -> int:
    return simhash_many([tokens], kind)[0]


def simhash(text: Column | str, kind: str = "sip13") -> Column:
    """SimHash of a text as bigint; 0 for texts without words, null for null."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        out: list[int | None] = []
        for at in range(0, len(texts), 256):
            part = texts.iloc[at : at + 256].tolist()
            found = simhash_many([[] if t is None else shingles(t) for t in part], kind)
            out += [None if t is None else h for t, h in zip(part, found)]
        return pd.Series(out, dtype="Int64")

    return run.asNondeterministic()(text)


def hamming(a: Column | str, b: Column | str) -> Column:
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.bit_count(x.bitwiseXOR(y))


def minhash_signature(tokens: set[str], n: int = 128, base: int = SEED_BASE) -> list[int]:
    """The least keyed SipHash of the tokens under each of n seed pairs, as unsigned numbers; all ones without tokens."""
    if not tokens:
        return [(1 << 64) - 1] * n
    m = (1 << 64) - 1
    k0 = np.array([(base * (i + 1)) & m for i in range(n)], dtype=np.uint64)
    k1 = np.array([(base * (i + n + 1)) & m for i in range(n)], dtype=np.uint64)
    least = np.full(n, m, dtype=np.uint64)
    messages = [t.encode() + b"\xff" for t in sorted(tokens)]
    for at in range(0, len(messages), 256):
        least = np.minimum(least, sip13(messages[at : at + 256], k0, k1).min(axis=0))
    return least.tolist()


def minhash(text: Column | str, n: int = 128) -> Column:
    """MinHash signature of the set of a text's shingles, as array<bigint> (same bits); null for null."""

    @F.pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else np.array(minhash_signature(set(shingles(t)), n), dtype=np.uint64).view(np.int64) for t in texts])

    return run.asNondeterministic()(text)


def estimated_jaccard(a: Column | str, b: Column | str) -> Column:
    """Share of equal positions of two signatures; 0 if their lengths differ."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    equal = F.aggregate(F.zip_with(x, y, lambda p, q: F.when(p == q, 1).otherwise(0)), F.lit(0), lambda s, e: s + e)
    return F.when((F.size(x) == F.size(y)) & (F.size(x) > 0), equal / F.size(x)).otherwise(F.lit(0.0))


def band_hashes(signature: Column | str, bands: int = 16, n: int = 128) -> Column:
    """One hash per band of n / bands positions, as array of ``band, hash``."""
    s = F.col(signature) if isinstance(signature, str) else signature
    rows = n // bands
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(F.slice(s, b * rows + 1, rows)).alias("hash")))
