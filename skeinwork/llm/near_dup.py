"""Near-duplicate texts: anchor-point covering of MinHash fingerprints.

A text's fingerprint is a word of LENGTH MinHash symbols over the field of PRIME elements. The anchors are the
codewords of the Reed-Solomon code of dimension 2 over that field: the polynomials of degree at most one, read at
the points 0..LENGTH-1. Its covering radius is LENGTH - 2 and it is maximum-distance separable, so the anchors
within the covering radius of a word are exactly the lines through two of its symbols, LENGTH * (LENGTH - 1) / 2 of
them, and any two words at most LENGTH - 2 symbols apart (two symbols equal) share one. Every fingerprint is
copied to all its anchors; texts that meet at an anchor compare a sketch of 128 bits, and the pairs left are checked
exactly on their shingles.

What many texts share would make unlike texts meet, ever more of them the more texts there are. Two things are therefore left
out of the fingerprint (never of the similarity), both found by exact counts: lines that occur in a large share of all
texts (site furniture), and symbols that are the least of their place in a large share of the texts (usual phrases): the place then
takes its next least symbol. Texts with much furniture get a second fingerprint with it, by which only such texts meet: two texts
over the threshold whose furniture is WITH_ABOVE of one of them at most agree in enough of the rest.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.session import cut_lineage

LENGTH = 12
PRIME = (1 << 31) - 1
#: The fingerprint reads runs of this many words (of more if the similarity does), which unrelated texts hardly share;
#: texts under WIDE_FROM words are fingerprinted by the runs of the similarity itself, those under NARROW_TO by both. A text under
#: the first and one over the second number share less than LEAST_THRESHOLD, so no pair is parted by this.
WIDE, WIDE_FROM, NARROW_TO = 4, 40, 80
#: The sketch has two bits for each of 64 ranges of the hash space. Texts of the similarity 0.6 agree in 45 ranges on
#: average (standard deviation 3.7), unrelated ones in 16.
SKETCH_RANGES, SKETCH_LEAST = 64, 29
#: A line is furniture if it occurs in more than this share of the texts (and in at least FURNITURE_MIN). At most
#: (lines per text) / FURNITURE_SHARE lines can be, which bounds what is broadcast.
FURNITURE_SHARE, FURNITURE_MIN = 0.002, 30
#: A text with a larger part of furniture is also fingerprinted with it.
WITH_ABOVE = 0.4
#: A symbol is usual if it is the least of its place in more than this share of the texts (and in at least FURNITURE_MIN), so at most
#: 1 / SYMBOL_SHARE are, at each place. RANKS least symbols of each place are kept to choose from.
SYMBOL_SHARE, RANKS = 0.002, 4
LEAST_THRESHOLD = 0.5

_WORD = re.compile(r"[^\W_]+")
_I, _J = np.triu_indices(LENGTH, 1)
_INVERSE = np.array([0] + [pow(d, -1, PRIME) for d in range(1, LENGTH)], dtype=np.int64)
_M64 = (1 << 64) - 1


@functools.lru_cache(maxsize=1 << 17)
def _word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _seeds(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_SYMBOL_SEEDS = _seeds(LENGTH)
_PLACES = _seeds(64)
_RANGES = np.arange(SKETCH_RANGES, dtype=np.uint64)


def words_of(text: str) -> list[str]:
    """Maximal runs of letters and digits of the lower-cased text."""
    return _WORD.findall(text.lower())


def shingle_hashes(words: list[str], width: int) -> np.ndarray:
    """Hashes of the distinct runs of ``width`` words, sorted; fewer words than that give none."""
    if len(words) < width:
        return np.empty(0, dtype=np.uint64)
    w = np.array([_word_hash(x) for x in words], dtype=np.uint64)
    n = len(w) - width + 1
    h = w[:n] * _PLACES[0]
    for k in range(1, width):
        h ^= _mix(w[k : n + k] * _PLACES[k % len(_PLACES)] + h)
    return np.unique(_mix(h))


def least_symbols(shingles: np.ndarray) -> np.ndarray:
    """(LENGTH, RANKS): the least hashes of a non-empty shingle set at each place, ascending; the last is repeated if there are fewer."""
    kept = np.empty((LENGTH, 0), dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        h = _mix(shingles[at : at + 4096] ^ _SYMBOL_SEEDS[:, None]) >> np.uint64(33)
        kept = np.sort(np.concatenate((kept, h if h.shape[1] <= RANKS else np.partition(h, RANKS - 1, axis=1)[:, :RANKS]), axis=1), axis=1)[:, :RANKS]
    if kept.shape[1] < RANKS:
        kept = np.concatenate((kept, np.repeat(kept[:, -1:], RANKS - kept.shape[1], axis=1)), axis=1)
    return kept.astype(np.int64) % PRIME


def words_at(symbols: np.ndarray, usual: list[np.ndarray]) -> np.ndarray:
    """(texts, LENGTH): of the (texts, LENGTH, RANKS) least symbols, at each place the least that is not usual, else the last."""
    out = np.empty(symbols.shape[:2], dtype=np.int64)
    for p in range(LENGTH):
        known = np.isin(symbols[:, p, :], usual[p])
        out[:, p] = symbols[np.arange(len(symbols)), p, np.where(known.all(axis=1), RANKS - 1, known.argmin(axis=1))]
    return out


def anchors(words: np.ndarray) -> np.ndarray:
    """(texts, LENGTH * (LENGTH - 1) / 2): the anchors (as bigint keys) of each word; an anchor through more than two symbols is repeated."""
    slope = (words[:, _J] - words[:, _I]) % PRIME * _INVERSE[_J - _I] % PRIME
    return (slope << 31) | (words[:, _I] - slope * _I) % PRIME


def sketch(shingles: np.ndarray) -> tuple[int, int]:
    """Two bits of the least hash in each of 64 ranges of the hash space, as two signed bigints."""
    at = np.minimum(np.searchsorted(shingles, _RANGES << np.uint64(58)), len(shingles) - 1)
    own = shingles[at]
    held = (own >> np.uint64(58)) == _RANGES
    mixed = np.where(held, _mix(own), np.uint64(0))
    bits = np.packbits(np.stack((mixed & np.uint64(1), (mixed >> np.uint64(1)) & np.uint64(1))).astype(bool)).view(">i8")
    return int(bits[0]), int(bits[1])


def line_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.strip()) - (1 << 63)


def _fingerprint(text: str, width: int, furniture: frozenset) -> list[tuple[int, int, int, np.ndarray]]:
    """(kind, sketch, sketch, least symbols) of each fingerprint. kind: 1 with furniture, 2 by runs of the similarity's width."""
    words = words_of(text)
    if len(words) < width:
        return []
    choices = [(0, words)]
    if furniture and not furniture.isdisjoint(lines := [line_hash(x) for x in text.splitlines()]):
        kept = words_of("\n".join(x for x, h in zip(text.splitlines(), lines) if h not in furniture))
        choices = [(0, kept)] if len(kept) >= width else []
        if len(words) - len(kept) > WITH_ABOVE * len(words):
            choices.append((1, words))
    wide = max(width, WIDE)
    out = []
    for kind, own in choices:
        narrow = shingle_hashes(own, width)
        marks = sketch(narrow)
        if len(own) >= WIDE_FROM:
            out.append((kind, *marks, least_symbols(shingle_hashes(own, wide))))
        if len(own) < NARROW_TO:
            out.append((kind | 2, *marks, least_symbols(narrow)))
    return out


def _furniture(texts: DataFrame) -> frozenset:
    """Hashes of the lines in a large share of the different texts; exact counts over all rows of (digest, text).

    Rows are counted first; of the few lines that many rows have, copies of a text are then counted once.
    """

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [h for t in pdf["text"] for h in {line_hash(x) for x in t.splitlines() if x.strip()}]
            counts = pd.Series(found, dtype="int64").value_counts()
            yield pd.DataFrame({"line": counts.index.astype("int64"), "n": counts.to_numpy()})

    least = max(FURNITURE_MIN, int(FURNITURE_SHARE * texts.count()))
    counted = texts.select("text").mapInPandas(lines, "line long, n long").groupBy("line").agg(F.sum("n").alias("n"))
    often = frozenset(r.line for r in counted.filter(F.col("n") > least).select("line").toLocalIterator())
    if not often:
        return often

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = {(h, d) for d, t in zip(pdf["digest"], pdf["text"]) for x in t.splitlines() if (h := line_hash(x)) in often}
            yield pd.DataFrame(list(rows), columns=["line", "digest"])

    distinct = texts.mapInPandas(held, "line long, digest binary").distinct().groupBy("line").agg(F.count("*").alias("n"))
    return frozenset(r.line for r in distinct.filter(F.col("n") > least).select("line").toLocalIterator())


def _usual_symbols(prints: DataFrame) -> list[list[np.ndarray]]:
    """Per kind and place the usual symbols of ``kind, symbols``; at most 4 * LENGTH / SYMBOL_SHARE in all."""
    counts = {r.kind: r.n for r in prints.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    firsts = F.array(*[F.element_at("symbols", p * RANKS + 1) for p in range(LENGTH)])
    sums = prints.select("kind", F.posexplode(firsts).alias("p", "s")).groupBy("kind", "p", "s").agg(F.count("*").alias("n"))
    often = F.coalesce(*[F.when(F.col("kind") == k, F.col("n") > max(FURNITURE_MIN, int(SYMBOL_SHARE * n))) for k, n in counts.items()], F.lit(False))
    found: list[list[list[int]]] = [[[] for _ in range(LENGTH)] for _ in range(4)]
    for r in sums.filter(often).toLocalIterator():
        found[r.kind][r.p].append(r.s)
    return [[np.array(x, dtype=np.int64) for x in places] for places in found]


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """Pairs of representatives ``rep_a < rep_b`` (ids of df) of different texts, with their ``similarity``.

    The similarity is that of the sets of ``width``-word shingles (compared as 64-bit hashes); pairs with at least ``threshold`` (over
    LEAST_THRESHOLD) come out. Equal texts are one class, represented by its least id (see ``text_classes``). ids must be unique
    bigints. Null texts and texts of fewer than ``width`` words have no shingles and no partners; an empty table gives no pairs; other
    columns are ignored. Texts are read where they lie: fingerprints and pairs are shuffled, and the shingles of texts that met.
    Spark jobs run while the query is built.
    """
    if threshold <= LEAST_THRESHOLD:
        raise ValueError(f"the threshold must be over {LEAST_THRESHOLD}")
    base = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hashed = base.withColumn("digest", F.unhex(F.md5("text")))
    furniture = df.sparkSession.sparkContext.broadcast(_furniture(hashed.select("digest", "text")))

    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, d, k, a, b, s.ravel()) for i, d, t in zip(pdf["id"], pdf["digest"], pdf["text"]) for k, a, b, s in _fingerprint(t, width, furniture.value)]
            yield pd.DataFrame(rows, columns=["id", "digest", "kind", "s1", "s2", "symbols"])

    raw = hashed.mapInPandas(prints, "id long, digest binary, kind int, s1 long, s2 long, symbols array<int>")
    reps = cut_lineage(raw.groupBy("digest", "kind").agg(F.min_by(F.struct("id", "s1", "s2", "symbols"), "id").alias("r")).select("kind", "r.*"))
    usual = df.sparkSession.sparkContext.broadcast(_usual_symbols(reps.select("kind", "symbols")))

    def copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                symbols = np.stack(part["symbols"].to_list()).astype(np.int64).reshape(-1, LENGTH, RANKS)
                kinds = part["kind"].to_numpy()
                for k in np.unique(kinds):
                    own = kinds == k
                    found = anchors(words_at(symbols[own], usual.value[k]))
                    yield pd.DataFrame({"kind": k, "id": part["id"][own], "s1": part["s1"][own], "s2": part["s2"][own], "anchors": list(found)})

    copied = reps.mapInPandas(copies, "kind int, id long, s1 long, s2 long, anchors array<long>")
    copied = copied.select("id", "s1", "s2", "kind", F.explode(F.array_distinct("anchors")).alias("a"))
    copied = copied.select(F.xxhash64("a", "kind").alias("anchor"), "id", "s1", "s2")
    a = copied.select("anchor", F.col("id").alias("rep_a"), F.col("s1").alias("p1"), F.col("s2").alias("p2"))
    b = copied.select("anchor", F.col("id").alias("rep_b"), F.col("s1").alias("q1"), F.col("s2").alias("q2"))
    unlike = F.bit_count(F.col("p1").bitwiseXOR(F.col("q1")).bitwiseOR(F.col("p2").bitwiseXOR(F.col("q2"))))
    met = a.join(b.hint("merge"), "anchor").filter((F.col("rep_a") < F.col("rep_b")) & (unlike <= SKETCH_RANGES - SKETCH_LEAST))
    met = cut_lineage(met.select("rep_a", "rep_b").distinct())

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "grams": [shingle_hashes(words_of(t), width).view(np.int64) for t in pdf["text"]]})

    # the ids that met are written, so that their size is known when the join is planned: few of them are sent to the texts
    ids = cut_lineage(met.select(F.col("rep_a").alias("id")).union(met.select("rep_b")).distinct())
    grams = base.join(ids, "id", "left_semi").select("id", "text").mapInPandas(shingles, "id long, grams array<long>")
    grams = cut_lineage(grams)
    sides = met.join(grams.select(F.col("id").alias("rep_a"), F.col("grams").alias("ga")), "rep_a")
    sides = sides.join(grams.select(F.col("id").alias("rep_b"), F.col("grams").alias("gb")), "rep_b")
    both = F.size(F.array_intersect("ga", "gb"))
    scored = sides.select("rep_a", "rep_b", (both / (F.size("ga") + F.size("gb") - both)).alias("similarity"))
    return scored.filter(F.col("similarity") >= threshold)


def text_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, rep``: each row with non-null text and the least id among the rows of exactly the same text."""
    rows = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.unhex(F.md5(text_col)).alias("digest"))
    return rows.join(rows.groupBy("digest").agg(F.min("id").alias("rep")), "digest").select("id", "rep")
