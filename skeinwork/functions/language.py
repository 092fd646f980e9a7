"""Languages of the content plane: a guess by scripts and frequent words, and profiles of three-letter sequences trained on labelled texts.

The guess needs no data and knows the languages listed here; profiles know every language that a labelled table holds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.session import cut_lineage

MIN_BYTES, MIN_CONFIDENCE = 50, 0.8

# fixed values: frequent words of each language, and scripts that name one
WORDS = {
    "en": "the of and to in is that for it with as was on are by this be from or at an not have which their you",
    "fr": "le la les de des du et en un une que qui dans pour sur est pas au avec par il elle ce cette sont",
    "de": "der die das und in den von zu mit ist ein eine des dem nicht für auf als auch sich an es werden",
    "es": "el la los las de del y en que un una por con para es se no al como más su lo este esta pero",
    "it": "il lo la gli le di del della e in che un una per con non è sono si da al come più nel questo",
    "pt": "o a os as de do da dos das e em que um uma para com não por no na se mais como ao pelo",
    "nl": "de het een en van in is dat op te voor met niet zijn aan er om ook als bij door naar uit",
    "sv": "och att det som en ett är på för av med den till har inte om de var från kan",
    "da": "og at det som en et er på for af med den til har ikke om de var fra kan jeg",
    "pl": "i w na z do się że nie to jest od za przez po jak dla oraz są być który",
    "tr": "ve bir bu için ile da de olarak çok daha en gibi kadar sonra ama olan",
}
SCRIPTS = {"ru": "Ѐ-ӿ", "el": "Ͱ-Ͽ", "ar": "؀-ۿ", "he": "֐-׿", "hi": "ऀ-ॿ", "th": "฀-๿", "ko": "가-힯", "ja": "぀-ヿ", "zh": "一-鿿"}
_BEYOND = re.compile("[\u0370-\uffff]")
_WORD = re.compile(r"[^\W\d_]+")
_SETS = {code: frozenset(words.split()) for code, words in WORDS.items()}


def detect(text: str | None, least: float = MIN_CONFIDENCE) -> tuple[str | None, float]:
    """(code, confidence); the code is None for texts under 50 bytes and where the confidence is under ``least``."""
    if not text or len(text.encode()) < MIN_BYTES:
        return None, 0.0
    if len(_BEYOND.findall(text)) > 0.2 * len(text):  # else no script can reach its share of the letters
        letters = sum(c.isalpha() for c in text)
        for code, span in SCRIPTS.items():
            n = len(re.findall(f"[{span}]", text))
            if letters and n > 0.4 * letters:
                return code, min(1.0, 0.5 + n / letters / 2)
    counts = Counter(_WORD.findall(text.lower()))
    scores = {code: sum(counts[w] for w in words) for code, words in _SETS.items()}
    best = max(scores, key=scores.__getitem__)
    rest = max(v for k, v in scores.items() if k != best)
    confidence = 0.0 if not scores[best] else scores[best] ** 2 / (scores[best] ** 2 + rest**2)
    return (best if confidence >= least else None), confidence


#: Bounds of the training of profiles: labelled rows per language (chosen by a hash of the text) and sequences kept per language.
PROFILE_ROWS, PROFILE_SIZE = 2000, 3000
_LETTERS = re.compile(r"[^\W\d_]+")


def _sequences(text: str) -> Counter:
    """Sequences of three letters, a space standing before and after each word."""
    out: Counter = Counter()
    for word, n in Counter(_LETTERS.findall(text.lower())).items():
        padded = f" {word} "
        for k in range(len(padded) - 2):
            out[padded[k : k + 3]] += n
    return out


@dataclass
class Profiles:
    """Log probabilities of the usual sequences of each language, and that of any other."""

    known: dict[str, dict[str, float]]
    other: dict[str, float]

    def detect(self, text: str | None, least: float = MIN_CONFIDENCE) -> tuple[str | None, float]:
        """(code, confidence) as of ``detect``; the confidence is the probability of the best language over all of them."""
        if not text or len(text.encode()) < MIN_BYTES or not self.known:
            return None, 0.0
        found = _sequences(text)
        if not found:
            return None, 0.0
        sums = {c: sum(n * own.get(x, self.other[c]) for x, n in found.items()) for c, own in self.known.items()}
        best = max(sums, key=sums.__getitem__)
        # neighbouring sequences are not independent: their evidence is damped by a third
        confidence = 1.0 / sum(math.exp(max(-700.0, (v - sums[best]) / 3)) for v in sums.values())
        return (best if confidence >= least else None), confidence


def train_profiles(df: DataFrame, text_col: str, label_col: str) -> Profiles:
    """Profiles of every language of df with a label (two or more letters, region and case aside).

    Sequences are counted on the executors and combined per task; the driver gets at most PROFILE_SIZE of each language. Null
    texts and labels do not count; without any labelled text nothing is ever detected.
    """
    code = F.regexp_extract(F.lower(F.trim(label_col)), "^([a-z]{2,})(?:[-_].*)?$", 1)
    own = df.filter(F.length(text_col) > 0).select(code.alias("code"), F.col(text_col).alias("text")).filter("code <> ''")
    sizes = {r.code: r.n for r in own.groupBy("code").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Profiles({}, {})
    share = F.coalesce(*[F.when(F.col("code") == c, F.lit(min(1.0, PROFILE_ROWS / n))) for c, n in sizes.items()])
    picked = own.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < share * 1_000_003)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums: dict[str, Counter] = {}
            for c, t in zip(pdf["code"], pdf["text"]):
                sums.setdefault(c, Counter()).update(_sequences(t))
            yield pd.DataFrame([(c, x, n) for c, own in sums.items() for x, n in own.items()], columns=["code", "seq", "n"])

    counts = picked.mapInPandas(count, "code string, seq string, n long").groupBy("code", "seq").agg(F.sum("n").alias("n"))
    return _profiles(cut_lineage(counts))  # small, and read once per language


def _profiles(counts: DataFrame) -> Profiles:
    totals = {r.code: (r.all, r.kinds) for r in counts.groupBy("code").agg(F.sum("n").alias("all"), F.count("*").alias("kinds")).collect()}
    known: dict[str, dict[str, float]] = {}
    other: dict[str, float] = {}
    for c, (n, kinds) in totals.items():
        top = counts.filter(F.col("code") == c).orderBy(F.desc("n"), "seq").limit(PROFILE_SIZE).collect()
        known[c] = {r.seq: math.log((r.n + 0.5) / (n + kinds)) for r in top}
        other[c] = math.log(0.5 / (n + kinds))
    return Profiles(known, other)
