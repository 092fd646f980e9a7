"""Language of texts and of their lines by a byte convolutional network in numpy.

Texts are cut into windows of WINDOW bytes. A byte has a learned vector; filters of several widths slide over the window,
each filter's greatest response over the window is kept, and a softmax layer turns the responses into a probability
per language. The network is trained on the driver on a bounded sample of labelled rows (TRAIN_ROWS per language, TRAIN_TOTAL in all), with
labels the network itself contradicts taken out between two rounds, and broadcast (about 100 KB). Training and inference
are batched matrix products; texts are never walked row by row.

A record's lines are joined into one sequence by their log-probabilities with a price for changing the language (Viterbi), so that
a short line takes the language of its surroundings unless it clearly speaks another.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 96
WIDTHS = (3, 5)
FILTERS, EMBEDDING = 32, 8
#: Bound on the labelled rows used per language, and on the characters used of each (in TRAIN_PARTS pieces from all over the text).
TRAIN_ROWS, TRAIN_CHARS, TRAIN_PARTS = 400, 1536, 4
#: Bound on the labelled rows used in all, shared alike by the languages, so what the driver holds does not grow with their number.
TRAIN_TOTAL = 8000
#: Texts of so many characters are preferred for training; shorter ones fill up what a language lacks.
PREFERRED = 300
SWITCH_COST = 6.0
#: Windows per training step, and the least number of steps (small samples are gone through more often).
BATCH, LEAST_STEPS = 128, 1000


@dataclass
class Model:
    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def responses(self, windows: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Per width: the unrolled inputs, where each filter's greatest response is; all greatest responses."""
        e = self.embedding[windows]
        cols, peaks, kept = [], [], []
        for w, f, b in zip(WIDTHS, self.filters, self.biases):
            unrolled = _unrolled(e, w)
            r = unrolled @ f
            at = r.argmax(axis=1)
            top = np.take_along_axis(r, at[:, None, :], axis=1)[:, 0, :] + b
            cols.append(unrolled)
            peaks.append(at)
            kept.append(np.maximum(top, 0))
        return cols, peaks, np.concatenate(kept, axis=1)

    def log_probabilities(self, windows: np.ndarray, batch: int = 64) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)), dtype=np.float32)
        for at in range(0, len(windows), batch):
            e = self.embedding[windows[at : at + batch]]
            kept = [np.maximum((_unrolled(e, w).reshape(-1, w * EMBEDDING) @ f).reshape(len(e), -1, FILTERS).max(axis=1) + b, 0) for w, f, b in zip(WIDTHS, self.filters, self.biases)]
            z = np.concatenate(kept, axis=1) @ self.out + self.out_bias
            z -= z.max(axis=1, keepdims=True)
            out[at : at + batch] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out


def _unrolled(e: np.ndarray, w: int) -> np.ndarray:
    """(windows, positions, w * EMBEDDING): the vectors of w neighbouring bytes side by side."""
    n, length, d = e.shape
    s = e.strides
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(e, (n, length - w + 1, w * d), (s[0], s[1], s[2])))


def windows_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, in order, and the text each belongs to. Digits become 0 and white space a space;
    a text is padded with spaces to whole windows; one without any letter has no window."""
    parts = []
    for text in texts:
        low = text.lower()
        data = (_CODE.sub(" ", low) if _SIGNS.search(low) else low).encode("utf-8", "ignore")
        parts.append(data + b" " * (-len(data) % WINDOW))
    owner = np.repeat(np.arange(len(parts)), [len(p) // WINDOW for p in parts])
    windows = _CLASSES[np.frombuffer(b"".join(parts), dtype=np.uint8)].reshape(-1, WINDOW)
    kept = np.bincount(owner, weights=_LETTER[windows].any(axis=1), minlength=len(parts))[owner] > 0
    return windows[kept], owner[kept]


#: Runs of characters that are no words of any language: encoded data, addresses, code.
_CODE = re.compile(r"\S{33,}|https?:\S+|\S*\w[_=(){}\[\]<>/\\|#@&;+]\w\S*")
_SIGNS = re.compile(r"[_=(){}\[\]<>/\\|#@&;+]|\S{33}")
_CLASSES = np.arange(256, dtype=np.uint8)
_CLASSES[:33] = 32
_CLASSES[ord("0") : ord("9") + 1] = ord("0")
_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True


def _fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    n_out = len(WIDTHS) * FILTERS
    m = Model(
        languages,
        rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
        [rng.normal(0, 1 / np.sqrt(EMBEDDING * w), (EMBEDDING * w, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS],
        rng.normal(0, 1 / np.sqrt(n_out), (n_out, len(languages))).astype(np.float32),
        np.zeros(len(languages), dtype=np.float32),
    )
    params = [m.embedding, *m.filters, *m.biases, m.out, m.out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, batch = 0, BATCH
    counts = np.bincount(labels, minlength=len(languages)).astype(np.float32)
    weight = (counts.sum() / np.maximum(counts, 1) / len(languages))[labels].clip(0.2, 20)
    total = epochs * -(-len(windows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            x, y = windows[own], labels[own]
            cols, peaks, h = m.responses(x)
            z = h @ m.out + m.out_bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            dz = p * weight[own][:, None] / len(y)
            grads_out, grads_bias = h.T @ dz, dz.sum(axis=0)
            dh = (dz @ m.out.T) * (h > 0)
            d_embedding = np.zeros_like(m.embedding)
            d_filters, d_biases = [], []
            for k, (w, f) in enumerate(zip(WIDTHS, m.filters)):
                g = dh[:, k * FILTERS : (k + 1) * FILTERS]
                picked = np.take_along_axis(cols[k], peaks[k][:, :, None], axis=1)  # n, filters, d*w
                d_filters.append(np.einsum("nf,nfc->cf", g, picked))
                d_biases.append(g.sum(axis=0))
                back = (g[:, :, None] * f.T[None]).reshape(len(y), FILTERS, w, EMBEDDING)
                at_byte = peaks[k][:, :, None] + np.arange(w)
                which = np.take_along_axis(x[:, None, :].repeat(FILTERS, 1), at_byte, axis=2)
                np.add.at(d_embedding, which.reshape(-1), back.reshape(-1, EMBEDDING))
            step += 1
            rate = 0.01 * (1 - 0.9 * step / total)
            for p_, g_, a, b in zip(params, [d_embedding, *d_filters, *d_biases, grads_out, grads_bias], first, second):
                a += 0.1 * (g_ - a)
                b += 0.01 * (g_ * g_ - b)
                p_ -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
    return m


def train(texts: list[str], labels: list[str], languages: list[str], epochs: int = 5, seed: int = 7) -> Model:
    """A model of labelled texts, some of whose labels may be wrong: a first model's contradictions are left out of the second."""
    windows, owner = windows_of(texts)
    index = {c: k for k, c in enumerate(languages)}
    y = np.array([index[c] for c in labels], dtype=np.int64)[owner]
    first = _fit(windows, y, languages, max(2, -(-LEAST_STEPS * BATCH // 2 // max(1, len(windows)))), seed)
    lp = first.log_probabilities(windows)
    score = np.zeros((len(texts), len(languages)))
    np.add.at(score, owner, lp)
    agrees = score.argmax(axis=1) == np.array([index[c] for c in labels])
    own_window = lp.argmax(axis=1) == y  # windows in another language than the text's are left out as well
    kept = agrees[owner] & own_window
    return _fit(windows[kept], y[kept], languages, max(epochs, -(-LEAST_STEPS * BATCH // max(1, int(kept.sum())))), seed + 1)


def label_code(label) -> Column:
    """The code of a label, without letter case and region."""
    return F.regexp_extract(F.lower(F.trim(label)), "^([a-z]+)(?:[-_].*)?$", 1)


def training_rows(df: DataFrame, text_col: str, label_col: str, languages: list[str]) -> list:
    """``code, text`` of at most TRAIN_ROWS different labelled texts per language (TRAIN_TOTAL in all), chosen by a hash of the text."""
    known = sorted({x.lower() for x in languages})
    most = max(1, min(TRAIN_ROWS, TRAIN_TOTAL // max(1, len(known))))
    size, step = TRAIN_CHARS // TRAIN_PARTS, (F.length("t") - F.lit(TRAIN_CHARS // TRAIN_PARTS)) / (TRAIN_PARTS - 1)
    pieces = F.concat_ws("\n", *[F.substring("t", F.floor(step * k).cast("int") + 1, F.lit(size)) for k in range(TRAIN_PARTS)])
    own = df.filter(F.length(text_col) > 0).select(F.col(text_col).alias("t"), label_code(F.col(label_col)).alias("code")).filter(F.col("code").isin(known))
    own = own.select("t", "code", F.xxhash64("t").alias("h"), (F.length("t") >= PREFERRED).alias("long"))
    counts: dict[tuple[str, bool], int] = {(r.code, r.long): r.n for r in own.groupBy("code", "long").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return []
    # hash thresholds keep about as many texts as wanted without sorting; the limit makes the bound sure
    wanted = {}
    for code in {c for c, _ in counts}:
        rest = most
        for preferred in (True, False):
            n = counts.get((code, preferred), 0)
            if n:
                wanted[code, preferred] = min(1.0, (1.3 * rest + 20) / n) if rest else 0.0
            rest = max(0, rest - n)
    share = F.coalesce(*[F.when((F.col("code") == c) & (F.col("long") == x), F.lit(s)) for (c, x), s in wanted.items()])
    place = F.pmod("h", F.lit(1_000_003))
    picked = own.filter(place < share * 1_000_003).select("code", "h", "long", F.when(F.length("t") <= TRAIN_CHARS, F.col("t")).otherwise(pieces).alias("text"))
    picked = picked.groupBy("code", "h").agg(F.first("long").alias("long"), F.first("text").alias("text"))  # copies of a text are one
    first = Window.partitionBy("code").orderBy(F.desc("long"), "h")  # of the few picked
    return picked.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= most).select("code", "text").collect()


def train_on(df: DataFrame, text_col: str, label_col: str, languages: list[str]) -> Model | None:
    """Train on ``training_rows``. None without any labelled text; a language without any is not known to the model."""
    rows = sorted(training_rows(df, text_col, label_col, languages))
    if not rows:
        return None
    return train([r.text for r in rows], [r.code for r in rows], sorted({r.code for r in rows}))


def line_scores(model: Model, lines: list[str]) -> np.ndarray:
    """Mean log-probabilities of each line times the number of its windows; zeros for lines without letters."""
    windows, owner = windows_of(lines)
    out = np.zeros((len(lines), len(model.languages)), dtype=np.float64)
    if len(windows):
        lp = model.log_probabilities(windows).astype(np.float64)
        filled = (windows != 32).sum(axis=1) / WINDOW  # a window that is mostly padding says less
        np.add.at(out, owner, lp * np.minimum(1.0, 1.5 * filled)[:, None])
    return out


def best_path(scores: np.ndarray, cost: float = SWITCH_COST) -> np.ndarray:
    """The language of each line, of the sequence with the greatest sum of scores less ``cost`` per change."""
    n, k = scores.shape
    back = np.zeros((n, k), dtype=np.int64)
    total = scores[0].copy() if n else np.zeros(k)
    for i in range(1, n):
        top = total.argmax()
        change = total[top] - cost
        stay = total >= change
        back[i] = np.where(stay, np.arange(k), top)
        total = np.where(stay, total, change) + scores[i]
    path = np.empty(n, dtype=np.int64)
    if n:
        path[-1] = total.argmax()
        for i in range(n - 1, 0, -1):
            path[i - 1] = back[i, path[i]]
    return path


def segments(model: Model, text: str, scores: np.ndarray | None = None, lines: list[str] | None = None) -> list[tuple[int, str, float, int, int]]:
    """(seg_no, language, confidence, first line, last line) of the maximal runs of non-blank lines in one language."""
    all_lines = text.split("\n")
    at = [k for k, x in enumerate(all_lines) if x.strip()]
    if not at:
        return []
    own = scores if scores is not None else line_scores(model, [all_lines[k] for k in at])
    path = best_path(own)
    out = []
    begin = 0
    for i in range(1, len(path) + 1):
        if i == len(path) or path[i] != path[begin]:
            z = own[begin:i].sum(axis=0)
            z = z - z.max()
            confidence = float(1 / np.exp(z - z[path[begin]]).sum()) if z[path[begin]] > -700 else 0.0
            out.append((len(out), model.languages[path[begin]], confidence, at[begin], at[i - 1]))
            begin = i
    return out


def identify(df: DataFrame, id_cols: list[str], text_col: str, model: Model | None) -> DataFrame:
    """``id_cols, seg_no, lang, confidence, first_line, last_line``: every segment of every text (one, if it is in one language).

    Null texts and texts without any letter give no row, nor does any text without a model. Confidence is the probability
    of the segment's language.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in df.schema.fields if f.name in id_cols]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", seg_no int, lang string, confidence double, first_line int, last_line int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            for start in range(0, len(pdf) if m else 0, 64):
                part = pdf.iloc[start : start + 64]
                lines, owner = [], []
                for k, t in enumerate(part["__text"]):
                    own = [x for x in (t or "").split("\n") if x.strip()]
                    lines += own
                    owner += [k] * len(own)
                scores = line_scores(m, lines)
                ends = np.searchsorted(np.array(owner, dtype=np.int64), np.arange(len(part) + 1))
                rows = []
                for k, t in enumerate(part["__text"]):
                    s = scores[ends[k] : ends[k + 1]]
                    if len(s) and s.any():
                        rows += [(k, *x) for x in segments(m, t, s)]
                out = part[[f.name for f in kept]].iloc[[r[0] for r in rows]].reset_index(drop=True)
                for c, name in enumerate(("seg_no", "lang", "confidence", "first_line", "last_line"), 1):
                    out[name] = pd.Series([r[c] for r in rows], dtype="object")
                yield out.astype({"seg_no": "int32", "confidence": "float64", "first_line": "int32", "last_line": "int32"})

    return df.select(*[f.name for f in kept], F.col(text_col).alias("__text")).mapInPandas(run, schema)
