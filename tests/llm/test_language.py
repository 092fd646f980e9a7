import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork.llm import language as G

VOCABULARY = {
    "aa": "the quick river runs under every bridge while people watch boats from their windows".split(),
    "bb": "der schnelle fluss läuft unter jeder brücke während leute boote von ihren fenstern sehen".split(),
    "cc": "быстрая река бежит под каждым мостом пока люди смотрят лодки из своих окон".split(),
}


def sentence(rng, code, n=30):
    return " ".join(rng.choice(VOCABULARY[code]) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(0)
    texts, labels = [], []
    for _ in range(150):
        code = rng.choice(list(VOCABULARY))
        texts.append(sentence(rng, code, 60))
        labels.append(code if rng.random() > 0.1 else rng.choice(list(VOCABULARY)))  # a tenth is labelled by chance
    return G.train(texts, labels, sorted(VOCABULARY))


def test_held_out_accuracy(model):
    rng = random.Random(9)
    cases = [(c, sentence(rng, c, 12)) for c in VOCABULARY for _ in range(60)]
    scores = G.line_scores(model, [t for _, t in cases])
    right = sum(model.languages[k] == c for (c, _), k in zip(cases, scores.argmax(axis=1)))
    assert right >= 0.98 * len(cases)


def test_segments(model):
    rng = random.Random(3)
    text = "\n".join([sentence(rng, "aa"), "", sentence(rng, "aa"), "42", sentence(rng, "cc"), sentence(rng, "bb"), "  "])
    got = [(n, c, a, b) for n, c, _, a, b in G.segments(model, text)]
    assert [g[:2] for g in got] == [(0, "aa"), (1, "cc"), (2, "bb")] and got[-1][2:] == (5, 5)
    assert all(0.5 < x[2] <= 1 for x in G.segments(model, text))
    assert G.segments(model, "\n \n") == []


def test_encoded_data_changes_no_language(model):
    rng = random.Random(4)
    text = "\n".join([sentence(rng, "bb"), "Eynt7hnAsa9zpmpvvHvpkq61kD3sCgsv4hzvie3yp/9fE+uHgvGe8bcctH/6f8D19e879m4ftnC8A226", sentence(rng, "bb")])
    assert [s[1] for s in G.segments(model, text)] == ["bb"]


def test_windows():
    w, owner = G.windows_of(["", "12 34", "a" * 200, "é"])
    assert w.shape == (4, G.WINDOW) or w.shape[1] == G.WINDOW
    assert set(owner.tolist()) <= {2, 3} and G.windows_of([])[0].shape == (0, G.WINDOW)


def test_path_cost():
    s = np.array([[0.0, -1.0], [-1.0, 0.0], [0.0, -1.0]])
    assert G.best_path(s, 10).tolist() == [0, 0, 0] and G.best_path(s, 0.1).tolist() == [0, 1, 0]
    assert G.best_path(np.zeros((0, 2))).tolist() == []


def test_identify(spark, model):
    rng = random.Random(5)
    rows = [(1, "x", sentence(rng, "aa")), (2, None, None), (3, "x", ""), (4, "x", "12 !"), (5, "x", sentence(rng, "aa") + "\n" + sentence(rng, "cc"))]
    df = spark.createDataFrame(rows, "id long, lang string, body string").drop("lang")
    got = {(r.id, r.seg_no): r.lang for r in G.identify(df, ["id"], "body", model).collect()}
    assert got == {(1, 0): "aa", (5, 0): "aa", (5, 1): "cc"}
    assert G.identify(df, ["id"], "body", None).collect() == []


def test_train_on(spark):
    rng = random.Random(6)
    rows = [(sentence(rng, c, 60), lab) for c, lab in [("aa", "aa"), ("aa", "AA-us"), ("bb", "bb_DE"), ("bb", "bb")] * 12] + [(None, "aa"), ("short", "aa"), (sentence(rng, "aa", 60), "zz"), (sentence(rng, "aa", 60), None)]
    m = G.train_on(spark.createDataFrame(rows, "t string, l string"), "t", "l", ["aa", "bb", "cc"])
    assert m.languages == ["aa", "bb"]
    assert G.train_on(spark.createDataFrame([], "t string, l string"), "t", "l", ["aa"]) is None


def test_labels(spark):
    labels = ["EN", "de-DE", "en_GB", "x1", "", None, " en ", "deu-Latn"]
    got = [r.c for r in spark.createDataFrame([(x,) for x in labels], "l string").select(G.label_code(F.col("l")).alias("c")).collect()]
    assert got == ["en", "de", "en", "", "", None, "en", "deu"]


def test_training_rows(spark, monkeypatch):
    """Three-letter codes, languages with short texts only, copies of one text, text from all over a row, and the bound in all."""
    rng = random.Random(7)
    long_text = "\n".join(f"{k} {sentence(rng, 'bb', 40)}" for k in range(60))
    rows = [(sentence(rng, "aa", 60), "AAA") for _ in range(30)] + [(sentence(rng, "bb", 60), "bb")] * 5000 + [(long_text, "bb")] + [(sentence(rng, "cc", 6), "cc-X") for _ in range(30)]
    df = spark.createDataFrame(rows, "t string, l string").repartition(4)
    monkeypatch.setattr(G, "TRAIN_TOTAL", 60)
    got = [(r.code, r.text) for r in G.training_rows(df, "t", "l", ["aaa", "bb", "cc", "dd"])]
    counts = {c: sum(x == c for x, _ in got) for c in ("aaa", "bb", "cc")}
    assert counts == {"aaa": 15, "bb": 2, "cc": 15} and len(set(got)) == len(got)
    (spread,) = [t for c, t in got if c == "bb" and t.startswith("0 ")]
    assert len(spread) <= G.TRAIN_CHARS + G.TRAIN_PARTS and long_text[-50:] in spread
    monkeypatch.setattr(G, "TRAIN_TOTAL", 8000)
    m = G.train_on(df, "t", "l", ["aaa", "bb", "cc", "dd"])
    assert m.languages == ["aaa", "bb", "cc"]
    scores = G.line_scores(m, [sentence(rng, "cc", 12), sentence(rng, "aa", 12)])
    assert [m.languages[k] for k in scores.argmax(axis=1)] == ["cc", "aaa"]
