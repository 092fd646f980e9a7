import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skeinwork.llm import near_dup as N

WORDS = [f"w{i}" for i in range(4000)]


def brute(rows, width, least):
    reps = {}
    for i, t in sorted(rows):
        if t is not None:
            reps.setdefault(t, i)
    sets = {i: set(zip(*(N.words_of(t)[k:] for k in range(width)))) for t, i in reps.items()}
    out = {}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b]:
                s = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                if s >= least:
                    out[a, b] = s
    return out


def variants(rng, n, size, edits):
    base = [rng.choice(WORDS) for _ in range(size)]
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(len(own))] = rng.choice(WORDS)
        yield " ".join(own)


def test_against_brute_force(spark):
    rng = random.Random(4)
    texts = [t for _ in range(25) for t in variants(rng, 4, rng.randrange(60, 300), 9)]
    texts += [" ".join(rng.choice(WORDS) for _ in range(100)) for _ in range(60)]
    texts += [texts[0]] * 50 + [None, "", "  ", "a b", "a b c", "A b-c", "x y z x y z", texts[5].upper() + " !!!"]
    furniture = "All rights reserved by the owner of this site and nobody else in the world at all, as ever.\n"
    texts = [furniture + t if i % 3 and t else t for i, t in enumerate(texts)]
    rows = list(enumerate(texts, 1))
    df = spark.createDataFrame([(i, t, "clash", t) for i, t in rows], "rec long, body string, anchor string, text string").repartition(4)
    for width, least in ((3, 0.6), (5, 0.8)):
        got = {(r.rep_a, r.rep_b): r.similarity for r in N.near_duplicate_pairs(df, "rec", "body", width, least).collect()}
        want = brute(rows, width, least)
        assert got.keys() <= want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
        # hashing may miss a link at the very threshold (about one in a thousand); from a little above, none is missed
        assert len(want) > 15 and len(got) >= 0.99 * len(want) and {k for k, v in want.items() if v >= least + 0.05} <= got.keys()


def test_classes_and_empty(spark):
    df = spark.createDataFrame([(5, "a"), (3, "a"), (4, None), (1, "")], "id long, t string")
    assert {(r.id, r.rep) for r in N.text_classes(df, "id", "t").collect()} == {(5, 3), (3, 3), (1, 1)}
    none = spark.createDataFrame([], "id long, t string")
    assert N.near_duplicate_pairs(none, "id", "t").collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, N.PRIME - 1), min_size=N.LENGTH, max_size=N.LENGTH), st.lists(st.integers(0, N.PRIME - 1), min_size=N.LENGTH, max_size=N.LENGTH), st.sets(st.integers(0, N.LENGTH - 1), min_size=2))
def test_two_equal_symbols_share_an_anchor(x, y, same):
    y = [x[k] if k in same else y[k] for k in range(N.LENGTH)]
    a, b = N.anchors(np.array([x, y], dtype=np.int64)).tolist()
    assert set(a) & set(b)


def test_anchor_is_a_codeword_through_two_symbols():
    s = N.shingle_hashes(N.words_of(" ".join(WORDS[:50])), 5)
    x = [int((N._mix(s ^ k) >> np.uint64(33)).min()) % N.PRIME for k in N._SYMBOL_SEEDS]
    none = [np.empty(0, dtype=np.int64)] * N.LENGTH
    assert N.words_at(N.least_symbols(s)[None], none).tolist() == [x]
    for key in N.anchors(np.array([x], dtype=np.int64))[0].tolist():
        slope, start = key >> 31, key & ((1 << 31) - 1)
        assert sum((start + slope * i) % N.PRIME == v for i, v in enumerate(x)) >= 2


def test_sketch_ranges():
    s = N.shingle_hashes(WORDS[:300], 3)
    assert N.sketch(s) == N.sketch(s) and N.sketch(s) != N.sketch(N.shingle_hashes(WORDS[300:600], 3))
    assert N.sketch(np.array([5], dtype=np.uint64)) is not None


def test_usual_symbols_give_way_to_the_next():
    s = N.shingle_hashes(WORDS[:40], 3)
    low = N.least_symbols(s)
    assert low.shape == (N.LENGTH, N.RANKS) and (np.diff(low) >= 0).all()
    usual = [low[p, :1] if p < 6 else low[p] if p == 6 else np.empty(0, dtype=np.int64) for p in range(N.LENGTH)]
    (word,) = N.words_at(low[None], usual)
    assert word.tolist() == [*low[:6, 1], low[6, -1], *low[7:, 0]]
    few = N.least_symbols(N.shingle_hashes(["a", "b", "c", "d"], 3))
    assert few.shape == (N.LENGTH, N.RANKS) and (few[:, 1] == few[:, -1]).all()
    many = N.shingle_hashes([f"q{k}" for k in range(9000)], 3)  # beyond one stretch of hashes
    assert N.least_symbols(many)[0].tolist() == sorted(int(x) % N.PRIME for x in N._mix(many ^ N._SYMBOL_SEEDS[0]) >> np.uint64(33))[: N.RANKS]


def test_usual_phrases_and_much_furniture(spark):
    """Unlike texts full of the same phrases hardly meet; texts that are like by their furniture alone are found."""
    rng = random.Random(8)
    phrases = [" ".join(rng.choice(WORDS) for _ in range(6)) for _ in range(8)]
    texts = [" ".join(x for _ in range(8) for x in (rng.choice(phrases), *(rng.choice(WORDS) for _ in range(12)))) for _ in range(150)]
    legal = "\n".join(" ".join(f"legal{k} part{j}" for j in range(15)) for k in range(4))
    texts += [f"{legal}\n{' '.join(rng.choice(WORDS) for _ in range(rng.randrange(4, 14)))}" for _ in range(60)]
    rows = list(enumerate(texts, 1))
    df = spark.createDataFrame(rows, "id long, t string").repartition(4)
    got = {(r.rep_a, r.rep_b) for r in N.near_duplicate_pairs(df, "id", "t", 3, 0.6).collect()}
    want = brute(rows, 3, 0.6)
    assert got <= want.keys() and len(got) >= 0.99 * len(want) and len(want) > 1000


def test_low_thresholds_are_refused(spark):
    with pytest.raises(ValueError):
        N.near_duplicate_pairs(spark.createDataFrame([], "id long, t string"), "id", "t", 3, 0.4)
