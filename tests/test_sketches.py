import os
import random
import subprocess
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skeinwork.functions import sketches as K
from skeinwork.operators import similarity as S


def test_sip13_is_the_interpreter_s_hash():
    assert sys.hash_info.algorithm == "siphash13"
    words = ["a", "abcdefgh", "x" * 31, "longer than one block of bytes", "ab" * 9]
    code = f"print(*[hash(w.encode()) for w in {words!r}])"
    out = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONHASHSEED": "0"}, capture_output=True, text=True, check=True)
    assert K.sip13([w.encode() for w in words]).view(np.int64).tolist() == [int(x) for x in out.stdout.split()]


def test_keys_per_column():
    k = np.array([1, 2, 3], dtype=np.uint64)
    both = K.sip13([b"abc", b"a longer message"], k, k + np.uint64(7))
    for j in range(3):
        assert both[:, j].tolist() == K.sip13([b"abc", b"a longer message"], int(k[j]), int(k[j]) + 7).tolist()


def test_normal_words():
    assert K.normal_words("Don't  stop-now,\tÉté 2024!") == ["dont", "stopnow", "été", "2024"]
    assert K.shingles("a b") == ["a", "b"] and K.shingles("a b c d") == ["a b c", "b c d"] and K.shingles("...") == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["aa", "bb", "cc", "dd"]), max_size=12))
def test_simhash_majority(words):
    tokens = K.shingles(" ".join(words))
    want = 0
    for bit in range(64):
        ones = sum((int(h) >> bit) & 1 for h in K.token_hashes(tokens, "xxhash64")) if tokens else 0
        want |= int(2 * ones > len(tokens)) << bit
    assert K.simhash_tokens(tokens, "xxhash64") & ((1 << 64) - 1) == want


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four")], "id long, t string")
    rows = {r.id: r for r in df.select("id", K.simhash("t").alias("h"), K.minhash("t", 8).alias("m")).collect()}
    assert rows[1].h is None and rows[1].m is None
    assert rows[2].h == 0 and rows[2].m == [-1] * 8
    assert len(rows[3].m) == 8


def test_hamming_pairs_exact(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    hs = base + [h ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for h in base] + [base[0]] * 5
    signed = [h - (1 << 64) if h >> 63 else h for h in hs] + [None]
    df = spark.createDataFrame([(h,) for h in signed], "h long")
    got = {(r.a, r.b, r.distance) for r in S.hamming_pairs(df, "h", 3).collect()}
    own = sorted({h for h in signed if h is not None})
    dist = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    assert got == {(a, b, dist(a, b)) for i, a in enumerate(own) for b in own[i + 1 :] if dist(a, b) <= 3}


def greedy(rows, t):
    kept, out = [], {}
    for i, h in sorted(rows):
        hit = next((j for j, g in kept if h and g and bin((h ^ g) & ((1 << 64) - 1)).count("1") <= t), None) if h else None
        out[i] = hit
        if hit is None:
            kept.append((i, h))
    return out


def test_sequential_filter(spark):
    rng = random.Random(5)
    rows, h = [], rng.getrandbits(62)
    for i in range(120):  # a walk, so that duplicates of duplicates occur
        h = h ^ (1 << rng.randrange(62)) if i % 7 else rng.getrandbits(62)
        rows.append((i, h))
    rows += [(200, 0), (201, 0), (202, rows[3][1]), (203, rows[10][1])]
    df = spark.createDataFrame(rows, "id long, h long")
    got = {r.id: r.duplicate_of for r in S.simhash_filter(df, "id", "h", 3).collect()}
    assert got == greedy(rows, 3)


def test_clusters_and_empty(spark):
    df = spark.createDataFrame([(1, 0b1), (2, 0b11), (3, 0b111), (9, 1 << 60), (5, None)], "id long, h long")
    assert {r.id: r.cluster for r in S.simhash_clusters(df, "id", "h", 1).collect()} == {1: 1, 2: 1, 3: 1, 9: 9}
    none = spark.createDataFrame([], "id long, h long")
    assert S.simhash_filter(none, "id", "h").collect() == [] and S.simhash_clusters(none, "id", "h").collect() == []


def test_minhash_pairs(spark):
    texts = [(1, "the quick brown fox jumps over the lazy dog again and again today"), (2, "The quick brown fox jumps over the lazy dog again and again today!"), (3, "nothing in common with the others at all here")]
    df = spark.createDataFrame(texts, "id long, t string").select("id", K.minhash("t", 32).alias("m"))
    assert S.minhash_pairs(df, "id", "m", 0.8, 8, 32).collect() == []  # equal signatures are one class
    j = df.alias("a").join(df.alias("b"), F.expr("a.id < b.id")).select(K.estimated_jaccard("a.m", "b.m").alias("j")).collect()
    assert sorted(r.j for r in j)[-1] == 1.0


def test_minhash_links_and_classes(spark):
    near = "the quick brown fox jumps over the lazy dog again and again until the end of the day comes and it sleeps"
    texts = [(1, near), (2, near.upper() + "!"), (3, "nothing in common with the others at all here"), (4, near), (5, None), (6, f"{near} well"), (7, f"{near} well"), (8, ""), (9, "")]
    df = spark.createDataFrame(texts, "id long, t string").select("id", K.minhash("t", 32).alias("m"))
    sig = {r.id: r.m for r in df.collect()}
    like = lambda a, b: sum(x == y for x, y in zip(sig[a], sig[b])) / 32
    assert 0.6 <= like(1, 6) < 1
    got = {(r.a, r.b): r.similarity for r in S.minhash_links(df, "id", "m", 0.6, 16, 32).collect()}
    assert got == {(1, 2): 1.0, (1, 4): 1.0, (1, 6): like(1, 6), (6, 7): 1.0, (8, 9): 1.0}
    rows = {r.id: (r["class"], r.links) for r in S.minhash_classes(df, "id", "m", 0.6, 16, 32).collect()}
    assert rows == {1: (1, 4), 2: (1, 4), 4: (1, 4), 6: (6, 4), 7: (6, 4), 3: (3, 0), 5: (None, 0), 8: (8, 1), 9: (8, 1)}
    assert S.minhash_links(df.limit(0), "id", "m").collect() == [] and S.minhash_classes(df.limit(0), "id", "m").collect() == []


def test_minhash_queries_cover_every_document(spark):
    from skeinwork.plans.similarity_queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = QUERIES["minhash_classes"](spark, sf).collect()
    assert sorted(r.id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    linked = {r.id for r in rows if r.links}
    assert linked == {x for r in QUERIES["minhash_near_duplicates"](spark, sf).collect() for x in (r.a, r.b)}


def test_minhash_filter_and_stats(spark):
    rng, rows, sig = random.Random(7), [], [0] * 32
    for i in range(80):  # a walk, so that duplicates of duplicates occur
        sig = [rng.randrange(1 << 40) for _ in sig] if i % 8 == 0 else [rng.randrange(1 << 40) if rng.random() < 0.06 else x for x in sig]
        rows.append((i, sig))
    rows += [(100, rows[0][1]), (101, rows[3][1]), (102, [-1] * 32), (103, [-1] * 32), (104, None)]
    like = lambda a, b: sum(x == y for x, y in zip(a, b)) / 32
    met = lambda a, b: any(a[k : k + 4] == b[k : k + 4] for k in range(0, 32, 4))
    kept, want = [], {}
    for i, s in rows:
        hit = next(((j, like(s, g)) for j, g in kept if met(s, g) and like(s, g) >= 0.85), None) if s else None
        want[i] = hit or (None, None)
        if s and not hit:
            kept.append((i, s))
    verdicts = S.minhash_filter(spark.createDataFrame(rows, "id long, m array<long>"), "id", "m", 0.85, 8, 32)
    assert {r.id: (r.duplicate_of, r.similarity) for r in verdicts.collect()} == want
    found = [x for _, x in want.values() if x]
    (stats,) = S.filter_stats(verdicts).collect()
    assert (stats.checked, stats.duplicates, stats.unique_rows) == (85, len(found), 85 - len(found)) and abs(stats.mean_similarity - sum(found) / len(found)) < 1e-9


def test_similarities_of_simhash(spark):
    rows = [(1, 0b1), (2, 0b11), (3, 0b111), (4, 0b1), (9, 1 << 60), (10, -1), (11, -2), (12, -1)]
    df = spark.createDataFrame(rows, "id long, h long")
    dist = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    got = S.simhash_clusters(df, "id", "h", 1).collect()
    for cluster, ids in ((1, (1, 2, 3, 4)), (9, (9,)), (10, (10, 11, 12))):
        hs = [h for i, h in rows if i in ids]
        each = [1 - dist(a, b) / 64 for k, a in enumerate(hs) for b in hs[k + 1 :]] or [1.0]
        assert all(abs(r.avg_similarity - sum(each) / len(each)) < 1e-12 for r in got if r.cluster == cluster) and {r.id for r in got if r.cluster == cluster} == set(ids)
    filtered = {r.id: (r.duplicate_of, r.similarity) for r in S.simhash_filter(df, "id", "h", 1).collect()}
    assert filtered == {1: (None, None), 2: (1, 63 / 64), 3: (None, None), 4: (1, 1.0), 9: (None, None), 10: (None, None), 11: (10, 63 / 64), 12: (10, 1.0)}


@pytest.mark.parametrize("rest", [0, 100_000])
def test_chain_beyond_any_number_of_rounds(spark, monkeypatch, rest):
    """Every item is the partner of the one before: every second is kept, in rounds as in one task."""
    monkeypatch.setattr(S, "REST_LINKS", rest)
    n = 12 if rest == 0 else 1000
    pairs = spark.createDataFrame([(k, k + 1) for k in range(n)], "a long, b long")
    got = {r.id: r.duplicate_of for r in S.first_kept(pairs, spark.range(n + 1)).collect()}
    assert got == {k: None if k % 2 == 0 else k - 1 for k in range(n + 1)}


def test_recall_of_the_bands(spark):
    """Against brute force over all signatures of a table: the bands bring nearly all pairs over the threshold together."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) > 200").select("doc_id", K.minhash("text").alias("sig"))
    rows = docs.dropDuplicates(["sig"]).collect()
    ids, sigs = [r.doc_id for r in rows], np.array([r.sig for r in rows])
    want = set()
    for k in range(len(ids)):
        for j in np.flatnonzero((sigs[k + 1 :] == sigs[k]).mean(axis=1) >= 0.7) + k + 1:
            want.add((min(ids[k], ids[j]), max(ids[k], ids[j])))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, sigs)], "id long, m array<long>")
    got = {(r.a, r.b) for r in S.minhash_pairs(df, "id", "m", 0.7).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 5
