"""Near-duplicate filters and clusters over SimHash and MinHash sketches.

Pairs within a Hamming distance t are found exactly by blocks: of m > t blocks of bits, two hashes at most t apart
agree in some m - t, so they meet under one of the keys made of m - t blocks. Equal sketches are one class before
any pair is made, so copies cost nothing; a hot key is split by Spark's adaptive skew join.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.sketches import band_hashes, estimated_jaccard, hamming
from skeinwork.operators.graph import connected_components
from skeinwork.session import cut_lineage


def _block_keys(h: Column, t: int, blocks: int) -> Column:
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [F.shiftrightunsigned(F.shiftleft(h, 64 - edges[k + 1]), 64 - edges[k + 1] + edges[k]) for k in range(blocks)]
    return F.array(*[F.xxhash64(F.lit(n), *[parts[k] for k in own]) for n, own in enumerate(combinations(range(blocks), blocks - t))])


def hamming_pairs(hashes: DataFrame, hash_col: str, t: int, blocks: int | None = None) -> DataFrame:
    """Pairs ``a < b`` of distinct hashes at most t bits apart, with ``distance``. Null hashes have no partners."""
    m = blocks or t + 2
    own = hashes.select(F.col(hash_col).alias("h")).filter("h IS NOT NULL").distinct()
    keyed = own.select("h", F.explode(_block_keys(F.col("h"), t, m)).alias("key"))
    a, b = keyed.select("key", F.col("h").alias("a")), keyed.select("key", F.col("h").alias("b"))
    near = a.join(b, "key").filter((F.col("a") < F.col("b")) & (hamming("a", "b") <= t))
    return near.select("a", "b", hamming("a", "b").alias("distance")).distinct()


def minhash_pairs(signatures: DataFrame, id_col: str, sig_col: str, threshold: float = 0.85, bands: int = 16, n: int = 128) -> DataFrame:
    """Pairs ``a < b`` of ids that share a band and agree in at least ``threshold`` of their positions.

    Equal signatures are one class, represented by its least id; ids must be unique.
    """
    classes = signatures.filter(F.col(sig_col).isNotNull()).groupBy(F.xxhash64(sig_col).alias("__class")).agg(F.min_by(F.struct(F.col(id_col).alias("id"), F.col(sig_col).alias("sig")), id_col).alias("r"))
    own = classes.select("r.id", "r.sig")
    keyed = own.select("id", F.explode(band_hashes("sig", bands, n)).alias("k")).select("id", F.xxhash64("k.band", "k.hash").alias("key"))
    a, b = keyed.select("key", F.col("id").alias("a")), keyed.select("key", F.col("id").alias("b"))
    met = a.join(b, "key").filter("a < b").select("a", "b").distinct()
    sa, sb = own.select(F.col("id").alias("a"), F.col("sig").alias("sa")), own.select(F.col("id").alias("b"), F.col("sig").alias("sb"))
    scored = met.join(sa, "a").join(sb, "b").select("a", "b", estimated_jaccard("sa", "sb").alias("similarity"))
    return scored.filter(F.col("similarity") >= threshold)


def minhash_classes(signatures: DataFrame, id_col: str, sig_col: str, threshold: float = 0.85, bands: int = 16, n: int = 128) -> DataFrame:
    """``id, class, links`` of every row: the least id of its signature, and how many other rows it is linked to.

    Linked are the rows of its own class and those of the classes paired with it by minhash_pairs. Null signatures have no class
    and no links.
    """
    own = signatures.select(F.col(id_col).alias("id"), F.col(sig_col).alias("sig"))
    members, firsts = _members(own)
    pairs = minhash_pairs(own, "id", "sig", threshold, bands, n).select("a", "b")
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = ends.join(firsts.select(F.col("rep").alias("b"), "size"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("size").alias("near"))
    counted = firsts.join(near, "rep", "left").select("key", "rep", (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    judged = members.join(counted, "key").select("id", F.col("rep").alias("class"), "links")
    return judged.unionByName(own.filter("sig IS NULL").select("id", F.lit(None).cast(own.schema["id"].dataType).alias("class"), F.lit(0).cast("long").alias("links")))


def minhash_links(signatures: DataFrame, id_col: str, sig_col: str, threshold: float = 0.85, bands: int = 16, n: int = 128) -> DataFrame:
    """``a, b, similarity``: minhash_pairs of the classes' least ids, and each other row of a class linked to its least id (1.0).

    So every row that has a partner stands in a link, in as many rows as there are copies; ids of one class, and of two paired
    classes, are all partners of each other.
    """
    own = signatures.select(F.col(id_col).alias("id"), F.col(sig_col).alias("sig"))
    members, firsts = _members(own)
    same = members.join(firsts, "key").filter(F.col("id") != F.col("rep")).select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    return minhash_pairs(own, "id", "sig", threshold, bands, n).unionByName(same)


def _members(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, key`` of the rows of ``id, sig`` with a signature, and ``key, rep, size`` of their classes."""
    members = own.filter("sig IS NOT NULL").select("id", F.xxhash64("sig").alias("key"))
    return members, members.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("size"))


#: The filter's rounds end in one task once so few links are undecided (counted in every round).
REST_LINKS = 100_000


def first_kept(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """The sequential filter over items in ascending order of their id: an item is dropped if an earlier kept item is its partner.

    ``id, duplicate_of`` (null for kept items, else the earliest kept partner). pairs: ``a, b`` with a before b; items: ``id``. Rounds:
    an undecided item without undecided or kept earlier partners is kept, one with a kept earlier partner is dropped. Each round is
    written to the shared folder while the query is built; when at most REST_LINKS links are left, one task settles them in order.
    """
    later = cut_lineage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    involved = later.select(F.col("b").alias("id")).distinct()
    state = cut_lineage(items.select("id").join(involved, "id", "left_anti").select("id", F.lit(True).alias("kept")))
    open_ = cut_lineage(involved)
    while open_.limit(1).count():
        known = cut_lineage(later.join(open_, later["b"] == open_["id"], "left_semi").join(state.select(F.col("id").alias("a"), "kept"), "a", "left"))
        if known.count() <= REST_LINKS:
            state = cut_lineage(state.unionByName(_settled(known, items.schema["id"].dataType.simpleString())))
            break
        verdict = known.groupBy("b").agg(F.max(F.coalesce("kept", F.lit(False))).alias("hit"), F.max(F.col("kept").isNull()).alias("waits"))
        settled = verdict.filter(F.col("hit") | ~F.col("waits")).select(F.col("b").alias("id"), (~F.col("hit")).alias("kept"))
        state = cut_lineage(state.unionByName(settled))
        open_ = cut_lineage(open_.join(state, "id", "left_anti"))
    kept = state.filter("kept").select(F.col("id").alias("a"))
    first = later.join(kept, "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("earliest"))
    return state.join(first, "id", "left").select("id", F.when(~F.col("kept"), F.col("earliest")).alias("duplicate_of"))


def _settled(known: DataFrame, kind: str) -> DataFrame:
    """``id, kept`` of the undecided items b among ``a, b, kept`` (of a; null while undecided), one after the other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        links = pd.concat(list(batches) or [pd.DataFrame({"a": [], "b": [], "kept": []})])
        decided = {a: bool(k) for a, k in zip(links["a"], links["kept"]) if k is not None and k == k}
        hit: dict = {}
        for b, a in sorted(zip(links["b"], links["a"])):
            hit[b] = hit.get(b, False) or decided.get(a, not hit.get(a, False))
        yield pd.DataFrame({"id": list(hit), "kept": [not h for h in hit.values()]})

    return known.select("a", "b", "kept").coalesce(1).mapInPandas(run, f"id {kind}, kept boolean")


def simhash_filter(rows: DataFrame, id_col: str, hash_col: str, t: int = 3) -> DataFrame:
    """``id, duplicate_of, similarity`` of the sequential SimHash filter in order of id: the earliest kept row at most t bits away.

    The hash 0 (no words) and null hashes never match. Rows of equal hashes are one item, that of their least id; the others
    are its duplicates if it is kept, else of the row it duplicates.
    """
    own = rows.select(F.col(id_col).alias("id"), F.col(hash_col).alias("h"))
    real = own.filter(F.coalesce(F.col("h"), F.lit(0)) != 0)
    firsts = real.groupBy("h").agg(F.min("id").alias("rep"))
    pairs = hamming_pairs(firsts, "h", t)
    ids = pairs.join(firsts.select(F.col("h").alias("a"), F.col("rep").alias("ra")), "a").join(firsts.select(F.col("h").alias("b"), F.col("rep").alias("rb")), "b")
    near = cut_lineage(ids.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), (1 - F.col("distance") / 64).alias("similarity")))
    judged = _judged(real.select("id", F.col("h").alias("key")), firsts.select(F.col("h").alias("key"), "rep"), near)
    return judged.unionByName(_unmatched(own.filter(F.coalesce(F.col("h"), F.lit(0)) == 0), judged))


def minhash_filter(signatures: DataFrame, id_col: str, sig_col: str, threshold: float = 0.85, bands: int = 16, n: int = 128) -> DataFrame:
    """``id, duplicate_of, similarity`` of the sequential MinHash filter in order of id.

    duplicate_of is the earliest kept row that shares a band and agrees in at least ``threshold`` of the positions. Signatures of texts
    without words match each other; null signatures never match.
    """
    own = signatures.select(F.col(id_col).alias("id"), F.col(sig_col).alias("sig"))
    members, firsts = _members(own)
    judged = _judged(members, firsts.select("key", "rep"), cut_lineage(minhash_pairs(own, "id", "sig", threshold, bands, n)))
    return judged.unionByName(_unmatched(own.filter("sig IS NULL"), judged))


def _judged(members: DataFrame, firsts: DataFrame, near: DataFrame) -> DataFrame:
    """Verdicts of ``id, key`` by those of the first of their class (``key, rep``); near: ``a, b, similarity`` of firsts, a before b."""
    verdict = first_kept(near.select("a", "b"), firsts.select(F.col("rep").alias("id")))
    scored = verdict.join(near.select(F.col("a").alias("duplicate_of"), F.col("b").alias("id"), "similarity"), ["duplicate_of", "id"], "left").select(F.col("id").alias("rep"), "duplicate_of", "similarity")
    copy = F.col("id") != F.col("rep")
    of, like = F.coalesce("duplicate_of", F.when(copy, F.col("rep"))), F.when(F.col("duplicate_of").isNull() & copy, F.lit(1.0)).otherwise(F.col("similarity"))
    return members.join(firsts, "key").join(scored, "rep").select("id", of.alias("duplicate_of"), like.alias("similarity"))


def _unmatched(rows: DataFrame, judged: DataFrame) -> DataFrame:
    return rows.select("id", *[F.lit(None).cast(judged.schema[c].dataType).alias(c) for c in ("duplicate_of", "similarity")])


def simhash_clusters(rows: DataFrame, id_col: str, hash_col: str, t: int = 3) -> DataFrame:
    """``id, cluster`` (the least id) and ``avg_similarity``: transitive closure of distances up to t; the hash 0 clusters like any other.

    avg_similarity is the mean of 1 - distance / 64 over all pairs of the cluster's rows, 1.0 for a single row; the distances
    are summed bit by bit from the rows that have it set, so no pair is made.
    """
    own = rows.select(F.col(id_col).alias("id"), F.col(hash_col).alias("h")).filter("h IS NOT NULL")
    firsts = own.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("size"))
    pairs = hamming_pairs(firsts, "h", t)
    ids = pairs.join(firsts.select(F.col("h").alias("a"), F.col("rep").alias("ra")), "a").join(firsts.select(F.col("h").alias("b"), F.col("rep").alias("rb")), "b")
    parts = connected_components(ids, "ra", "rb").select(F.col("node").alias("rep"), "component")
    named = cut_lineage(firsts.join(parts, "rep", "left").select("h", "size", F.coalesce("component", "rep").alias("cluster")))
    ones = [F.sum(F.col("size") * F.shiftrightunsigned("h", k).bitwiseAND(F.lit(1))).cast("double").alias(f"b{k}") for k in range(64)]
    sums = named.groupBy("cluster").agg(F.sum("size").cast("double").alias("n"), F.array(*ones).alias("ones"))
    apart = F.aggregate("ones", F.lit(0.0), lambda s, x: s + x * (F.col("n") - x))
    means = sums.select("cluster", F.when(F.col("n") > 1, 1 - apart / (32 * F.col("n") * (F.col("n") - 1))).otherwise(F.lit(1.0)).alias("avg_similarity"))
    return own.join(named.join(means, "cluster"), "h").select("id", "cluster", "avg_similarity")


def filter_stats(verdicts: DataFrame) -> DataFrame:
    """Rows checked, duplicates, unique rows, and the mean similarity of the duplicates to the row they repeat (0.0 without any)."""
    mean = F.coalesce(F.avg(F.when(F.col("duplicate_of").isNotNull(), F.col("similarity"))), F.lit(0.0))
    return verdicts.agg(F.count("*").alias("checked"), F.count("duplicate_of").alias("duplicates"), F.count_if(F.col("duplicate_of").isNull()).alias("unique_rows"), mean.alias("mean_similarity"))
