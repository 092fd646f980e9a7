"""Filling containers of fixed capacity by Karmarkar-Karp multiway differencing.

Items are spread by a hash of their unique id over batches of about BATCH items, so no batch depends on how sizes or
ids are distributed. Within a batch of total size S the number of windows is k = ceil(S / capacity). Every item
begins as a partial partition (its size, and k - 1 zeros); the two partial partitions with the greatest spread are
merged largest against smallest until one is left. If windows exceed the capacity, single items are exchanged with
windows that have room; if some still do, k rises and the batch is partitioned again. An item over the capacity is cut into full windows and a rest; only the rest is
packed with others. At most one window's worth of room is lost in a batch when its windows come out level.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH, MOST_PARTITIONS = 4096, 20_000


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0..k-1) of each item, by multiway differencing into k windows of near-equal sums."""
    n = len(sizes)
    left, right = np.full(n * (k + 1), -1, dtype=np.int64), np.full(n * (k + 1), -1, dtype=np.int64)
    made = n  # nodes below n are items; above, pairs of nodes that share a window
    parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heap = []
    for i in range(n):
        parts[i] = (np.array([sizes[i]], dtype=np.int64), np.array([i], dtype=np.int64))  # sums above the least, greatest first; absent ones are 0
        heap.append((-int(sizes[i]), i))
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, p = heapq.heappop(heap)
        _, q = heapq.heappop(heap)
        (sa, na), (sb, nb) = parts.pop(p), parts.pop(q)
        a, b = len(sa), len(sb)
        over = max(0, a + b - k)  # so many windows of a meet one of b, a's least b's greatest
        sums, nodes = np.concatenate((sa, sb[over:])), np.concatenate((na, nb[over:]))
        if over:
            tail = np.arange(a - over, a)
            sums[tail] += sb[:over][::-1]
            fresh = np.arange(made, made + over)
            if made + over > len(left):
                left, right = np.append(left, np.full(len(left), -1)), np.append(right, np.full(len(right), -1))
            left[fresh], right[fresh] = na[tail], nb[:over][::-1]
            nodes[tail] = fresh
            made += over
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        if len(sums) == k:
            sums = sums - sums[-1]
        parts[tick] = (sums, nodes)
        heapq.heappush(heap, (-int(sums[0]), tick))
        tick += 1
    window = np.empty(n, dtype=np.int64)
    if n:
        for w, root in enumerate(next(iter(parts.values()))[1].tolist()):
            stack = [root]
            while stack:
                x = stack.pop()
                if x < n:
                    window[x] = w
                else:
                    stack += (left[x], right[x])
    return window


def _exchange(sizes: np.ndarray, window: np.ndarray, k: int, capacity: int) -> bool:
    """Swap single items between over-full windows and those with room, in place; whether every window fits then."""
    sums = np.bincount(window, weights=sizes, minlength=k).astype(np.int64)
    for w in sorted(np.flatnonzero(sums > capacity).tolist(), key=lambda x: -sums[x]):
        room = np.argsort(sums, kind="stable")[:64]
        for v in room.tolist():
            if sums[w] <= capacity or sums[v] >= capacity:
                break
            over, free = sums[w] - capacity, capacity - sums[v]
            if free < over:  # so much does not go in here: take what does
                over = max(1, free // 2)
            mine = np.flatnonzero(window == w)
            theirs = np.append(np.flatnonzero(window == v), -1)  # or nothing in return
            back = np.append(sizes[theirs[:-1]], 0)
            order = np.argsort(back, kind="stable")
            wanted = sizes[mine] - over  # the greatest item in return that still moves enough
            at = np.searchsorted(back[order], wanted, side="right") - 1
            ok = (at >= 0) & (sizes[mine] - back[order][np.maximum(at, 0)] <= free)
            if not ok.any():
                continue
            moved = np.where(ok, sizes[mine] - back[order][np.maximum(at, 0)], np.iinfo(np.int64).max)
            i = int(moved.argmin())
            j = theirs[order[at[i]]]
            window[mine[i]] = v
            if j >= 0:
                window[j] = w
            sums[w] -= moved[i]
            sums[v] += moved[i]
    return bool((sums <= capacity).all())


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item (0 < size <= capacity), none over the capacity."""
    sizes = np.asarray(sizes, dtype=np.int64)
    if not len(sizes):
        return np.empty(0, dtype=np.int64)
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differencing(sizes, k)
        if np.bincount(window, weights=sizes).max() <= capacity or _exchange(sizes, window, k, capacity):
            return window
        k += max(1, k // 256)


def pack_items(items: DataFrame, id_col: str, size_col: str, capacity: int, n_items: int | None = None, batch: int = BATCH) -> DataFrame:
    """Containers of items: ``container_id, <id_col>, piece_no, start, size``; every unit of every item exactly once.

    ids must be unique bigints. Items of null, zero or negative size take no room: one row with a null container_id and
    size 0. Repeated sizes are told apart by id, so the result is the same on every run. n_items (a cheap upper
    bound on the rows, counted if not given) sets the number of batches.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    n = n_items if n_items is not None else items.count()
    batches = max(1, -(-n // batch))
    own = items.select(F.col(id_col).alias("id"), F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0)).alias("total"))

    def cut(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            total = pdf["total"].to_numpy()
            pieces = np.maximum(1, -(-total // capacity))
            at = np.repeat(np.arange(len(pdf)), pieces)
            no = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = no * capacity
            size = np.minimum(total[at] - start, capacity)
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[at], "piece_no": no.astype("int32"), "start": start, "size": size})

    pieces = own.mapInPandas(cut, "id long, piece_no int, start long, size long")
    # a fixed number of partitions: the rows are small but the work on them is not, so they must not be coalesced by size
    pieces = pieces.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches))).repartition(min(batches, MOST_PARTITIONS), "batch")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "id", "piece_no"], ascending=[False, True, True], kind="stable")
        sizes = pdf["size"].to_numpy()
        window = np.full(len(pdf), -1, dtype=np.int64)
        full = sizes == capacity
        window[full] = np.arange(full.sum())
        rest = (sizes > 0) & ~full
        window[rest] = full.sum() + pack(sizes[rest], capacity)
        held = pd.array(np.where(window >= 0, int(pdf["batch"].iloc[0]) * (1 << 32) + window, 0), dtype="Int64") if len(pdf) else pd.array([], dtype="Int64")
        held[window < 0] = pd.NA
        return pd.DataFrame({"container_id": held, "id": pdf["id"], "piece_no": pdf["piece_no"], "start": pdf["start"], "size": pdf["size"]})

    packed = pieces.groupBy("batch").applyInPandas(run, "container_id long, id long, piece_no int, start long, size long")
    return packed.withColumnRenamed("id", id_col)
