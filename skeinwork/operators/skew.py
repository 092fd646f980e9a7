"""Per-key results when a few keys hold most rows.

Rows are range-partitioned on (key, order, tie) with Spark's sampled quantiles, so a heavy key is cut over as
many partitions as its rows need. Each partition folds its sorted rows into one partial state per key; the
states of a key that met a partition boundary are stitched in partition order. No task sees more than its
range, and what is shuffled a second time is at most one small row per key and partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_STATE = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("n_ordered", T.LongType()),
        T.StructField("first_at", T.LongType()),
        T.StructField("last_at", T.LongType()),
        T.StructField("max_gap", T.LongType()),
    ]
)
_ARROW = pa.schema(
    [
        ("key", pa.string()),
        ("part", pa.int32()),
        ("n", pa.int64()),
        ("n_ordered", pa.int64()),
        ("first_at", pa.int64()),
        ("last_at", pa.int64()),
        ("max_gap", pa.int64()),
    ]
)


def _runs(keys: pa.Array) -> np.ndarray:
    """Start of each run of equal neighbouring keys (null equals null)."""
    if len(keys) == 1:
        return np.zeros(1, dtype=np.int64)
    a, b = keys[1:], keys[:-1]
    same = pc.fill_null(pc.equal(a, b), False)
    both_null = pc.and_(pc.is_null(a), pc.is_null(b))
    change = ~np.asarray(pc.or_(same, both_null).to_numpy(zero_copy_only=False), dtype=bool)
    return np.concatenate(([0], np.flatnonzero(change) + 1))


def _merge(s: list, t: list) -> None:
    """Fold state t, of later rows of the same key, into s. Layout: n, n_ordered, first, last, max_gap."""
    s[0] += t[0]
    if t[1]:
        if s[1]:
            gaps = [g for g in (s[4], t[4], t[2] - s[3]) if g is not None]
            s[4] = max(gaps)
        else:
            s[2], s[4] = t[2], t[4]
        s[3] = t[3]
        s[1] += t[1]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    key, state, done = None, None, []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*done)) if done else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ARROW.types)], schema=_ARROW)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, order = batch.column(0), batch.column(1)
        starts = _runs(keys)
        ends = np.append(starts[1:], batch.num_rows)
        valid = np.asarray(order.is_valid().to_numpy(zero_copy_only=False), dtype=bool)
        at = np.asarray(order.fill_null(0).to_numpy(zero_copy_only=False))
        for b, e in zip(starts.tolist(), ends.tolist()):
            own = at[b:e][valid[b:e]]
            new = [e - b, len(own), None, None, None]
            if len(own):
                new[2], new[3] = int(own[0]), int(own[-1])
                new[4] = int(np.diff(own).max()) if len(own) > 1 else None
            k = keys[b].as_py()
            if state is not None and k == key:
                _merge(state, new)
            else:
                if state is not None:
                    done.append((key, part, *state))
                key, state = k, new
        if len(done) >= 10_000:
            yield flush()
            done = []
    if state is not None:
        done.append((key, part, *state))
    yield flush()


def keyed_run_states(df: DataFrame, key: str, order: str, tie: str, partitions: int | None = None) -> DataFrame:
    """One row per key: ``key, n, first_at, last_at, max_gap`` (order values as bigint; timestamps as microseconds).

    n counts the key's rows, first_at and last_at are its least and greatest order values and max_gap the greatest
    step between neighbouring ones, which needs the rows of a key in order across partitions. Null keys form one
    group; rows whose order is null count in n only; an empty table gives no rows; first_at, last_at and max_gap
    are null where there is no order value (max_gap also where there is one). ``tie`` should make rows distinct,
    so that a heavy key with equal order values can still be split. Other columns of df are not read.
    """
    kind = df.schema[order].dataType
    at = F.unix_micros(F.col(order)) if isinstance(kind, T.TimestampType) else F.col(order).cast("long")
    rows = df.select(F.col(key).cast("string").alias("key"), at.alias("at"), F.col(tie).alias("tie"))
    by = [F.col("key"), F.col("at"), F.col("tie")]
    ranged = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    states = ranged.sortWithinPartitions(*by).select("key", "at").mapInArrow(_fold, _STATE)
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    stitched = states.withColumn("step", F.col("first_at") - F.last("last_at", ignorenulls=True).over(before))
    return stitched.groupBy("key").agg(
        F.sum("n").alias("n"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
        F.max(F.greatest("max_gap", "step")).alias("max_gap"),
    )


def heavy_keys(df: DataFrame, key: str, order: str, tie: str, share: float) -> DataFrame:
    """Keys (``key, n``) that hold at least ``share`` of all rows of df, those with a null key counted in the total only."""
    total = df.count()
    states = keyed_run_states(df, key, order, tie)
    return states.filter(F.col("key").isNotNull() & (F.col("n") >= F.lit(share) * F.lit(total))).select("key", "n")
