"""Last value before a row, per key and order, without a task per key.

Rows are range-partitioned on (keys, order), so a hot key spans many tasks, and sorted inside; that is the only shuffle. A pass over each
range carries the last value on as it is written. Only the first key of a range can go on from earlier ranges, so what those end
with is one row per range, carried over the ranges and joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatgrid.operators.ranking import ordered_positions
from seatgrid.session import cut_lineage


def _carry(n_keys: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over sorted rows whose last columns are copies of the keys and the value: in place of the copies, the last value before the row."""
    def run(batches):
        held = None  # the keys and the value (an array of one) that the rows so far end with
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys, value = batch.columns[-1 - n_keys:-1], batch.column(batch.num_columns - 1)
            row = np.arange(n)
            changes = np.zeros(n, bool)
            for k in keys:
                changes[1:] |= pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False)
            goes_on = held is not None and all(k[0].as_py() == h for k, h in zip(keys, held[0], strict=True))
            start = np.maximum.accumulate(np.where(changes, row, 0))
            filled = np.maximum.accumulate(np.where(value.is_valid().to_numpy(zero_copy_only=False), row, -1))
            before = np.append(-1, filled[:-1])
            before = np.where(before >= start, before, np.where((start == 0) & goes_on, n, -1))
            every = pa.concat_arrays([value, held[1] if goes_on else pa.nulls(1, value.type)])
            here = every.take(pa.array(before, mask=before < 0))
            end = filled[-1] if filled[-1] >= start[-1] else n if goes_on and start[-1] == 0 else None
            held = [k[n - 1].as_py() for k in keys], pa.nulls(1, value.type) if end is None else every.slice(end, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1 - n_keys], value, here],
                                             [*batch.schema.names[:-1 - n_keys], "_value", "_here"])
    return run


def carry_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Adds ``out``: the last non-null ``value`` of the earlier rows of the same keys, in ascending ``order`` (nulls first).
    Keys are not null; the order should be total within a key."""
    cols = df.columns
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    ranged = df.withColumn("_value", value).repartitionByRange(*by).sortWithinPartitions(*by).select(
        *cols, F.monotonically_increasing_id().alias("_at"), *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_value")
    kind = ranged.schema["_value"].dataType
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in ranged.schema.fields[:len(cols) + 1]]
                          + [T.StructField("_value", kind), T.StructField("_here", kind)])
    t = cut_lineage(ranged.mapInArrow(_carry(len(keys)), schema)).withColumn("_pid", F.shiftright("_at", 33))
    last = t.groupBy("_pid").agg(F.max("_at").alias("_at"))
    # one row per range: the key it ends with, and the last value of that key up to there
    names = [f"_key{i}" for i in range(len(keys))]
    ends = t.join(F.broadcast(last), ["_pid", "_at"]).select("_pid", *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)],
                                                             F.coalesce("_value", "_here").alias("_end"))
    up_to = Window.partitionBy(*names).orderBy("_pid").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("_end", F.last("_end", ignorenulls=True).over(up_to))
    in_turn = Window.orderBy("_pid")
    before = ends.select("_pid", *[F.lag(c).over(in_turn).alias(c) for c in (*names, "_end")])
    same = reduce(Column.__and__, [F.col(k) == F.col(n) for k, n in zip(keys, names, strict=True)])
    return t.join(F.broadcast(before), "_pid").select(*cols, F.coalesce("_here", F.when(same, F.col("_end"))).alias(out))


def running_at(points: DataFrame, asks: DataFrame, keys: Sequence[str], weights: Sequence[str]) -> DataFrame:
    """Running sums at places of an order: points (keys, at, place, weights...) and asks (keys, at, place, ask_id) give
    (ask_id, one ``before_<weight>`` per weight: the sum over the points of the keys before the ask). Among equal ``at`` a smaller ``place`` is
    earlier. One numbering of both tables by range partitions; no pairs."""
    no = {w: F.lit(0).cast("bigint").alias(w) for w in weights}
    both = points.select(*keys, "at", "place", *[F.col(w).cast("bigint").alias(w) for w in weights], F.lit(None).cast("string").alias("ask_id")) \
        .unionByName(asks.select(*keys, "at", "place", *no.values(), F.col("ask_id").cast("string").alias("ask_id")))
    order = [F.col("at").asc_nulls_first(), F.col("place").asc(), F.col("ask_id").asc_nulls_first()]
    pos = ordered_positions(both, order, keys=keys, weight=F.lit(0), weights={w: F.col(w) for w in weights})
    return pos.filter(F.col("ask_id").isNotNull()).select("ask_id", *[F.col(f"_before_{w}").alias(f"before_{w}") for w in weights])
