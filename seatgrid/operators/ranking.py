"""Global and per-key ordered positions without a single-task window.

A window with no PARTITION BY (or with one hot key) sends every row to one task.
Here rows are range-partitioned on (keys, order) so one key may span many tasks;
per-partition counts (at most one row per partition and key) are turned into
offsets, and each task numbers its own rows. The partition tag is checkpointed so
that the count branch and the numbering branch see the same partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatgrid.session import cut_lineage


def tag_ranges(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (),
               num_partitions: int | None = None) -> DataFrame:
    """Range-partition on (keys, order), tag each row with its partition ``_pid`` and
    checkpoint, so every later pass sees the same partitioning (a re-sampled range
    shuffle could otherwise place rows differently). Without ``num_partitions`` the ranges
    are as many as the data needs: adaptive execution joins small neighbours."""
    by = [*[F.col(k).asc_nulls_first() for k in keys], *order]
    ranged = df.repartitionByRange(num_partitions, *by) if num_partitions else df.repartitionByRange(*by)
    return cut_lineage(ranged.withColumn("_pid", F.spark_partition_id()))


def _global_positions(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Row numbers over one global order with a single shuffle: ranges, sorted inside, numbered by their place in
    the range (written with it) plus the rows of the ranges before (at most one row per range, broadcast)."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id())
    t = cut_lineage(ranged).withColumn("_pid", F.shiftright("_mid", 33))
    counts = t.groupBy("_pid").agg(F.count(F.lit(1)).alias("_pc"))
    every = Window.orderBy("_pid")  # one row per range
    offsets = counts.select("_pid", (F.sum("_pc").over(every) - F.col("_pc")).alias("_off"),
                            F.sum("_pc").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"))
    place = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_off")
    return t.join(F.broadcast(offsets), "_pid").select(*df.columns, (place + 1).alias("_pos"), place.alias("_before"), "_total")


def positions_from_tags(tagged: DataFrame, order: Sequence[Column], keys: Sequence[str] = (),
                        weights: dict[str, Column] | None = None, out_cols: Sequence[str] | None = None) -> DataFrame:
    """Row numbers / running sums over a frame tagged by :func:`tag_ranges` (same order/keys)."""
    ws = {k: v.cast("bigint") for k, v in (weights or {}).items()}
    t = tagged
    for k, v in ws.items():
        t = t.withColumn("_w" + k, v)
    per_part = t.groupBy("_pid", *keys).agg(
        F.count(F.lit(1)).alias("_pc"), *[F.sum("_w" + k).alias("_pw" + k) for k in ws])
    by_part = Window.partitionBy(*keys).orderBy("_pid")
    earlier = by_part.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        "_pid", *keys,
        F.coalesce(F.sum("_pc").over(earlier), F.lit(0)).alias("_off_c"),
        *[F.coalesce(F.sum("_pw" + k).over(earlier), F.lit(0)).alias("_off_w" + k) for k in ws],
        F.sum("_pc").over(Window.partitionBy(*keys)).alias("_total"),
    )
    if not keys:
        # at most one row per partition: a proven size bound
        offsets = F.broadcast(offsets)
    joined = t.join(offsets, ["_pid", *keys])
    inside = Window.partitionBy("_pid", *keys).orderBy(*order)
    prior = inside.rowsBetween(Window.unboundedPreceding, -1)
    cols = out_cols if out_cols is not None else [c for c in tagged.columns if c != "_pid"]
    return joined.select(
        *cols,
        (F.row_number().over(inside) + F.col("_off_c")).alias("_pos"),
        *[(F.coalesce(F.sum("_w" + k).over(prior), F.lit(0)) + F.col("_off_w" + k)).alias("_before" + k) for k in ws],
        F.col("_total"),
    )


def ordered_positions(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (),
                      weight: Column | None = None, num_partitions: int | None = None,
                      weights: dict[str, Column] | None = None) -> DataFrame:
    """Add ``_pos`` (1-based row number within ``keys`` by ``order``), ``_before`` (sum of
    ``weight`` over strictly earlier rows of the key), ``_before_<name>`` for each extra
    entry of ``weights``, and ``_total`` (row count of the key).

    ``order`` must be a total order within a key for ``_pos`` to be deterministic.
    """
    if not keys and weight is None and not weights:
        return _global_positions(df, order)
    ws = {"": weight if weight is not None else F.lit(1)}
    ws.update({"_" + k: v for k, v in (weights or {}).items()})
    tagged = tag_ranges(df, order, keys, num_partitions)
    return positions_from_tags(tagged, order, keys, ws, out_cols=df.columns)


def rank_by(df: DataFrame, value: Column, descending: bool = True, rank_col: str = "rank",
            dense_col: str | None = None) -> DataFrame:
    """RANK() (and optionally DENSE_RANK()) over one global ordering value.

    Counts rows per distinct value first (partial aggregation), ranks the distinct
    values with :func:`ordered_positions`, and joins the ranks back on the value
    (null-safe). DESC puts NULLs first and ASC puts them last, as SQL databases do.
    """
    v = "_rank_value"
    base = df.withColumn(v, value)
    distinct = base.groupBy(v).agg(F.count(F.lit(1)).alias("_cnt"))
    order = F.col(v).desc_nulls_first() if descending else F.col(v).asc_nulls_last()
    ranked = ordered_positions(distinct, [order], weight=F.col("_cnt"))
    cols = [(F.col("_before") + 1).cast("bigint").alias(rank_col)]
    if dense_col:
        cols.append(F.col("_pos").cast("bigint").alias(dense_col))
    ranked = ranked.select(F.col(v).alias("_rv"), *cols)
    out = base.join(ranked, base[v].eqNullSafe(ranked["_rv"]))
    return out.drop(v, "_rv")
