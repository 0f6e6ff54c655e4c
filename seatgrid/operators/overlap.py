"""Interval-overlap joins (same date, half-open 'HH:MM' ranges) without all-pairs blowup.

Well-formed intervals are exploded into the time bins they cover and joined on
(keys, bin); a pair is kept only in the bin holding the later start, so each
overlapping pair appears once. Two well-formed intervals overlap iff they share a
minute, and the later start lies in both, so no pair is lost. Rows whose times are
not 'HH:MM' with start < end can still satisfy the string predicate; they alone go into every
bin, as if they started in the first one, and so meet each row of their keys once.
Where the right side has many such rows (``odd_right``), they get bins of their own, which left rows
enter once, so that two of them are compared once and not in every bin.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatgrid.functions.rules import minutes, well_formed_interval


LAST_MINUTE = 99 * 60 + 99  # what 'HH:MM' can say
ODD = LAST_MINUTE + 1  # added to the bins of odd rows that have bins of their own


def _prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select(*[F.col(c).alias(p + c) for c in df.columns])


def has_odd(df: DataFrame) -> bool:
    """Whether some row's times aren't 'HH:MM' with start < end (rows with a null time overlap nothing and don't count)."""
    s, e = F.col("start_time"), F.col("end_time")
    return not df.filter(s.isNotNull() & e.isNotNull() & ~well_formed_interval(s, e)).isEmpty()


def _with_bins(df: DataFrame, p: str, bin_minutes: int, own: str = "") -> DataFrame:
    """One row for each bin a row covers; rows with a null time overlap nothing. With ``own`` odd rows of the right side have
    bins of their own ("have"), which a row of the left side enters where it starts ("enter")."""
    s, e = minutes(F.col(p + "start_time")), minutes(F.col(p + "end_time"))
    wf = well_formed_interval(F.col(p + "start_time"), F.col(p + "end_time"))
    first = F.when(wf, F.floor(s / bin_minutes)).otherwise(0).cast("int")
    last = F.when(wf, F.floor((e - 1) / bin_minutes)).otherwise(LAST_MINUTE // bin_minutes).cast("int")
    known = df.filter(F.col(p + "start_time").isNotNull() & F.col(p + "end_time").isNotNull())
    sbin = F.col(p + "_sbin")
    bins = F.sequence(sbin, last)
    if own == "have":
        bins = F.when(wf, bins).otherwise(F.sequence(sbin + ODD, last + ODD))
    elif own == "enter":
        bins = F.concat(bins, F.array(sbin + ODD))
    return known.withColumn(p + "_sbin", first).withColumn("_bin", F.explode(bins))


def overlap_pairs(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str],
                  bin_minutes: int = 60, left_date: str = "event_date", right_date: str = "event_date",
                  extra: Callable[[DataFrame, DataFrame], Column] | None = None, odd_right: bool = False) -> DataFrame:
    """All (left, right) pairs with equal keys whose intervals overlap on the same date.

    Both sides need ``start_time`` / ``end_time`` and a date column; keys should
    include the date. Output columns are prefixed ``l_`` and ``r_``. ``extra`` is an
    additional pair predicate over the prefixed frames (e.g. ``l.id < r.id``). ``odd_right`` changes
    no result: it costs a bin more for each left row, and is for a right side with many odd times.
    """
    lx = _with_bins(_prefixed(left, "l_"), "l_", bin_minutes, "enter" if odd_right else "")
    rx = _with_bins(_prefixed(right, "r_"), "r_", bin_minutes, "have" if odd_right else "")
    out_cols = ["l_" + c for c in left.columns] + ["r_" + c for c in right.columns]

    def pred(a: DataFrame, b: DataFrame) -> Column:
        c = ((a["l_" + left_date] == b["r_" + right_date])
             & (a["l_start_time"] < b["r_end_time"]) & (b["r_start_time"] < a["l_end_time"]))
        if extra is not None:
            c = c & extra(a, b)
        return c

    def key_eq(a: DataFrame, b: DataFrame) -> Column:
        c = F.lit(True)
        for lk, rk in zip(left_keys, right_keys):
            c = c & (a["l_" + lk] == b["r_" + rk])
        return c

    once = (lx["_bin"] % ODD if odd_right else lx["_bin"]) == F.greatest(lx["l__sbin"], rx["r__sbin"])
    return lx.join(rx, key_eq(lx, rx) & (lx["_bin"] == rx["_bin"]) & once & pred(lx, rx)).select(*out_cols)
