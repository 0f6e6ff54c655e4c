"""Column helpers shared by every operator. All are built-in expressions (codegen, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: times are 'HH:MM' strings compared as text; only this shape orders correctly.
TIME_PATTERN = r"^[0-9]{2}:[0-9]{2}$"


def pair_key(first: Column, second: Column) -> Column:
    """One exact number for a pair of non-negative bigints: first * 10^19 + second. Every bigint is below
    10^19, so different pairs never meet, and pairs order by (first, second)."""
    one = F.lit("1" + "0" * 19).cast("decimal(20,0)")
    return (first.cast("decimal(18,0)") * one + second.cast("decimal(19,0)")).cast("decimal(38,0)")


def minutes(t: Column) -> Column:
    """'HH:MM' -> minutes after midnight (NULL when the text is not well formed)."""
    return F.when(t.rlike(TIME_PATTERN), F.substring(t, 1, 2).cast("int") * 60 + F.substring(t, 4, 2).cast("int"))


def well_formed_interval(start: Column, end: Column) -> Column:
    """Both ends are 'HH:MM' and start < end: such intervals overlap iff they share a minute."""
    return F.coalesce(start.rlike(TIME_PATTERN) & end.rlike(TIME_PATTERN) & (start < end), F.lit(False))


def pct_half_up(num: str, den: str) -> Column:
    """round(100 * num / den, 2) with exact half-up rounding, returned as DOUBLE.

    ``num`` and ``den`` are SQL expressions. Integer arithmetic (``div``), so the
    result is the exact decimal answer (what a NUMBER / NUMERIC engine computes) and
    bit-identical across engines. NULL when den is 0 or NULL. Meant for num >= 0,
    den > 0.
    """
    n, d = f"CAST(({num}) AS BIGINT)", f"CAST(({den}) AS BIGINT)"
    return F.expr(f"CASE WHEN {d} <> 0 THEN CAST((({n} * 20000 + {d}) div ({d} * 2)) AS DOUBLE) / 100 END")


def fill_pct(booked: str = "booked_seats", total: str = "total_seats") -> Column:
    """Fill percentage of a session: round(booked / total * 100, 2); NULL if total is 0 or NULL."""
    return pct_half_up(booked, total)


def desc_first(c: str | Column) -> Column:
    """DESC NULLS FIRST (the Oracle / PostgreSQL default for DESC; Spark's is NULLS LAST)."""
    return (F.col(c) if isinstance(c, str) else c).desc_nulls_first()


def present(df: DataFrame) -> DataFrame:
    """Report form of a result: money as DOUBLE, dates as ISO 'yyyy-MM-dd' text, pair keys as digits."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DecimalType) and f.dataType.scale == 0 and f.dataType.precision == 38:
            cols.append(F.col(f.name).cast("string").alias(f.name))
        elif isinstance(f.dataType, T.DecimalType):
            cols.append(F.col(f.name).cast("double").alias(f.name))
        elif isinstance(f.dataType, T.DateType):
            cols.append(F.col(f.name).cast("string").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
