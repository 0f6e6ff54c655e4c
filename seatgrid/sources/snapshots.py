"""Versioned table snapshots: a multi-table change becomes visible all at once.

Every table of a change is written whole under ``<base>/<table>/v=<n>``; only then is
the commit marker ``<base>/_commits/v=<n>`` written. Readers take the newest version
that has a marker, so a half-written version (a failed job, a lost executor) is never
read, and a retried job writes over its own uncommitted directories.

Only a missing path counts as "no commit yet"; any other failure to read the markers is
raised, so a damaged marker never makes version 0 look free. The marker is written without
overwriting: of two writers that chose the same version, the second one fails.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MARK = T.StructType([T.StructField("tables", T.IntegerType()), T.StructField("v", T.LongType())])


def read_if_there(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The parquet table at ``path``, or None if there is no such path; every other error is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def committed_version(spark: SparkSession, base: str) -> int | None:
    """The newest committed version number, or None before the first commit."""
    marks = read_if_there(spark, f"{base}/_commits", _MARK)
    if marks is None:
        return None
    # the marker rows are read as well, so a damaged marker fails here
    v = marks.filter(F.col("tables").isNotNull()).agg(F.max("v")).first()[0]
    if v is None:
        raise RuntimeError(f"{base}/_commits holds no readable commit marker")
    return int(v)


def commit(spark: SparkSession, base: str, tables: dict[str, DataFrame]) -> int:
    """Write ``tables`` as the next version and commit it; returns the new version number."""
    current = committed_version(spark, base)
    v = 0 if current is None else current + 1
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}/v={v}")
    marker = spark.createDataFrame([(len(tables),)], "tables int")
    marker.write.mode("errorifexists").parquet(f"{base}/_commits/v={v}")
    return v


def read(spark: SparkSession, base: str, name: str, version: int | None = None) -> DataFrame:
    """A table as of ``version`` (default: the newest committed one)."""
    v = committed_version(spark, base) if version is None else version
    if v is None:
        raise FileNotFoundError(f"no committed version under {base}")
    return spark.read.parquet(f"{base}/{name}/v={v}")
