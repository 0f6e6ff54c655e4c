"""A table partitioned by a column, changed one partition at a time (dynamic partition overwrite).

Only the partitions that new rows fall into are read and written again; the files of the others stay as they are. New rows
replace rows of the same key, so a job that is run again after a failure leaves the table as one run does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatgrid.session import cut_lineage


def create(rows: DataFrame, path: str, partition: str) -> None:
    """Writes a table; a partition's rows go to one task each so that it gets few files."""
    rows.repartition(partition).write.partitionBy(partition).mode("errorifexists").parquet(path)


def append(spark: SparkSession, path: str, rows: DataFrame, partition: str, key: list[str]) -> None:
    """Adds rows to the table at ``path``. A key's partition must not change between runs."""
    table = spark.read.parquet(path)
    new = cut_lineage(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema.fields]))
    touched = new.select(partition).distinct()
    # the scan is pruned to the touched partitions; written apart first, as they are about to be replaced
    kept = table.join(F.broadcast(touched), partition, "left_semi").join(new.select(*key), key, "left_anti")
    merged = cut_lineage(kept.unionByName(new))
    merged.repartition(partition).write.partitionBy(partition).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
