"""Keyed state of a ``foreachBatch`` sink, compacted by key as it grows.

After n batches the state is made of parts that cover 2 ** k batches each, one for every bit set in n (as a binary counter). Batch
b writes one part: its own rows merged with the parts its carry covers. So at most log2(n) parts are live, their
names follow from the batch id alone (nothing is listed), and a row is rewritten at most log2(n) times. A retried batch reads the
same parts and overwrites its own; the parts a batch covered go when the next one begins, as only then it is known
to be committed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def live_parts(n: int) -> list[tuple[int, int]]:
    """The parts (first batch, end) that hold the state after n batches, oldest first."""
    out, at = [], 0
    for k in reversed(range(n.bit_length())):
        if n >> k & 1:
            out.append((at, at + (1 << k)))
            at += 1 << k
    return out


class BatchState:
    """path: where the parts live; schema: of a state row; merge: the newest parts' rows by key, given a frame of the schema with
    ``_age`` (larger: newer)."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, merge: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.schema, self.merge = spark, path, schema, merge

    def _part(self, part: tuple[int, int]) -> str:
        return f"{self.path}/part-{part[0]}-{part[1]}"

    def _read(self, parts: list[tuple[int, int]]) -> DataFrame:
        out = self.spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField("_age", T.LongType())]))
        for part in parts:
            rows = self.spark.read.schema(self.schema).parquet(self._part(part))
            out = out.unionByName(rows.selectExpr("*", f"{part[0]}L AS _age"))
        return out

    def before(self, batch_id: int, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """The state before a batch; ``keep`` limits the parts' rows to the keys that are needed, before they are merged."""
        self._retire(batch_id)
        return self.merge(keep(self._read(live_parts(batch_id)))).select(*self.schema.fieldNames())

    def write(self, batch_id: int, rows: DataFrame) -> None:
        """Adds a batch's rows, one for each key: one part, merged with those its carry covers."""
        after = live_parts(batch_id + 1)[-1]
        covered = [p for p in live_parts(batch_id) if p[0] >= after[0]]
        part = rows.select(*self.schema.fieldNames())
        if covered:
            part = self.merge(self._read(covered).unionByName(part.selectExpr("*", f"{batch_id}L AS _age"))).select(*part.columns)
        part.write.mode("overwrite").option("compression", "zstd").parquet(self._part(after))

    def _retire(self, batch_id: int) -> None:
        """Removes the parts that the batch before this one covered."""
        if batch_id < 1:
            return
        jvm = self.spark.sparkContext._jvm
        for part in set(live_parts(batch_id - 1)) - set(live_parts(batch_id)):
            path = jvm.org.apache.hadoop.fs.Path(self._part(part))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
