"""Sharding by proportional stratified interleaving (law ``rows``).

Rows of each source are put in a seeded random order (md5 of seed and doc_id; ties by doc_id, checksum and size)
and get the fractional rank (2 p - 1) / (2 n) for place p of n. All rows sorted by fractional rank (ties by
source, nulls first) form one sequence in which every stretch holds the sources in the mixture's
proportions; it is cut into equal stretches: shard = floor(position * shards / rows), so shard counts are at
most one apart and ``slot`` numbers a shard's rows from 0 without gaps.

Both orders are numbered by range partitions and per-partition offsets, never in one task, so a source may
hold any share of the rows. A null text is empty (size 1, checksum 0); a null source is a source; null ids sort first;
rows that repeat each other fill places of their own, whichever goes first. Only ``doc_id``, ``source`` and
``text`` are read for the placement. The law ``rows`` can't keep equal texts together, so it doesn't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatgrid.llm.common import whole_text
from seatgrid.operators.ranking import ordered_positions

SHARDS = 16
SEED = 20_240_607


def place_rows(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """rows with doc_id, source and order columns size, text_crc32: adds shard and slot."""
    mixed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    # rows that repeat each other can be many: a number of their own spreads them over ranges
    r = rows.withColumn("_mix", mixed).withColumn("_tie", F.monotonically_increasing_id())
    ranked = ordered_positions(r, [F.col("_mix"), F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.col("_tie")], keys=["_src"])
    ranked = ranked.withColumn("_part", (2 * F.col("_pos") - 1) / (2 * F.col("_total"))).drop("_pos", "_before", "_total", "_mix")
    placed = ordered_positions(ranked, [F.col("_part"), F.col("_src"), F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.col("_tie")])
    at, n = F.col("_pos") - 1, F.col("_total")
    shard = F.expr(f"(_pos - 1) * {int(shards)} div _total")
    first = F.expr(f"((((_pos - 1) * {int(shards)} div _total) * _total) + {int(shards) - 1}) div {int(shards)}")
    return placed.select(*[c for c in rows.columns], shard.cast("int").alias("shard"), (at - first).cast("bigint").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot, grown_shard (null under this law)."""
    # Joins by source are null-safe: the key tells a null source from every name.
    src = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source")))
    narrow = docs.select("doc_id", src.alias("_src"), (F.octet_length(whole_text()) + 1).cast("bigint").alias("size"),
                         F.crc32(F.encode(whole_text(), "UTF-8")).alias("text_crc32"))
    placed = place_rows(narrow, shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), F.expr("if(_src = '0', null, substring(_src, 2))").alias("source"))
