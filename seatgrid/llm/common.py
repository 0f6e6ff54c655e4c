"""What the training-data operators share: table access, word rules, null-safe joins."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the word rules (Java and RE2 read them alike).
SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # over lower-cased text: a-z, 0-9, all non-ASCII
SHINGLE_WORDS = 5
SIMILARITY = 0.8


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of at most ``rows`` rows for the jobs run inside, so that a Python worker holds a few MB of texts at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def alnum_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(ALNUM_WORD), F.lit(0))


def text_key(name: str = "text") -> Column:
    """128-bit digest of the whole text (null as empty): equal texts, equal keys."""
    return F.unhex(F.md5(F.encode(whole_text(name), "UTF-8")))


def _by_row(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    d = docs.withColumn("__text_key", text_key())
    k = keys.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__k"))
    hit = d["doc_id"].eqNullSafe(k["__id"]) & (d["__text_key"] == k["__k"])
    return d.join(k, hit, how)


def keep_rows(docs: DataFrame, keys: DataFrame, once: bool = False) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, text) is among ``keys`` (doc_id, text_key), every column kept;
    with ``once`` one of those that repeat each other.

    A row is known by its doc_id and whole text, so null and repeated ids are safe.
    """
    kept = _by_row(docs, keys, "left_semi")
    return (kept.dropDuplicates(["doc_id", "__text_key"]) if once else kept).select(*docs.columns)


def drop_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, text) is not among ``keys``, every column kept."""
    return _by_row(docs, keys, "left_anti").select(*docs.columns)
