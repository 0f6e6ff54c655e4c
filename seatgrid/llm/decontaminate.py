"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Test items are short and documents are long, so the search is by containment: the share of an item's
distinct five-word shingles that a document holds (at least ``threshold``).

1. Items are partitioned by shingle count q. An item's sketch is its m smallest shingle hashes (one
   permutation, bottom-m MinHash), with m = min(floor((1 - threshold) q) + 1, ``MOST_HASHES``) by size
   partition: a document that holds the threshold share of the item lacks at most (1 - threshold) q
   shingles, so with m above that it shares a sketch hash for certain, and with ``MOST_HASHES`` it misses
   all of them with a chance of at most (1 - threshold) ** MOST_HASHES (2.6e-6 at 0.8).
2. Every shingle of every document is probed against the sketches. The documents' side is not sketched:
   the part of a long document that a short item covers is arbitrarily small, so any sketch of fixed
   size would lose it. Documents are partitioned by size too: one with fewer shingles than an item
   needs is out before the probe's matches are kept.
3. Candidate pairs are verified on the shingles themselves (word strings, no hashes).

Words are lower-cased runs of letters, digits and non-ASCII characters. Items with fewer than five words have
no shingle and are not searched; such documents match nothing; nulls count as empty texts. Items with
a null item_id are searched like others. The result has one row per (doc_id, item_id) that meets the
threshold; rows that repeat an id are taken together, by their largest containment. Only ``doc_id``, ``text``
and ``item_id``, ``text`` are read, so further columns cannot clash. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatgrid.llm.common import SHINGLE_WORDS, SIMILARITY, alnum_words, drop_rows, text_key, whole_text
from seatgrid.session import cut_lineage

MOST_HASHES = 8


def _windows(words: Column, one) -> Column:
    """one(i) for every window start i of five words; none for shorter texts."""
    starts = F.when(F.size(words) >= SHINGLE_WORDS, F.sequence(F.lit(0), F.size(words) - SHINGLE_WORDS)) \
        .otherwise(F.array().cast("array<int>"))
    return F.transform(starts, one)


def shingle_hashes(words: Column) -> Column:
    return _windows(words, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE_WORDS)]))


def shingle_texts(words: Column) -> Column:
    return _windows(words, lambda i: F.array_join(F.slice(words, i + 1, SHINGLE_WORDS), " "))


def need(q: Column, threshold: float) -> Column:
    """ceil(threshold * q), in whole numbers."""
    return F.ceil(F.lit(round(threshold * 1000)) * q / F.lit(1000)).cast("int")


def item_sketches(items: DataFrame, threshold: float) -> DataFrame:
    """One row per item text and sketch hash: item_id, item_key, h, q, need."""
    i = items.select("item_id", text_key().alias("item_key"), alnum_words(whole_text()).alias("w"))
    i = i.select("item_id", "item_key", F.array_sort(F.array_distinct(shingle_hashes(F.col("w")))).alias("hs"))
    q = F.size("hs")
    m = F.least(q - need(q, threshold) + 1, F.lit(MOST_HASHES))
    return i.filter(q > 0).select("item_id", "item_key", q.alias("q"), need(q, threshold).alias("need"),
                                  F.explode(F.slice("hs", 1, m)).alias("h"))


def find_contained(docs: DataFrame, items: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, text_key, item_id, n_item (shingles of the item), n_found, containment; a row per
    document row and item."""
    # The sketches are written, so the planner knows their size and broadcasts them only when small.
    sketches = cut_lineage(item_sketches(items, threshold))
    texts = items.select("item_id", text_key().alias("item_key"), alnum_words(whole_text()).alias("w")) \
        .select("item_id", "item_key", F.array_distinct(shingle_texts(F.col("w"))).alias("wanted"))
    d = docs.select("doc_id", whole_text().alias("text"))
    probes = d.select("doc_id", text_key().alias("text_key"), alnum_words(F.col("text")).alias("w")) \
        .select("doc_id", "text_key", F.size("w").alias("n"), F.explode(shingle_hashes(F.col("w"))).alias("h"))
    # A document has no more candidate items than shingles. Written for the same reason as above.
    candidates = cut_lineage(
        probes.join(sketches.select("h", "need", "item_key"), "h")
        .filter(F.col("n") - (SHINGLE_WORDS - 1) >= F.col("need"))
        .groupBy("doc_id", "text_key").agg(F.collect_set("item_key").alias("item_keys")))
    keyed = d.withColumn("text_key", text_key())
    c = candidates.select(F.col("doc_id").alias("c_id"), F.col("text_key").alias("c_key"), "item_keys")
    held = keyed.join(c, keyed["doc_id"].eqNullSafe(c["c_id"]) & (keyed["text_key"] == c["c_key"])) \
        .select("doc_id", "text_key", alnum_words(F.col("text")).alias("w"), "item_keys") \
        .select("doc_id", "text_key", F.array_distinct(shingle_texts(F.col("w"))).alias("has"), "item_keys") \
        .select("doc_id", "text_key", "has", F.explode("item_keys").alias("item_key"))
    n_item = F.size("wanted")
    return held.join(texts, "item_key").select(
        "doc_id", "text_key", "item_id", n_item.cast("bigint").alias("n_item"),
        F.size(F.array_intersect("wanted", "has")).cast("bigint").alias("n_found")) \
        .filter(F.col("n_found") >= need(F.col("n_item"), threshold)) \
        .withColumn("containment", F.col("n_found") / F.col("n_item"))


def contained_pairs(found: DataFrame) -> DataFrame:
    """One row per (doc_id, item_id), by the largest containment."""
    best = F.max(F.struct("containment", "n_found", "n_item")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", F.col("b.n_item").alias("n_item"), F.col("b.n_found").alias("n_found"),
        F.col("b.containment").alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The documents that hold no item, every column kept."""
    found = cut_lineage(find_contained(docs, items, threshold).select("doc_id", "text_key").distinct())
    return drop_rows(docs, found)


ORACLE = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i5 AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM iw)),
q AS (SELECT item_id, count(*) AS n_item FROM i5 GROUP BY item_id),
d5 AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw)),
f AS (SELECT doc_id, item_id, count(*) AS n_found FROM d5 JOIN i5 USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_found, n_found / n_item AS containment
FROM f JOIN q USING (item_id) WHERE 10 * n_found >= 8 * n_item"""
