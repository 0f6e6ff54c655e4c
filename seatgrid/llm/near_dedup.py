"""Near-dedup: improved consistent weighted sampling (ICWS) over TF-IDF shingles, banded, verified.

1. A document is the weighted set of its five-word shingles (shorter texts: one shingle of all words): weight = tf * idf,
   idf = 1 - (1 - ``FLOOR``) * ln(df / cut) / ln(documents / cut) for shingles in more than cut = documents / ``RARE`` documents,
   else 1. Only shingles above the cut need a table, and there are at most ``RARE`` times the mean document length of
   them, whatever the corpus size; document frequencies are counted over all documents.
2. ``BANDS`` times ``ROWS`` ICWS samples per document: two documents share a sample with a chance of their weighted
   Jaccard similarity s, and a band with s ** ROWS, so a pair at 0.8 is missed by all bands with a chance of 0.0002.
   Four bits of each sample make a sketch; a pair at 0.8 agrees in fewer than ``AGREE`` of them with a chance below 1e-6,
   most pairs below 0.4 do.
3. Documents are nodes by the digest of their whole text, so exact copies are one node from here on. First every node is compared with
   the best pivot of its buckets (the node that shares the most buckets), so a group of n copies costs about n comparisons. Then buckets
   of up to ``CROWD`` nodes are compared whole, crowded ones as families, and what families leave in further rounds: whole as soon as all
   pairs of all buckets are no more than the places the nodes had in buckets at first, else as families again while they settle much, else
   with 8, 64, ... pivots of each bucket. Nodes already in one component need no comparison; pairs whose total weights differ by
   more than the similarity allows, or whose sketches disagree, are out. A bucket is done when what is left of it lies
   in one component, so no link between components is lost.
4. Families: a crowded bucket and all that share a member with it, joined by their members' best pivots. A family has a centre
   (the shingles of most of a few members) and each member x differs from it by a weight d(x). Two members differ by
   d(x) + d(y) less twice the differences they have in common, and are similar if that is at most l * (W(x) + W(y)), with
   l = (1 - similarity) / (1 + similarity). With g = d - l * W the member of least g links with all whose g is not above its -g.
   Each other member is similar only to members with (g(x) + g(y)) / 2 or more of its differences, so pairs are sought among the
   members that share one, rarest first, and have that much left from there on. Members so near the centre that all texts
   similar to them were in reach then leave the buckets, so members just below the similarity of each other cost no pairs.
5. Candidate pairs are verified by the exact weighted Jaccard similarity of the whole texts; links of
   ``SIMILARITY`` or more make components, and every document gets its component's least doc_id as class_id.

Nulls: a null text is an empty one; texts without a word are alike only if equal; rows with a null doc_id get a class
but never name one (class_id is null if all are). Repeated rows are exact copies; ``kept`` marks rows of the class's
least (doc_id, text). Only ``doc_id`` and ``text`` are read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatgrid.llm.common import SHINGLE_WORDS, SIMILARITY, keep_rows, small_batches, text_key, whole_text
from seatgrid.llm.components import connected_components
from seatgrid.llm.hashing import PIECE, mix, pieces, shingles
from seatgrid.session import cut_lineage

BANDS, ROWS = 16, 4
AGREE = 35
RARE = 1000
FLOOR = 0.7
PIVOTS = 8
CROWD = 16  # nodes of a bucket that are compared whole; a larger one is taken as a family
SAMPLE = 31  # members that make a family's centre
BUCKET_CHARS = 8_000_000  # text per counting bucket
HELD = 3_000_000  # shingles a counting task holds before it hands them on
_U = np.uint64


def _distinct(h: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in order: (row, hash, tf)."""
    row = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    o = np.lexsort((h, row))
    h, row = h[o], row[o]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(h)))


# ------------------------------------------------------------------ document frequencies


def _count_part(buckets: int):
    """Shingle fingerprints (32 bits) with the documents that hold them, per batch and fingerprint range:
    steps between sorted fingerprints in two halves, the high one almost all zeros, which compresses well."""
    edges = np.array([-(-(k << 32) // buckets) for k in range(buckets)], np.uint32)  # the least fingerprint of each range

    def counted(got):
        p = np.concatenate(got)
        got.clear()
        p.sort()
        first = np.flatnonzero(np.append(True, p[1:] != p[:-1])).astype(np.uint32)
        return p[first], np.diff(first, append=np.uint32(len(p)))

    def grouped(batches):
        got, held = [], 0
        for batch in batches:
            for _, _, h, at in pieces(batch.column(0)):
                got.append((_distinct(*shingles(h, at, SHINGLE_WORDS))[1] >> _U(32)).astype(np.uint32))
                held += len(got[-1])
                if held >= HELD:
                    yield counted(got)
                    held = 0
        if held:
            yield counted(got)

    def run(batches):
        for prints, n in grouped(batches):
            first = np.append(np.searchsorted(prints, edges), len(prints))
            ids = np.flatnonzero(np.diff(first))
            first, ends = first[ids], first[ids + 1]
            steps = [np.diff(prints[a:b], prepend=np.uint32(0)) for a, b in zip(first, ends, strict=True)]
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array(ids.astype(np.int32)),
                "low": pa.array([s.astype(np.uint16).tobytes() for s in steps], pa.binary()),
                "high": pa.array([(s >> 16).astype(np.uint16).tobytes() for s in steps], pa.binary()),
                "n": pa.array([n[a:b].astype(np.uint32).tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())})
    return run


_PART = "bucket int, low binary, high binary, n binary"


def _frequent(least: int):
    def run(t: pa.Table) -> pa.Table:
        prints, n = [], []
        for low, high, k in zip(*(t[c].to_pylist() for c in ("low", "high", "n")), strict=True):
            steps = np.frombuffer(low, np.uint16).astype(np.uint32) | np.frombuffer(high, np.uint16).astype(np.uint32) << 16
            prints.append(np.cumsum(steps, dtype=np.uint32))
            n.append(np.frombuffer(k, np.uint32))
        p, n = np.concatenate(prints), np.concatenate(n).astype(np.int64)
        o = np.argsort(p, kind="stable")
        p, n = p[o], n[o]
        first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        df = np.add.reduceat(n, first)
        often = df > least
        return pa.table({"print": pa.array(p[first][often].astype(np.int64)), "df": pa.array(df[often])})
    return run


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the shingles in more than documents / RARE documents, sorted, with their idf.

    Their number is at most RARE times the mean shingles per document, as each takes that share of them.
    """
    texts = docs.select(whole_text().alias("text"))
    rows, chars = texts.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    least = max(1, rows // RARE)
    buckets = max(1, (chars or 0) // BUCKET_CHARS)
    with small_batches(docs.sparkSession):
        found = texts.mapInArrow(_count_part(buckets), _PART).groupBy("bucket") \
            .applyInArrow(_frequent(least), "print bigint, df bigint").toArrow().sort_by("print")
    cut = max(1.0, rows / RARE)
    df = found["df"].to_numpy().astype(float)
    idf = 1 - (1 - FLOOR) * np.log(np.maximum(df / cut, 1)) / np.log(max(rows / cut, 2.0))
    return found["print"].to_numpy().astype(np.uint32), idf


def weights(h: np.ndarray, tf: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    prints, idf = frequent
    w = tf.astype(np.float64)
    if len(prints):
        own = (h >> _U(32)).astype(np.uint32)
        at = np.minimum(np.searchsorted(prints, own), len(prints) - 1)
        w *= np.where(prints[at] == own, idf[at], 1.0)
    return w


# ------------------------------------------------------------------ signatures


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1), and their logarithms, at 65,536 even steps (Newton on 1 - (1 + x) e^-x)."""
    p = (np.arange(65_536) + 0.5) / 65_536
    x = np.sqrt(2 * p) + p
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / (x * np.exp(-x)), x / 4)
    return x.astype(np.float32), np.log(x).astype(np.float32)


_GAMMA: list[np.ndarray] = []
_SALTS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=_U)) | _U(1)


def signatures(row: np.ndarray, h: np.ndarray, w: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that have a shingle, their band keys (one line of BANDS each) and their sketches (16 samples to a number)."""
    if not _GAMMA:
        _GAMMA.extend(_tables())
    gamma, log_gamma = _GAMMA
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    logw = np.log(w).astype(np.float32)
    place = np.arange(len(h), dtype=_U)
    bands = np.empty((len(first), BANDS), np.int64)
    sketch = np.zeros((len(first), BANDS * ROWS // 16), _U)
    for b in range(BANDS):
        key = np.full(len(first), b + 1, _U)
        for k in range(b * ROWS, (b + 1) * ROWS):
            x = h * _SALTS[2 * k]
            x ^= x >> _U(29)
            x *= _SALTS[2 * k + 1]
            r = gamma[x >> _U(48)]
            beta = ((x >> _U(16)) & _U(0xFFFF)).astype(np.float32) / 65_536
            t = np.floor(logw / r + beta)
            log_a = log_gamma[(x >> _U(32)) & _U(0xFFFF)] - r * (t - beta + 1)
            bits = log_a.view(np.int32)
            order = (bits ^ ((bits >> 31) & 0x7FFFFFFF)).astype(np.int64) + (1 << 31)  # sorts as the floats do
            at = (np.minimum.reduceat((order.astype(_U) << _U(32)) | place, first) & _U(0xFFFFFFFF)).astype(np.int64) \
                if len(first) else np.zeros(0, np.int64)
            sample = mix(h[at] + t[at].astype(np.int64).astype(_U) * _SALTS[1])
            sketch[:, k // 16] |= (sample >> _U(60)) << _U(4 * (k % 16))
            key = mix(key * _SALTS[0] + sample)
        bands[:, b] = key.view(np.int64)
    return row[first], bands, sketch.view(np.int64)


_SIGNED = T.StructType([T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType())),
                        T.StructField("weight", T.DoubleType())])
_SKETCH = [f"s{i}" for i in range(BANDS * ROWS // 16)]


def _lists(rows: int, has: np.ndarray, values: np.ndarray) -> pa.ListArray:
    """One list per row: its line of values, or an empty one for rows without."""
    n = np.zeros(rows, np.int64)
    n[has] = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(values.ravel()))


def signer(frequent: tuple[np.ndarray, np.ndarray]):
    @F.arrow_udf(_SIGNED)
    def sign(texts: pa.Array) -> pa.Array:
        parts = []
        for a, b, h, at in pieces(texts):
            row, own, tf = _distinct(*shingles(h, at, SHINGLE_WORDS))
            w = weights(own, tf, frequent)
            has, bands, sketch = signatures(row, own, w, b - a)
            parts.append(pa.StructArray.from_arrays(
                [_lists(b - a, has, bands), _lists(b - a, has, sketch), pa.array(np.bincount(row, w, b - a))], ["bands", "sketch", "weight"]))
        empty = pa.struct([("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())), ("weight", pa.float64())])
        return pa.concat_arrays(parts) if parts else pa.array([], empty)
    return sign


# ------------------------------------------------------------------ verification


def weighted_jaccard(left: pa.Array, right: pa.Array, frequent) -> np.ndarray:
    """Sum of least over sum of largest weights, text by text (0 where neither has a word)."""
    n, out, a = len(left), np.zeros(len(left)), 0
    ends = np.cumsum(sum(pc.binary_length(x.fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64) for x in (left, right)))
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PIECE, "right")))
        rows, hashes, sides = [], [], []
        for side, texts in enumerate((left.slice(a, b - a), right.slice(a, b - a))):
            for lo, _, h, at in pieces(texts):
                sh, cuts = shingles(h, at, SHINGLE_WORDS)
                rows.append(np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)) + lo)
                hashes.append(sh)
                sides.append(np.full(len(sh), side))
        row, h, side = map(np.concatenate, (rows, hashes, sides))
        o = np.lexsort((h, row))
        row, h, side = row[o], h[o], side[o]
        if len(h):
            first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])))
            y = np.add.reduceat(side, first)
            x = np.diff(np.append(first, len(h))) - y
            one = weights(h[first], np.ones(len(first)), frequent)
            low = np.bincount(row[first], np.minimum(x, y) * one, b - a)
            top = np.bincount(row[first], np.maximum(x, y) * one, b - a)
            out[a:b] = low / np.maximum(top, 1e-300)
        a = b
    return out


def comparer(frequent):
    @F.arrow_udf(T.DoubleType())
    def similarity(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array(weighted_jaccard(left, right, frequent))
    return similarity


def _links(pairs: DataFrame, texts: DataFrame, frequent, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts meet the similarity. b, the pivot, may be hot: its text goes to the narrow
    pairs first, then each pair to its own a."""
    nodes = cut_lineage(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    own = texts.join(nodes, "id", "left_semi")
    right = pairs.join(own.select(F.col("id").alias("b"), F.col("text").alias("right")), "b")
    both = right.join(own.select(F.col("id").alias("a"), F.col("text").alias("left")), "a")
    return both.select(*pairs.columns, comparer(frequent)("left", "right").alias("s")).filter(F.col("s") >= similarity).select(*pairs.columns)


def _agreeing(left, right):
    """How many of the sketches' four-bit pieces are equal."""
    differ = F.lit(0)
    for a, b in zip(left, right, strict=True):
        x = F.col(a).bitwiseXOR(F.col(b))
        y = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        y = y.bitwiseOR(F.shiftrightunsigned(y, 2))
        differ = differ + F.bit_count(y.bitwiseAND(F.lit(0x1111111111111111)))
    return BANDS * ROWS - differ


# ------------------------------------------------------------------ families


def _elements(texts: pa.Array, frequent) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, element, weight): a shingle that stands n times in a text is n elements of its idf."""
    rows, codes, weight = [np.zeros(0, np.int64)], [np.zeros(0, _U)], [np.zeros(0)]
    for lo, _, h, at in pieces(texts):
        row, own, tf = _distinct(*shingles(h, at, SHINGLE_WORDS))
        nth = np.arange(tf.sum()) - np.repeat(np.cumsum(tf) - tf, tf)
        rows.append(np.repeat(row + lo, tf))
        codes.append(mix(np.repeat(own, tf) + nth.astype(_U) * _SALTS[2]))
        weight.append(np.repeat(weights(own, np.ones(len(own)), frequent), tf))
    return np.concatenate(rows), np.concatenate(codes), np.concatenate(weight)


def _centre(frequent):
    def run(t: pa.Table) -> pa.Table:
        _, code, w = _elements(pa.concat_arrays(t["text"].chunks), frequent)
        code, first, n = np.unique(code, return_index=True, return_counts=True)
        most = 2 * n > len(t)
        return pa.table({"b": t["b"][:1], "core": pa.array([code[most].view(np.int64)], pa.list_(pa.int64())),
                         "core_w": pa.array([w[first[most]]], pa.list_(pa.float64()))})
    return run


_DIFFERENCES = T.StructType([T.StructField("delta", T.DoubleType()), T.StructField("items", T.ArrayType(T.StructType([
    T.StructField("e", T.LongType()), T.StructField("w", T.DoubleType())])))])


def differences(frequent):
    """What a text has beyond a centre or lacks of it: total weight, elements."""
    @F.arrow_udf(_DIFFERENCES)
    def differ(texts: pa.Array, core: pa.Array, core_w: pa.Array) -> pa.Array:
        row, code, w = _elements(texts, frequent)
        row = np.concatenate([row, np.repeat(np.arange(len(texts)), pc.list_value_length(core).to_numpy(zero_copy_only=False))])
        code = np.concatenate([code, core.flatten().to_numpy(zero_copy_only=False).view(_U)])
        w = np.concatenate([w, core_w.flatten().to_numpy(zero_copy_only=False)])
        o = np.lexsort((code, row))
        row, code, w = row[o], code[o], w[o]
        same = (code[1:] == code[:-1]) & (row[1:] == row[:-1])
        one = ~(np.append(same, False) | np.append(False, same)) if len(row) else np.zeros(0, bool)
        row, code, w = row[one], code[one], w[one]
        items = pa.StructArray.from_arrays([pa.array(code.view(np.int64)), pa.array(w)], ["e", "w"])
        cuts = pa.array(np.searchsorted(row, np.arange(len(texts) + 1)), pa.int32())
        return pa.StructArray.from_arrays([pa.array(np.bincount(row, w, len(texts))), pa.ListArray.from_arrays(cuts, items)], ["delta", "items"])
    return differ


def _family_pairs(rows: DataFrame, heads: DataFrame, texts: DataFrame, frequent, similarity: float) -> tuple[DataFrame, DataFrame]:
    """rows: key, id, weight, c of crowded buckets; heads: key, head. Pairs (a, b) that hold a link of every two members of
    a family that are similar, in different components and not linked through its middle; and (head, id) that need no other pair."""
    spark = rows.sparkSession
    far_apart = (1 - similarity) / (1 + similarity)
    member = cut_lineage(rows.join(heads, "key").select("head", "id", "weight", "c").distinct())
    some = member.groupBy("head", F.pmod(F.xxhash64("id"), F.lit(SAMPLE))).agg(F.max("id").alias("id"))
    with small_batches(spark, 200):
        cores = cut_lineage(some.join(texts, "id").select(F.col("head").alias("b"), "text").groupBy("b")
                            .applyInArrow(_centre(frequent), "b bigint, core array<bigint>, core_w array<double>")
                            .withColumnRenamed("b", "head"))
        reach = F.aggregate("core_w", F.lit(0.0), lambda t, w: t + w)
        seen = cut_lineage(member.join(texts, "id").join(cores, "head")
                           .select("head", "id", "weight", "c", reach.alias("reach"), differences(frequent)("text", "core", "core_w").alias("s"))
                           .select("head", "id", "weight", "c", "reach", "s.delta", (F.col("s.delta") - F.col("weight") * far_apart).alias("g"), "s.items")
                           .filter("delta <= reach"))
    settled = seen.filter(F.col("delta") + F.col("weight") * (1 / similarity - 1) <= F.col("reach") - 1e-6).select("head", "id")
    middle = seen.groupBy("head").agg(F.min(F.struct("g", "id", "c")).alias("m"))
    seen = seen.join(middle, "head").withColumn("far", F.col("g") + F.col("m.g") > -1e-6)
    near = seen.filter(~F.col("far") & (F.col("c") != F.col("m.c"))).select(F.col("id").alias("a"), F.col("m.id").alias("b"), "c", F.col("m.c").alias("bc"))
    items = seen.select("head", "id", "c", "g", "far", F.explode("items").alias("i")).select("head", "id", "c", "g", "far", "i.e", "i.w")
    often = items.groupBy("head", "e").agg(F.count(F.lit(1)).alias("n"), F.min("g").alias("least"),
                                           F.min(F.when(F.col("far"), F.col("g"))).alias("least_far")).filter("n > 1 AND least_far IS NOT NULL")
    order = Window.partitionBy("head", "id").orderBy("n", "e").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # elements that nobody shares, or nobody far, are in no overlap that counts
    spare = F.col("rest") * 2 - F.col("g") + 1e-6  # the largest g this member meets by the rest of its elements
    shared = cut_lineage(items.join(often, ["head", "e"]).withColumn("rest", F.sum("w").over(order)).withColumn("spare", spare)
                         .filter(F.when(F.col("far"), F.col("spare") >= F.col("least")).otherwise(F.col("spare") >= F.col("least_far")))
                         .select("head", "e", "id", "c", "g", "far", "spare"))
    other = shared.select("head", "e", *[F.col(k).alias(f"o_{k}") for k in ("id", "c", "g", "far", "spare")])
    met = shared.filter("far").join(other, ["head", "e"]).filter(
        (F.col("c") != F.col("o_c")) & (F.col("o_g") <= F.col("spare")) & (F.col("g") <= F.col("o_spare")) & (~F.col("o_far") | (F.col("id") > F.col("o_id"))))
    return near.unionByName(met.select(F.col("id").alias("a"), F.col("o_id").alias("b"), "c", F.col("o_c").alias("bc"))).distinct(), settled


def _families(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """rows: key, id of buckets; heads: key, n, bscore, b of each. (key, head) of every bucket that holds a member of a crowded one: its
    members' best head, so that buckets which share members are one family, most of the time, and a member is compared with one centre."""
    crowd = rows.join(heads.filter(F.col("n") > CROWD).select("key", F.struct("bscore", "b").alias("h")), "key")
    best = cut_lineage(crowd.groupBy("id").agg(F.max("h").alias("h")))
    return rows.join(best, "id").groupBy("key").agg(F.max("h").alias("h")).select("key", F.col("h.b").alias("head"))


def link_components(nodes: DataFrame, docs: DataFrame, frequent, similarity: float = SIMILARITY) -> DataFrame:
    """nodes: id, text_key, weight, sketch, bands of each distinct text. (id, c) of every node with a link."""
    spark = nodes.sparkSession
    rows = nodes.select("id", "weight", *[F.get("sketch", i).alias(c) for i, c in enumerate(_SKETCH)], F.explode("bands").alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    rows = cut_lineage(rows.join(sizes, "key"))
    score = rows.groupBy("id").agg(F.sum("size").alias("score"))
    live = cut_lineage(rows.drop("size").join(score, "id").withColumn("c", F.col("id")))
    shared = score.select("id").join(nodes.select("id", "text_key"), "id")
    texts = cut_lineage(docs.select(text_key().alias("text_key"), whole_text().alias("text"))
                        .join(shared, "text_key").dropDuplicates(["id"]).select("id", "text"))
    mate = [F.col("id").alias("b"), F.col("score").alias("bscore"), F.col("weight").alias("bw"), F.col("c").alias("bc"),
            *[F.col(c).alias(f"b{c}") for c in _SKETCH]]
    hub = F.max(F.struct("score", "id", "weight", "c", *_SKETCH)).alias("h")
    may = (F.col("c") != F.col("bc")) & (F.least("weight", "bw") >= F.greatest("weight", "bw") * (similarity - 1e-9)) \
        & (_agreeing(_SKETCH, [f"b{c}" for c in _SKETCH]) >= AGREE)
    done = spark.createDataFrame([], "a bigint, b bigint")
    comps = spark.createDataFrame([], "id bigint, c bigint")
    first, pivots, crowds, places = True, PIVOTS, None, 0

    def linked(pairs: DataFrame) -> DataFrame | None:
        """New components of the old ones: n, c. None if no pair is a link."""
        if pairs.isEmpty():
            return None
        with small_batches(spark, 200):  # two texts to a row
            found = cut_lineage(_links(pairs, texts, frequent, similarity))
        return None if found.isEmpty() else cut_lineage(connected_components(found.select(F.col("c").alias("a"), F.col("bc").alias("b"))))

    def renamed(rows: DataFrame, roots: DataFrame) -> DataFrame:
        return rows.join(roots.withColumnsRenamed({"c": "root", "n": "c"}), "c", "left").withColumn("c", F.coalesce("root", "c")).drop("root")

    while True:
        # buckets that lie in one component have nothing left to compare
        heads = cut_lineage(live.groupBy("key").agg(F.count(F.lit(1)).alias("n"), hub, F.min("c").alias("lo"), F.max("c").alias("hi"))
                            .filter("lo <> hi").select("key", "n", "h.*").select("key", "n", *mate))
        n = F.col("n")
        held, meetings, crowded = heads.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in (n, n * (n - 1) / 2, F.when(n > CROWD, n))]).first()
        if not held:
            break
        places = places or held
        if first:  # the best pivot of each node
            first = False
            met = live.join(heads, "key").filter(may).groupBy("id", "c").agg(F.max(F.struct("bscore", "b", "bc")).alias("best"))
            pairs = met.select(F.col("id").alias("a"), "best.b", "c", "best.bc")
            rest = live.join(heads.select("key"), "key", "left_semi")
        else:
            sized = live.join(heads.select("key", "n"), "key")
            small, rest, more = sized, None, None
            if meetings <= places:  # fewer than the nodes had places in buckets: all at once
                pass
            elif crowded and (crowds is None or crowded <= crowds * 0.75):  # families are worth it while they settle most
                crowds = crowded
                families = cut_lineage(_families(sized, heads))
                more, settled = _family_pairs(live, families, texts, frequent, similarity)
                rest = live.join(families, "key").join(cut_lineage(settled), ["head", "id"], "left_anti").drop("head")
                small = live.join(heads.select("key"), "key", "left_semi").join(families, "key", "left_anti")
            elif crowded:
                big, small = sized.filter(F.col("n") > CROWD).drop("n"), sized.filter(F.col("n") <= CROWD)
                hubs = cut_lineage(big.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(pivots))).groupBy("key", "salt").agg(hub)
                                   .select("key", "h.*").select("key", *mate))
                more = big.join(hubs, "key").filter(may).select(F.col("id").alias("a"), "b", "c", "bc")
                rest = big.join(hubs.select("key", F.col("b").alias("id")), ["key", "id"], "left_anti")  # these have met all of their buckets
                pivots *= PIVOTS
            pairs = small.join(small.select("key", *mate), "key").filter((F.col("id") > F.col("b")) & may) \
                .select(F.col("id").alias("a"), "b", "c", "bc")
            pairs = pairs.unionByName(more) if more is not None else pairs
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.when(F.col("a") > F.col("b"), F.col("c")).otherwise(F.col("bc")).alias("c"),
                             F.when(F.col("a") > F.col("b"), F.col("bc")).otherwise(F.col("c")).alias("bc")).distinct()
        pairs = cut_lineage(pairs.join(done, ["a", "b"], "left_anti"))
        done = done.unionByName(pairs.select("a", "b"))
        roots = linked(pairs)
        if roots is not None:
            comps = cut_lineage(renamed(comps, roots).select("id", "c").unionByName(
                roots.withColumnRenamed("n", "id").join(comps.select("id"), "id", "left_anti").select("id", "c")))
        if rest is None:
            break
        live = cut_lineage(rest if roots is None else renamed(rest, roots))
    return comps


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document row: doc_id, text_key, class_id, kept."""
    frequent = frequent_shingles(docs)
    signed = docs.select("doc_id", text_key().alias("text_key"), signer(frequent)(whole_text()).alias("s"))
    with small_batches(docs.sparkSession):
        rows = cut_lineage(signed.select("doc_id", "text_key", "s.weight", "s.sketch", "s.bands"))
    # the written id stays the same in every later pass
    nodes = cut_lineage(rows.groupBy("text_key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("least"),
        F.max("weight").alias("weight"), F.max("sketch").alias("sketch"), F.max("bands").alias("bands"))
        .withColumn("id", F.monotonically_increasing_id()))
    comps = link_components(nodes, docs, frequent, similarity)
    named = cut_lineage(nodes.select("id", "text_key", "least").join(comps, "id", "left").withColumn("c", F.coalesce("c", "id")))
    firsts = named.groupBy("c").agg(F.min("least").alias("first"))
    of_text = named.join(firsts, "c").select("text_key", "first")
    out = rows.select("doc_id", "text_key").join(of_text, "text_key")
    return out.select("doc_id", "text_key", F.col("first.doc_id").alias("class_id"),
                      (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))).alias("kept"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One document row of every class, every column kept."""
    first = cut_lineage(classes(docs).filter("kept").select("doc_id", "text_key").distinct())
    return keep_rows(docs, first, once=True)
