"""Hard-negative mining by slot-decomposed selection.

Rows are embeddings made whole numbers (``SCALE`` times a component, rounded down), scores their inner products with an
anchor. An anchor's positives are its ``POSITIVES`` best other rows of the same label. For each positive the hardest
``NEGATIVES`` rows of other labels are wanted whose score is at most the positive's and at least ``LEAST`` percent of it. These
windows overlap; an anchor's positive scores, as upper limits, cut the scores into disjoint slots (slot i: scores
at most positive i's and above the next one's).

1. Rows are dealt into chunks of about ``CHUNK`` rows, anchors into blocks of about ``BLOCK``; every anchor block meets every
   chunk (the stated queries against all rows, in blocks) in a matrix product of its own.
2. First pass: each pair of a block and a chunk keeps the best ``POSITIVES`` rows of the anchor's label; a window over
   what the chunks kept names the anchor's positives.
3. Second pass: the scores of other-label rows fall into the anchor's slots, and the best ``NEGATIVES`` of each slot are kept,
   so at most 25 rows leave a chunk for an anchor, however large the corpus. A window cuts what the chunks
   kept to the best of each slot.
4. From the lowest slot to the highest, the best of the slots so far are merged (suffix merge): after slot i they are the best
   rows with at most positive i's score, from which those below its lower limit are dropped.

Order: higher scores first, ties by smaller vec_id. Rows with a null vec_id, label or vector, or with a null or
non-finite component take no part; the shorter of two vectors counts as padded with zeros. Rows that repeat a vec_id are rows of
their own. Scores are exact: products run in doubles where no sum can reach 2 ** 53, else in Python's integers; a score beyond
64 bits counts as the nearest 64-bit number. Only ``vec_id``, ``embedding`` and ``label`` are read. An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatgrid.session import cut_lineage

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
LEAST = 80  # percent of the positive's score
CHUNK = 16_384
BLOCK = 4_096
TILE = 2_000_000  # scores a task holds at a time
_LONG = np.iinfo(np.int64)


def usable(rows: DataFrame) -> DataFrame:
    """uid (the same in every later pass), vec_id, label (bigint) and v (array of doubles) of the rows that take part."""
    v = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    named = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), v.alias("v"))
    return cut_lineage(named.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & fine)
                       .withColumn("uid", F.monotonically_increasing_id()))


# ------------------------------------------------------------------ packs

_PACK = "pack int, n int, uids binary, ids binary, labels binary, width int, cells binary, limits binary"


def _pack(t: pa.Table) -> pa.Table:
    """One row for all rows of a pack, by vec_id; cells as int16, int32 or double, whichever holds them all."""
    t = t.sort_by([("vec_id", "ascending"), ("uid", "ascending")]).combine_chunks()

    def matrix(name: str, pad: float, kind):
        lists = t[name].combine_chunks()
        n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        out = np.full((len(n), int(n.max(initial=0))), pad, kind)
        out[np.arange(out.shape[1])[None, :] < n[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        return out

    cells = np.floor(np.clip(matrix("v", 0.0, np.float64) * SCALE, -1e300, 1e300))
    top = np.abs(cells).max(initial=0)
    kind = np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.float64
    limits = np.full((t.num_rows, POSITIVES), _LONG.min)
    own = matrix("limits", _LONG.min, np.int64)
    if own.shape[1] > POSITIVES:
        limits = own
    else:
        limits[:, :own.shape[1]] = own
    whole = lambda name: t[name].to_numpy().astype(np.int64).tobytes()
    return pa.Table.from_pylist([{
        "pack": t["pack"][0].as_py(), "n": t.num_rows, "uids": whole("uid"), "ids": whole("vec_id"), "labels": whole("label"),
        "width": cells.shape[1], "cells": cells.astype(kind).tobytes(), "limits": limits.tobytes()}],
        pa.schema([("pack", pa.int32()), ("n", pa.int32()), ("uids", pa.binary()), ("ids", pa.binary()), ("labels", pa.binary()),
                   ("width", pa.int32()), ("cells", pa.binary()), ("limits", pa.binary())]))


def packs(rows: DataFrame, number: int) -> DataFrame:
    """rows (uid, vec_id, label, v, limits) dealt into ``number`` packs, one row each."""
    dealt = rows.withColumn("pack", F.pmod(F.xxhash64("uid"), F.lit(number)).cast("int"))
    return cut_lineage(dealt.groupBy("pack").applyInArrow(_pack, _PACK))


class _Pack:
    def __init__(self, r: dict):
        n, w = r["n"], r["width"]
        kind = {2: np.int16, 4: np.int32, 8: np.float64}[len(r["cells"]) // (n * w)] if n * w else np.int16
        self.uids, self.ids, self.labels = (np.frombuffer(r[c], np.int64) for c in ("uids", "ids", "labels"))
        self.cells = np.frombuffer(r["cells"], kind).reshape(n, w).astype(np.float64)
        self.limits = np.frombuffer(r["limits"], np.int64).reshape(n, -1)  # from above; padded with the least number


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products, as far as 64 bits reach."""
    w = min(a.shape[1], b.shape[1])
    a, b = a[:, :w], b[:, :w]
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, w) < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(b).T, _LONG.min, _LONG.max).astype(np.int64)


def _tiles(anchors: _Pack, rows: _Pack):
    step = max(1, TILE // max(1, len(anchors.ids)))
    for a in range(0, len(rows.ids), step):
        s = slice(a, min(a + step, len(rows.ids)))
        yield s, _scores(anchors.cells, rows.cells[s])


def _first(kept: list, new: tuple, k: int) -> list:
    """The first k of each group, by score from above, then by place: columns (group, score, place, ...)."""
    cols = [np.concatenate([a, b]) for a, b in zip(kept, new, strict=True)] if kept else list(new)
    o = np.lexsort((cols[2], ~cols[1], cols[0]))
    g = cols[0][o]
    start = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return [c[o[rank < k]] for c in cols]


_POSITIVE = "anchor bigint, anchor_id bigint, score bigint, id bigint, uid bigint"
_NEGATIVE = "anchor bigint, slot int, score bigint, id bigint"


def _positives(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.schema([(c, pa.int64()) for c in ("anchor", "anchor_id", "score", "id", "uid")])
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        anchors, rows = (_Pack(t.to_pylist()[0]) for t in (left, right))
        kept: list = []
        worst = np.full(len(anchors.ids), _LONG.min)  # rows of a chunk come by vec_id: a later tie is no better
        full = np.zeros(len(worst), bool)
        for s, score in _tiles(anchors, rows):
            may = (anchors.labels[:, None] == rows.labels[None, s]) & (anchors.uids[:, None] != rows.uids[None, s]) \
                & (~full[:, None] | (score > worst[:, None]))
            i, j = np.nonzero(may)
            kept = _first(kept, (i, score[i, j], j + s.start), k)
            full = np.bincount(kept[0], minlength=len(worst)) >= k
            worst = np.full(len(worst), _LONG.max)
            np.minimum.at(worst, kept[0], kept[1])
        i, score, j = kept
        return pa.table([anchors.uids[i], anchors.ids[i], score, rows.ids[j], rows.uids[j]], schema=out)
    return run


def lower_limit(score: np.ndarray, percent: int) -> np.ndarray:
    """Least whole score of at least ``percent`` hundredths of a score, without leaving 64 bits."""
    q, r = np.divmod(score, 100)
    return q * percent - (-(r * percent) // 100)


def _negatives(k: int, percent: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        anchors, rows = (_Pack(t.to_pylist()[0]) for t in (left, right))
        top, m = anchors.limits, anchors.limits.shape[1]
        real = top > _LONG.min
        low = np.where(real, lower_limit(top, percent), _LONG.max).min(axis=1)  # nothing below it is in any window
        kept: list = []
        for s, score in _tiles(anchors, rows):
            may = (score <= top[:, :1]) & (score >= low[:, None]) & (anchors.labels[:, None] != rows.labels[None, s])
            i, j = np.nonzero(may)
            v = score[i, j]
            slot = (real[i] & (top[i] >= v[:, None])).sum(axis=1)  # positives whose limit is not below the score
            kept = _first(kept, (i * (m + 1) + slot, v, j + s.start), k)
        group, score, j = kept
        return pa.table([anchors.uids[group // (m + 1)], (group % (m + 1)).astype(np.int32), score, rows.ids[j]], schema=out)
    return run


def _meet(blocks: DataFrame, chunks: DataFrame, n_blocks: int, n_chunks: int, run, schema: str) -> DataFrame:
    """Every anchor block with every chunk of rows, one pair to a group."""
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = blocks.withColumnRenamed("pack", "block").withColumn("chunk", each(n_chunks))
    right = chunks.withColumnRenamed("pack", "chunk").withColumn("block", each(n_blocks))
    return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(run, schema)


def mine(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST,
         chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of ``rows`` (vec_id, label,
    embedding) that meet the condition ``anchors``."""
    none = F.array().cast("array<bigint>").alias("limits")
    base = usable(rows)
    asked = base.filter(anchors)
    n, n_asked = base.count(), asked.count()
    n_chunks, n_blocks = max(1, -(-n // chunk)), max(1, -(-n_asked // block))
    chunks = packs(base.select("*", none), n_chunks)
    near = _meet(packs(asked.select("*", none), n_blocks), chunks, n_blocks, n_chunks, _positives(positives), _POSITIVE)
    by_anchor = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "id", "uid")
    best = near.withColumn("k", F.row_number().over(by_anchor)).filter(F.col("k") <= positives)
    of_anchor = cut_lineage(best.groupBy("anchor", "anchor_id").agg(
        F.array_sort(F.collect_list(F.struct("k", "id", "score"))).alias("ps")))
    limited = asked.join(of_anchor.select(F.col("anchor").alias("uid"), F.col("ps.score").alias("limits")), "uid")
    far = _meet(packs(limited.select("uid", "vec_id", "label", "v", "limits"), n_blocks), chunks, n_blocks, n_chunks,
                _negatives(negatives, least), _NEGATIVE)
    by_slot = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "id")
    slots = far.withColumn("r", F.row_number().over(by_slot)).filter(F.col("r") <= negatives)
    # at most positives * negatives to an anchor; ~score sorts from above
    found = slots.groupBy("anchor").agg(F.collect_list(F.struct(F.bitwise_not("score").alias("o"), "id", "slot")).alias("found"))
    both = of_anchor.join(found, "anchor")
    kind = "array<struct<o:bigint,id:bigint,slot:int>>"
    merged = F.aggregate(
        F.reverse("ps"), F.struct(F.array().cast(kind).alias("run"), F.array().cast(
            f"array<struct<pid:bigint,ps:bigint,top:{kind}>>").alias("out")),
        lambda acc, p: F.struct(
            _suffix(acc["run"], p, negatives).alias("run"),
            F.concat(acc["out"], F.array(F.struct(
                p["id"].alias("pid"), p["score"].alias("ps"),
                F.filter(_suffix(acc["run"], p, negatives), lambda x: F.bitwise_not(x["o"]) >= _low(p["score"], least)).alias("top")))).alias("out")),
        lambda acc: acc["out"])
    each = both.select("anchor_id", F.explode(merged).alias("w")).select("anchor_id", "w.pid", "w.ps", F.posexplode("w.top").alias("at", "x"))
    return each.select("anchor_id", F.col("pid").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"),
                       F.col("x.id").alias("negative_id"), F.col("ps").alias("positive_score"),
                       F.bitwise_not("x.o").alias("negative_score"))


def _suffix(run: Column, p: Column, k: int) -> Column:
    """The first k of the lower slots' best and the positive's own slot."""
    own = F.filter(F.col("found"), lambda x: x["slot"] == p["k"])
    return F.slice(F.array_sort(F.concat(run, own)), 1, k)


def _low(score: Column, percent: int) -> Column:
    """:func:`lower_limit` as a column."""
    r = F.pmod(score, F.lit(100).cast("bigint"))
    return F.call_function("div", score - r, F.lit(100)) * percent + F.ceil(r * percent / 100)


def contract_rows(rows: DataFrame) -> DataFrame:
    """The embeddings with the labels moved on where vec_id is divisible by 7."""
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return rows.select("vec_id", moved.alias("label"), "embedding")


ORACLE = """
WITH e AS (SELECT row_number() OVER () AS u, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.u, a.vec_id AS anchor_id, b.vec_id AS id, b.u AS other, a.label = b.label AS same,
             CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM e a JOIN e b ON a.u <> b.u WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, id, other) AS k FROM s WHERE same QUALIFY k <= 5),
w AS (SELECT p.u, p.k, p.anchor_id, p.id AS positive_id, p.score AS positive_score, n.id AS negative_id, n.score AS negative_score,
             row_number() OVER (PARTITION BY p.u, p.k ORDER BY n.score DESC, n.id, n.other) AS r
      FROM p JOIN s n ON n.u = p.u AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM w WHERE r <= 5"""
