"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its distinct words (value 1), word pairs and pairs with one word skipped (value ``PAIR``), hashed to the two
halves of ``2 ** BITS`` coordinates, and a bias. Weights are learnt online: each coordinate has its own learning rate, falling with its own past gradients,
and L1 keeps a weight at exactly 0 until its gradients add up, so the model is a short list of (coordinate,
weight), cheap to send to every task.

Fitting takes at most ``TRAIN_ROWS`` labelled rows (labels with the smallest seeded hash of doc_id, and where their
doc_ids repeat, rows with the smallest seeded hash: a fixed random sample, a documented bound), read by one task in ``EPOCHS`` passes. Scoring covers every row.

Only the texts enter a score. Null texts are empty and score by the bias. Rows with a null label or id are not
learnt from; if there is no labelled row, every score is ``NO_MODEL``. Repeated rows count each time. Only ``doc_id`` and ``text`` are
read of the documents, ``doc_id`` and the label of the labels.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatgrid.llm.common import whole_text
from seatgrid.llm.hashing import pieces, runs
from seatgrid.session import cut_lineage

BITS = 20
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 0.0
PAIR = 0.3
EPOCHS = 5
TRAIN_ROWS = 20_000
SEED = 11
NO_MODEL = 0.0
BIAS = 1 << BITS
_HALF = 1 << (BITS - 1)


def fold(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5


def held_out(doc_id: Column) -> Column:
    """The fold that labels are never learnt from: crc32 of the id as text, modulo 5, is 0 (a null id is in none)."""
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def features(texts: pa.Array):
    """(from, to, rows, coordinates): the coordinates of each text's runs, not yet distinct; rows from 0 at ``from``."""
    for a, b, h, at in pieces(texts):
        parts = [runs(h, at, steps, 1 + k) for k, steps in enumerate(((), (1,), (2,)))]
        rows = np.concatenate([np.repeat(np.arange(b - a), np.diff(cuts)) for _, cuts in parts])
        x = np.concatenate([(p >> np.uint64(65 - BITS)).astype(np.int64) + (_HALF if k else 0) for k, (p, _) in enumerate(parts)])
        yield a, b, rows, x


def ftrl(examples: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """examples: (distinct coordinates, label), in learning order. Gives the coordinates that aren't 0 and what
    each adds to a sum (weight times value)."""
    z, n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)
    value = np.ones(BIAS + 1)
    value[_HALF:BIAS] = PAIR

    def weights(i):
        zi = z[i]
        return -np.sign(zi) * np.maximum(np.abs(zi) - L1, 0) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)

    for _ in range(epochs):
        for i, y in examples:
            w, v, ni = weights(i), value[i], n[i]
            g = (1 / (1 + np.exp(-np.clip(w @ v, -35, 35))) - y) * v
            z[i] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[i] = ni + g * g
    w = weights(np.arange(BIAS + 1)) * value
    at = np.flatnonzero(w)
    return at, w[at]


_WEIGHTS = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("w", T.DoubleType())])


def _learn(t: pa.Table) -> pa.Table:
    t = t.sort_by([(c, "ascending") for c in ("_mix", "doc_id", "label", "text")])
    labels, examples = t["label"].to_pylist(), []
    for a, b, rows, x in features(t["text"].combine_chunks()):
        keys = np.unique(rows << (BITS + 1) | x)
        cuts = np.searchsorted(keys >> (BITS + 1), np.arange(b - a + 1))
        keys &= 2 * BIAS - 1
        examples += [(np.append(keys[cuts[k]:cuts[k + 1]], BIAS).astype(np.int32), labels[a + k]) for k in range(b - a)]
    at, w = ftrl(examples)
    return pa.table({"at": at.astype(np.int32), "w": w})


def bounded(rows: DataFrame, most_rows: int) -> DataFrame:
    """At most ``most_rows`` of the rows, those with the least seeded hash; each copy of a repeated row has one of its
    own, so that a doc_id on many rows takes its share of the bound and not the place of all others."""
    copies = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least("_n", F.lit(most_rows).cast("bigint")))))
    return copies.orderBy(F.xxhash64(F.lit(SEED), *rows.columns, "_copy"), *rows.columns, "_copy").limit(most_rows).select(*rows.columns)


def fit(docs: DataFrame, labels: DataFrame, label: str, most_rows: int = TRAIN_ROWS) -> list[tuple[int, float]]:
    """The sparse weights, learnt from labelled rows outside the held-out fold; empty without any."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))) \
        .select("doc_id", F.col(label).cast("int").alias("label"), F.xxhash64(F.lit(SEED), "doc_id").alias("_mix"))
    chosen = cut_lineage(known.orderBy("_mix", "doc_id", "label").limit(most_rows))  # the documented bound
    rows = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")
    learnt = bounded(rows, most_rows).groupBy(F.lit(0).alias("g")).applyInArrow(_learn, _WEIGHTS)
    return [(r["at"], r["w"]) for r in learnt.collect()]  # at most 2 ** BITS + 1 weights, most of them 0 and left out


def scorer(model: list[tuple[int, float]]) -> Callable:
    at = np.array([a for a, _ in model], np.int32)
    w = np.array([x for _, x in model], np.float64)
    dense: list[np.ndarray] = []  # filled once in each worker

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        if not len(at):
            return pa.array(np.full(len(texts), NO_MODEL))
        if not dense:
            dense.append(np.zeros(BIAS + 1))
            dense[0][at] = w
        out = np.empty(len(texts))
        for a, b, rows, x in features(texts):
            hit = dense[0][x] != 0
            keys = np.unique(rows[hit] << (BITS + 1) | x[hit])
            sums = np.bincount(keys >> (BITS + 1), dense[0][keys & (2 * BIAS - 1)], b - a) + dense[0][BIAS]
            out[a:b] = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
        return pa.array(out)

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every document row."""
    score = scorer(fit(docs, labels, label))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(whole_text()).alias("score")) \
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
