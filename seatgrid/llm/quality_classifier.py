"""Quality: a compression classifier.

Two zstandard dictionaries are trained, one from text labelled good, one from text labelled bad. Every text is cut into pieces of
``PIECE`` bytes (all of them, so the whole text counts) and each piece is compressed with either; the feature is
(size with the bad dictionary - size with the good one) / (bytes + ``DAMP``). Isotonic regression of the label on it, over
labelled rows that trained no dictionary, turns it into a calibrated score, read off by linear interpolation.

Fitting takes at most ``FIT_ROWS`` labelled rows (labels with the smallest seeded hash of doc_id, and where their
doc_ids repeat, rows with the smallest seeded hash: a fixed random sample, a documented bound) in one task: of the crc32 folds modulo 5, 1 to 3 train the dictionaries, 4 calibrates, 0 is held out. Scoring covers
every row.

Only the texts enter a score. Null texts are empty, with a feature of 0. Rows with a null label or id are not learnt from; without
text of both classes every score is the share of good labels, without labels ``NO_MODEL``. Repeated rows count each
time. Only ``doc_id`` and ``text`` are read of the documents, ``doc_id`` and the label of the labels.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatgrid.llm.common import whole_text
from seatgrid.llm.toxicity import bounded, fold, held_out
from seatgrid.session import cut_lineage

PIECE = 1024
DICTIONARY = 32_768
LEVEL = 3
DAMP = 16
FIT_ROWS = 10_000
SEED = 5
NO_MODEL = 0.5


def cut(text: str) -> list[bytes]:
    b = text.encode("utf-8", "replace")
    return [b[i:i + PIECE] for i in range(0, len(b), PIECE)]


def train(pieces: list[bytes]) -> bytes:
    """A trained dictionary, or the last text itself where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY:]


def compressor(data: bytes) -> Callable[[bytes], bytes]:
    d = zstandard.ZstdCompressionDict(data)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress


def feature(text: str, good: Callable, bad: Callable) -> float:
    n = diff = 0
    for piece in cut(text):
        diff += len(bad(piece)) - len(good(piece))
        n += len(piece)
    return diff / (n + DAMP)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float]]:
    """Knots of the non-decreasing least-squares fit (pool adjacent violators; equal x are one point)."""
    xs, at = np.unique(x, return_inverse=True)
    n, total = np.bincount(at), np.bincount(at, y)
    blocks: list[list[float]] = []  # sum, count, first x, last x
    for a, k, s in zip(xs, n, total, strict=True):
        blocks.append([s, k, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, k2, _, b2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + k2, blocks[-1][2], b2]
    kx, ky = [], []
    for s, k, a, b in blocks:
        kx += [float(a), float(b)] if b > a else [float(a)]
        ky += [float(s / k)] * (2 if b > a else 1)
    return kx, ky


_MODEL = T.StructType([T.StructField("good", T.BinaryType()), T.StructField("bad", T.BinaryType()),
                       T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("y", T.ArrayType(T.DoubleType()))])


def _learn(t: pa.Table) -> pa.Table:
    rows = sorted(t.to_pylist(), key=lambda r: (r["_mix"], r["doc_id"], r["label"], r["text"]))
    own = {y: [p for r in rows if r["label"] == y and r["_fold"] != 4 for p in cut(r["text"])] for y in (0, 1)}
    y = np.array([r["label"] for r in rows], float)
    if not own[0] or not own[1]:
        model = {"good": b"", "bad": b"", "x": [0.0], "y": [float(y.mean())]}
    else:
        good, bad = train(own[1]), train(own[0])
        rest = [r for r in rows if r["_fold"] == 4] or rows
        both = compressor(good), compressor(bad)
        kx, ky = isotonic(np.array([feature(r["text"], *both) for r in rest]), np.array([r["label"] for r in rest], float))
        model = {"good": good, "bad": bad, "x": kx, "y": ky}
    return pa.Table.from_pylist([model], pa.schema([("good", pa.binary()), ("bad", pa.binary()),
                                                    ("x", pa.list_(pa.float64())), ("y", pa.list_(pa.float64()))]))


def fit(docs: DataFrame, labels: DataFrame, label: str, most_rows: int = FIT_ROWS) -> dict | None:
    """Dictionaries and calibration knots, learnt from labelled rows outside the held-out fold; None without any."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))) \
        .select("doc_id", F.col(label).cast("int").alias("label"), fold(F.col("doc_id")).cast("int").alias("_fold"),
                F.xxhash64(F.lit(SEED), "doc_id").alias("_mix"))
    chosen = cut_lineage(known.orderBy("_mix", "doc_id", "label").limit(most_rows))  # the documented bound
    rows = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")
    learnt = bounded(rows, most_rows).groupBy(F.lit(0).alias("g")).applyInArrow(_learn, _MODEL).collect()  # one model row
    return learnt[0].asDict() if learnt else None


def scorer(model: dict | None) -> Callable:
    ready: list[Callable] = []  # filled once in each worker
    good, bad = (bytes(model["good"]), bytes(model["bad"])) if model else (b"", b"")
    kx, ky = (model["x"], model["y"]) if model else ([0.0], [NO_MODEL])

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        if not good or not bad:
            return pa.array(np.full(len(texts), ky[0]))
        if not ready:
            ready.extend((compressor(good), compressor(bad)))
        return pa.array(np.interp([feature(t.as_py() or "", *ready) for t in texts], kx, ky))

    return score


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document row."""
    score = scorer(fit(docs, labels, label))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(whole_text()).alias("score")) \
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
