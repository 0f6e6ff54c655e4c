"""Classifiers: held-out accuracy, an exact learner and odd rows."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa

from seatgrid.llm import quality_classifier, toxicity

from . import data

BAD = ["trashword", "scumword", "clownword", "moronword", "loserword"]


def labelled(seed=1, n=1500):
    rng = random.Random(seed)
    rows, labels = list(data.documents(10)), []
    for i in range(n):
        text, toxic, quality = data.sentence(rng, rng.randint(20, 80)), int(rng.random() < 0.3), int(rng.random() < 0.7)
        w = text.split()
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        if not quality:
            w = [x + rng.choice(["###", "$$$", "%%%"]) for x in w]
        rows.append((20_000 + i, " ".join(w), "en", "a", 0))
        labels.append((20_000 + i, quality, toxic))
    return rows, labels + [(None, 1, 1), (5, None, None), (20_001, 0, 0)]


LABELS = "doc_id bigint, quality int, toxic int"


def check(spark, score, label, threshold):
    rows, labels = labelled()
    truth = {d: (q, t)[label == "toxic"] for d, q, t in labels[:-3]}
    got = score(data.frame(spark, rows, extra=True), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows)
    right = total = 0
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= threshold)
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        assert r["held_out"] == held
        if held and r["doc_id"] in truth:
            total += 1
            right += r["predicted"] == truth[r["doc_id"]]
    assert total > 200 and right / total > 0.95
    none = score(data.frame(spark), spark.createDataFrame([], LABELS)).collect()
    assert len(none) == len(data.documents()) and len({r["score"] for r in none}) == 1
    assert score(data.empty(spark), spark.createDataFrame(labels, LABELS)).count() == 0


def test_quality_held_out(spark):
    check(spark, quality_classifier.score_quality, "quality", 0.3)


def test_toxicity_held_out(spark):
    check(spark, toxicity.score_toxicity, "toxic", 0.5)


def test_one_class_only(spark):
    rows, labels = labelled(2, 60)
    good = [(d, 1, 0) for d, *_ in labels[:-3]]
    got = quality_classifier.score_quality(data.frame(spark, rows), spark.createDataFrame(good, LABELS)).collect()
    assert {r["score"] for r in got} == {1.0}


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    rows, labels = labelled(3, 400)
    flipped = [(d, 1 - q, 1 - t) if d and zlib.crc32(str(d).encode()) % 5 == 0 else (d, q, t) for d, q, t in labels[:-3]]
    for score in (quality_classifier.score_quality, toxicity.score_toxicity):
        a, b = (data.rows_of(score(data.frame(spark, rows), spark.createDataFrame(x, LABELS))) for x in (labels[:-3], flipped))
        assert a == b


def _seen_toxic(t):
    ids = t["doc_id"].to_pylist()
    return pa.table({"at": pa.array(ids, pa.int32()), "w": pa.array([1.0] * len(ids))})


def _seen_quality(t):
    ids = [float(i) for i in t["doc_id"].to_pylist()]
    return pa.Table.from_pylist([{"good": b"", "bad": b"", "x": ids, "y": ids}], pa.schema([
        ("good", pa.binary()), ("bad", pa.binary()), ("x", pa.list_(pa.float64())), ("y", pa.list_(pa.float64()))]))


def test_bound_holds_for_rows_of_a_repeated_id(spark, monkeypatch):
    """A labelled doc_id on a third of the rows, half of them copies, goes into the fit within the row bound, and so do others."""
    monkeypatch.setattr(toxicity, "_learn", _seen_toxic)
    monkeypatch.setattr(quality_classifier, "_learn", _seen_quality)
    learn = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5][:100]
    rows = [(i, f"text {i}", "en", "a", 0) for i in learn]
    hot = rows + [(learn[0], f"text {k if k % 2 else 0}", "en", "a", 0) for k in range(50)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in learn], LABELS)
    for table, most in ((rows, 100), (hot, 100), (hot, 1000)):
        toxic = [a for a, _ in toxicity.fit(data.frame(spark, table), labels, "toxic", most)]
        quality = [int(x) for x in quality_classifier.fit(data.frame(spark, table), labels, "quality", most)["x"]]
        for ids in (toxic, quality):
            assert len(ids) == min(len(table), most)
            assert len(set(ids)) >= 50 and (len(table) > most or sorted(ids) == sorted(r[0] for r in table))


def test_ftrl_step_by_step():
    """The learner against the plain per-coordinate formula."""
    rng = random.Random(6)
    examples = [(np.array(sorted(rng.sample(range(30), 8)) + [toxicity._HALF + rng.randrange(9), toxicity.BIAS]), rng.randint(0, 1)) for _ in range(120)]
    z, n = {}, {}

    def w(i):
        zi = z.get(i, 0.0)
        if abs(zi) <= toxicity.L1:
            return 0.0
        return -(zi - math.copysign(toxicity.L1, zi)) / ((toxicity.BETA + math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(2):
        for xs, y in examples:
            v = {i: toxicity.PAIR if toxicity._HALF <= i < toxicity.BIAS else 1.0 for i in xs.tolist()}
            p = 1 / (1 + math.exp(-sum(w(i) * v[i] for i in v)))
            for i, g in [(i, (p - y) * v[i]) for i in v]:
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / toxicity.ALPHA * w(i)
                n[i] = old + g * g
    at, got = toxicity.ftrl(examples, 2)
    want = {i: w(i) * (toxicity.PAIR if toxicity._HALF <= i < toxicity.BIAS else 1.0) for i in z if w(i)}
    assert want and set(at.tolist()) == set(want)
    assert all(math.isclose(g, want[i], rel_tol=1e-9) for i, g in zip(at.tolist(), got, strict=True))


def test_isotonic_is_the_least_squares_monotone_fit():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 12, 60).astype(float)
    y = (rng.random(60) < x / 12).astype(float)
    kx, ky = quality_classifier.isotonic(x, y)
    fit = np.interp(x, kx, ky)
    assert np.all(np.diff(ky) >= 0)
    means = np.array([y[x == v].mean() for v in np.unique(x)])
    counts = np.array([(x == v).sum() for v in np.unique(x)])
    k = len(means)  # max-min formula
    best = [max(min((means[a:b + 1] * counts[a:b + 1]).sum() / counts[a:b + 1].sum() for b in range(i, k)) for a in range(i + 1)) for i in range(k)]
    assert np.allclose([fit[x == v][0] for v in np.unique(x)], best)
