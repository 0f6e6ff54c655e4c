"""Mixing and sharding against their laws, worked out in plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

from seatgrid.llm import mixing, sharding

from . import data

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=900):
    rng = random.Random(seed)
    rows = list(data.documents(30))
    for i in range(n):
        size = 0 if rng.random() < 0.02 else int(rng.lognormvariate(3.5, 0.9)) + 1
        src = rng.choices(["a", "b", "c", "é", "Z", None], [30, 5, 3, 1, 8, 2])[0]
        rows.append((10_000 + i, "w " * size, "en", src, 0))
    return rows


def wanted(rows):
    """The contract's targets, round by round."""
    size = Counter()
    for r in rows:
        size[r[3]] += len(SPACE.findall(r[1] or ""))
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    fixed = {}
    while True:
        free = [s for s in order if s not in fixed]
        left = sum(size.values()) - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            return size, fixed | share
        fixed |= {s: 3 * size[s] for s in over}


def test_targets_and_taken(spark):
    rows = corpus()
    got = mixing.mix_digest(data.frame(spark, rows, extra=True)).collect()
    size, target = wanted(rows)
    assert len(got) == len(rows)
    taken, longest = Counter(), Counter()
    for r in got:
        s = r["source"]
        assert r["source_size"] == size[s] and math.isclose(r["target"], target[s], rel_tol=1e-9)
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
        assert r["copies"] in (math.floor(r["rate"]), math.ceil(r["rate"]))
        taken[s] += r["taken"]
        longest[s] = max(longest[s], r["size"])
    for s in size:
        assert abs(taken[s] - target[s]) <= 2 * longest[s] + 1, s
    lam = defaultdict(set)  # one tilt for each source: log rate over size is a constant below the cap
    for r in got:
        if r["size"] > 20 and 0.01 < r["rate"] < 2.99:
            lam[r["source"]].add(round(math.log(r["rate"]) / r["size"], 4))
    assert all(max(v) - min(v) < 2e-3 for v in lam.values())


def test_mix_is_the_same_again(spark):
    docs = data.frame(spark, corpus(3, 300))
    again = docs.repartition(7)
    assert data.rows_of(mixing.mix_digest(docs)) == data.rows_of(mixing.mix_digest(again))


def test_mix_small_cases(spark):
    assert mixing.mix_digest(data.empty(spark)).count() == 0
    wordless = mixing.mix_digest(data.frame(spark, [(1, None, "en", "a", 0), (2, "", "en", None, 0)])).collect()
    assert [(r["target"], r["taken"]) for r in wordless] == [(0.0, 0), (0.0, 0)]
    one = mixing.mix_digest(data.frame(spark, [(i, "a b c", "en", "a", 0) for i in range(5)])).collect()
    assert all(r["copies"] == 1 and r["target"] == 15 for r in one)


def test_take_copies(spark):
    docs = data.frame(spark, corpus(5, 200), extra=True)
    mixed = mixing.take_copies(docs)
    assert mixed.columns == docs.columns
    digest = mixing.mix_digest(docs)
    want = Counter()
    for r in digest.collect():
        want[r["doc_id"], r["size"]] += r["copies"]
    got = Counter((r["doc_id"], len(SPACE.findall(r["text"] or ""))) for r in mixed.collect())
    assert got == Counter({k: v for k, v in want.items() if v})


def test_shards_follow_the_law(spark):
    rows = corpus(2, 1200)
    got = sharding.shard_documents(data.frame(spark, rows, extra=True)).collect()
    assert sorted(repr((r["doc_id"], r["size"], r["text_crc32"])) for r in got) == sorted(
        repr((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()))) for r in rows)
    shards = defaultdict(list)
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None
        shards[r["shard"]].append(r)
    counts = [len(v) for v in shards.values()]
    assert sorted(shards) == list(range(16)) and max(counts) - min(counts) <= 1
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in shards.values())
    total = Counter(r["source"] for r in got)
    for v in shards.values():  # every shard matches the mixture to about a row
        for s, n in Counter(r["source"] for r in v).items():
            assert abs(n - total[s] / 16) <= 2
    again = sharding.shard_documents(data.frame(spark, rows).repartition(5))
    assert data.rows_of(again) == sorted(tuple(repr(r[c]) for c in sorted(again.columns)) for r in got)


def test_fewer_rows_than_shards(spark):
    got = sharding.shard_documents(data.frame(spark, data.documents(5)[:5])).collect()
    assert sorted(Counter(r["shard"] for r in got).values()) == [1] * 5 and all(r["slot"] == 0 for r in got)
    assert sharding.shard_documents(data.empty(spark)).count() == 0


def test_rates_and_copies_match_plain_python(spark):
    """The dual solved by bisection, and rates rounded into copies along the same order, row by row."""
    from pyspark.sql import functions as F
    rows = corpus(6, 500) + [(None, "w " * 9, "en", "a", 0)] * 40 + [(None, "v " * 9, "en", "a", 0)] * 3
    docs = data.frame(spark, rows)
    mix = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64(F.lit(mixing.SEED), "doc_id")).distinct().collect()}
    _, target = wanted(rows)
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[3]].append((len(SPACE.findall(r[1] or "")), mix[r[0]], r[0]))
    want = []
    for source, items in by_source.items():
        words = sum(n for n, *_ in items)
        scale = max(sum(n * n for n, *_ in items) / max(words, 1), 1.0)
        rate = lambda lam, n: min(3.0, math.exp(min(700.0, lam * n / scale)))  # noqa: B023, E731
        least = min((n for n, *_ in items if n), default=1)
        lo, hi = -1e4, math.log(3) / (least / scale) * (1 + 1e-12)
        if target[source] >= 3 * words * (1 - mixing.TOLERANCE):
            lo = hi
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(n * rate(mid, n) for n, *_ in items) < target[source] else (lo, mid)
        before = 0
        for n, _, doc_id in sorted(items, key=lambda x: (x[0], x[1], x[2] is not None, x[2] or 0)):
            q = round(rate(hi, n) * mixing.UNIT) if words else mixing.UNIT
            half = mixing.UNIT // 2
            want.append((repr(doc_id), n, repr(source), q / mixing.UNIT, (before + q + half) // mixing.UNIT - (before + half) // mixing.UNIT))
            before += q
    got = [(repr(r["doc_id"]), r["size"], repr(r["source"]), r["rate"], r["copies"]) for r in mixing.mix_digest(docs).collect()]
    differ = 0
    for x, y in zip(sorted(got), sorted(want), strict=True):
        assert x[:3] == y[:3] and abs(x[3] - y[3]) <= 1e-5
        differ += x[4] != y[4]
    assert differ <= len(rows) // 100  # a rate's last bits may move a rounding place


def plain_shards(rows):
    """(doc_id, size, shard, slot) of every row by one sort."""
    by_source = defaultdict(list)
    for r in rows:
        raw = (r[1] or "").encode()
        mix = hashlib.md5(f"{sharding.SEED}:{'' if r[0] is None else r[0]}".encode()).hexdigest()
        by_source["0" if r[3] is None else "1" + r[3]].append((mix, r[0] is not None, r[0], zlib.crc32(raw), len(raw) + 1))
    line = []
    for source, items in by_source.items():
        items.sort(key=lambda x: (x[0], x[1], x[2] or 0, *x[3:]))
        line += [((2 * p + 1) / (2 * len(items)), source, *x[1:]) for p, x in enumerate(items)]
    line.sort(key=lambda x: (x[0], x[1], x[2], x[3] or 0, *x[4:]))
    n, out = len(line), []
    for p, x in enumerate(line):
        shard = p * 16 // n
        out.append(repr((x[3], x[5], shard, p - -(-shard * n // 16))))
    return sorted(out)


def test_shards_match_a_plain_sort(spark):
    rows = corpus(4, 700)
    got = sharding.shard_documents(data.frame(spark, rows)).collect()
    assert sorted(repr((r["doc_id"], r["size"], r["shard"], r["slot"])) for r in got) == plain_shards(rows)
