"""Near-dedup, components and the pipeline against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

import corpus_pipeline
from seatgrid.llm import components, hashing, near_dedup

from . import data

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def bag(text):
    w = words(text)
    if 0 < len(w) < 5:
        return Counter([tuple(w)])
    return Counter(zip(w, w[1:], w[2:], w[3:], w[4:], strict=False))


TEXTS = ["", "One two", "a", "THE cat; sat on-the mat éÉ 漢字x", "x " * 300, "no\nlines\nat all\nhere ok", " lead and trail ", "\x7f\x01a\x1fb"]


def test_words_and_shingles_match_a_regex():
    seen = {}
    texts = [*TEXTS, *[r[1] or "" for r in data.documents()]]
    array = pa.array([None, *texts])
    got = 0
    for a, b, h, at in hashing.pieces(array.slice(1)):
        sh, cuts = hashing.shingles(h, at, 5)
        for i in range(a, b):
            w = words(texts[i])
            assert at[i - a + 1] - at[i - a] == len(w)
            for x, y in zip(w, h[at[i - a]:at[i - a + 1]].tolist(), strict=True):
                assert seen.setdefault(y, x) == x
            n = sum(bag(texts[i]).values())
            own = sh[cuts[i - a]:cuts[i - a + 1]]
            assert len(own) == n and len(set(own.tolist())) == len(bag(texts[i]))
            got += 1
    assert got == len(texts) and len(set(seen.values())) == len(seen)


def test_pieces_do_not_change_hashes(monkeypatch):
    texts = pa.array([r[1] for r in data.documents()])
    whole = [(h.tolist(), np.diff(at).tolist()) for _, _, h, at in hashing.pieces(texts)]
    monkeypatch.setattr(hashing, "PIECE", 100)
    parts = [(h.tolist(), np.diff(at).tolist()) for _, _, h, at in hashing.pieces(texts)]
    assert sum((p[0] for p in parts), []) == sum((p[0] for p in whole), [])
    assert sum((p[1] for p in parts), []) == sum((p[1] for p in whole), [])


def test_icws_agreement_estimates_weighted_jaccard():
    rng = np.random.default_rng(2)
    h = hashing.mix(np.arange(4000, dtype=np.uint64))
    wa, wb = rng.uniform(0.3, 3, 4000), rng.uniform(0.3, 3, 4000)
    wa[:400] = 0
    wb[-400:] = 0
    truth = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    agree = []
    for s in range(40):
        hs = hashing.mix(h + np.uint64(s * 10_000))
        a, b = (near_dedup.signatures(np.zeros((w > 0).sum(), int), hs[w > 0], w[w > 0], 1)[1][0] for w in (wa, wb))
        agree.append((a == b).mean())
    assert abs(np.mean(agree) - truth ** near_dedup.ROWS) < 0.06


def groups(rng):
    """Documents with exact copies, near copies of all degrees and families that only meet through their original."""
    rows, i = list(data.documents(20)), 3000
    for family in range(12):
        w = data.sentence(rng, rng.choice([40, 150, 400])).split()
        copies = [w]
        for _ in range(rng.randint(1, 12)):
            c = list(rng.choice(copies))
            for _ in range(rng.randint(0, max(1, len(c) // 25))):
                c[rng.randrange(len(c))] = data.sentence(rng, 1)
            copies.append(c)
        rng.shuffle(copies)
        for c in copies:
            i += rng.randint(1, 9)
            rows.append((i, " ".join(c), "en", rng.choice("abc"), 0))
    return rows


def brute_classes(rows, similarity=0.8):
    texts = sorted({r[1] or "" for r in rows})
    bags = [bag(t) for t in texts]
    df = Counter(s for r in rows for s in bag(r[1]))
    n, rare = len(rows), near_dedup.RARE
    cut = max(1.0, n / rare)

    def weight(s):
        if df[s] <= max(1, n // rare):
            return 1.0
        return 1 - (1 - near_dedup.FLOOR) * math.log(max(df[s] / cut, 1)) / math.log(max(n / cut, 2.0))

    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = []
    for a in range(len(texts)):
        for b in range(a):
            top = sum(max(bags[a][s], bags[b][s]) * weight(s) for s in bags[a] | bags[b])
            s = sum(min(bags[a][s], bags[b][s]) * weight(s) for s in bags[a] & bags[b]) / top if top else 0
            near.append(s)
            if s >= similarity:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            least[find(texts.index(r[1] or ""))].append(r[0])
    return sorted(repr((r[0], min(least[find(texts.index(r[1] or ""))], default=None))) for r in rows), near


def test_classes_match_all_pairs(spark):
    rows = groups(random.Random(8))
    got = near_dedup.classes(data.frame(spark, rows, extra=True)).collect()
    want, near = brute_classes(rows)
    assert sum(0.8 <= s < 0.95 for s in near) > 20 and sum(0.5 < s < 0.8 for s in near) > 20
    assert sorted(repr((r["doc_id"], r["class_id"])) for r in got) == want


def crowd(rng, n, words_of, edits):
    """One text's copies with edits of their own, most of them just below the similarity of each other; some copied again."""
    w = data.sentence(rng, words_of).split()
    copies = []
    for _ in range(n):
        c = list(rng.choice(copies) if copies and rng.random() < 0.1 else w)
        for _ in range(rng.randint(*edits)):
            c[rng.randrange(len(c))] = data.sentence(rng, 1) + str(rng.randrange(10**6))
        copies.append(c)
    return [(9000 + i, " ".join(c), "en", "a", 0) for i, c in enumerate(copies)]


def test_a_hot_group_just_below_the_similarity(spark):
    rows = crowd(random.Random(12), 120, 100, (1, 2)) + list(data.documents(10))
    got = near_dedup.classes(data.frame(spark, rows)).collect()
    want, near = brute_classes(rows)
    assert sum(0.65 <= s < 0.8 for s in near) > 3000
    assert sorted(repr((r["doc_id"], r["class_id"])) for r in got) == want


def test_one_of_each_class_stays(spark):
    rows = groups(random.Random(9))
    docs = data.frame(spark, rows, extra=True)
    kept = near_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    want, _ = brute_classes(rows)
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(set(got)) == len(got)
    assert {d for d, _ in got} == {eval(w)[1] for w in want}


def test_empty_tables(spark):
    assert near_dedup.classes(data.empty(spark)).count() == 0
    wordless = data.frame(spark, [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "!!", "en", "a", 0), (4, "!!", None, None, 0)])
    assert sorted((r["doc_id"], r["class_id"]) for r in near_dedup.classes(wordless).collect()) == [(1, 1), (2, 1), (3, 3), (4, 3)]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(40)] + [(300, 200 + i) for i in range(50)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["n"]: r["c"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in linked}


def test_pipeline_stages(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_dedup", "benchmark_decontamination", "mixing", "sharding"]
    rows = groups(random.Random(10))
    item = " ".join(rows[70][1].split()[2:30])
    data.frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and len({(r["shard"], r["slot"]) for r in out}) == len(out)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
        docs = after
    assert docs.count() == len(out)
    assert not any(item in r["text"] for r in docs.collect())


def test_a_hot_group_costs_few_pairs(spark, monkeypatch):
    """Members of a group without its original, half of them similar to none: pairs don't grow with the square of the group."""
    rng = random.Random(15)
    rows = crowd(rng, 150, 100, (1, 5)) + [(20_000 + r[0], *r[1:]) for r in crowd(rng, 60, 80, (2, 3))] + list(data.documents(10))
    compared, links = [], near_dedup._links

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return links(pairs, *rest)

    monkeypatch.setattr(near_dedup, "_links", counted)
    got = near_dedup.classes(data.frame(spark, rows)).collect()
    want, near = brute_classes(rows)
    assert sum(0.6 <= s < 0.8 for s in near) > 3000
    assert sorted(repr((r["doc_id"], r["class_id"])) for r in got) == want
    assert sum(compared) < 8 * len(rows)


def test_family_pairs_hold_every_link_but_the_middles(spark):
    rng = random.Random(16)
    rows = crowd(rng, 60, 60, (1, 4)) + crowd(rng, 10, 70, (0, 2))
    texts = sorted({r[1] for r in rows})
    bags = [bag(t) for t in texts]
    weight = [float(sum(b.values())) for b in bags]
    none = (np.zeros(0, np.uint32), np.zeros(0))
    live = spark.createDataFrame([(1, i, w, i) for i, w in enumerate(weight)], "key bigint, id bigint, weight double, c bigint")
    heads = spark.createDataFrame([(1, 0)], "key bigint, head bigint")
    table = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    pairs, settled = near_dedup._family_pairs(live, heads, table, none, 0.8)
    pairs, settled = {(r["a"], r["b"]) for r in pairs.collect()}, {r["id"] for r in settled.collect()}

    def similar(a, b):
        return sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values())

    links = {(a, b) for a in range(len(texts)) for b in range(a) if similar(a, b) and (a in settled or b in settled)}

    def parts(edges):
        root = list(range(len(texts)))
        for _ in texts:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    found = {(a, b) for a, b in pairs if similar(a, b)}
    assert links and len(settled) > 40
    assert parts(found | links) == parts(found)


def test_buckets_that_share_members_are_one_family(spark):
    """A member is compared with one centre, not with one for each of its buckets."""
    size = near_dedup.CROWD + 4
    rows = [(k, i) for k in range(8) for i in range(k, k + size)] + [(50, i) for i in (3, 4)] + [(90, 500 + i) for i in range(size)]
    places = spark.createDataFrame([(k, i) for k, i in rows], "key bigint, id bigint")
    best = {k: max((i == 10, i) for key, i in rows if key == k) for k, _ in rows}  # node 10 has the most buckets
    heads = spark.createDataFrame([(k, sum(key == k for key, _ in rows), 9 if top else 1, i) for k, (top, i) in best.items()],
                                  "key bigint, n bigint, bscore bigint, b bigint")
    got = {r["key"]: r["head"] for r in near_dedup._families(places, heads).collect()}
    assert got == {**dict.fromkeys(range(8), 10), 50: 10, 90: 500 + size - 1}


def test_rounds_of_a_hot_group(spark, monkeypatch):
    """Few rounds, each of many jobs: what families leave is compared at once when it has become small."""
    rng = random.Random(17)
    rows = crowd(rng, 150, 60, (1, 4)) + list(data.documents(10))
    rounds, links = [], near_dedup._links

    def counted(pairs, *rest):
        rounds.append(pairs.columns)
        return links(pairs, *rest)

    monkeypatch.setattr(near_dedup, "_links", counted)
    got = near_dedup.classes(data.frame(spark, rows)).collect()
    want, _ = brute_classes(rows)
    assert sorted(repr((r["doc_id"], r["class_id"])) for r in got) == want
    assert len(rounds) <= 4


def test_components_of_stars_take_no_round(spark, monkeypatch):
    from seatgrid.operators import components as operator

    written, cut = [], operator.cut_lineage
    monkeypatch.setattr(operator, "cut_lineage", lambda df: written.append(1) or cut(df))
    edges = [(1, i) for i in range(2, 30)] + [(100 + i, 200 + i) for i in range(30)]
    got = {r["n"]: r["c"] for r in operator.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {1: 1, **{i: 1 for i in range(2, 30)}, **{100 + i: 100 + i for i in range(30)}, **{200 + i: 100 + i for i in range(30)}}
    assert len(written) == 1
    chain = spark.createDataFrame([(1, 2), (2, 3), (2, 5), (4, 5), (7, 7)], "a bigint, b bigint")
    assert {r["n"]: r["c"] for r in operator.connected_components(chain).collect()} == dict.fromkeys(range(1, 6), 1)
