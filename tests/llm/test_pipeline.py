"""The corpus pipeline, stage by stage, against plain Python versions."""

import random
from collections import Counter

import corpus_pipeline
from seatgrid.llm import mixing

from . import data
from .test_chat_and_search import brute_pairs
from .test_mixing_sharding import plain_shards
from .test_near_dedup import brute_classes, groups
from .test_text_operators import junky, numpy_verdicts


def _rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def _same(got, want):
    assert Counter(map(repr, got)) == Counter(map(repr, want))


def test_pipeline_matches_plain_python(spark, tmp_path):
    rng = random.Random(14)
    rows = [r for r in junky(120) if r[1] is None or len(r[1]) < 5000] + groups(rng)[30:]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]  # one id each, so that a row is known by it
    items = [(1, " ".join(rows[40][1].split()[2:30])), (2, data.sentence(rng, 20)), (3, None)]
    rows.append((9000, f"{data.sentence(rng, 30)} {items[1][1]} {data.sentence(rng, 5)}", "en", "b", 0))
    data.frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    good = stages["quality_rules"](spark, docs, str(tmp_path))
    kept = {i for i, _, ok, _ in numpy_verdicts(docs) if ok}
    now = [r for r in rows if r[0] in kept]
    _same(_rows(good), now)
    assert 0 < len(now) < len(rows)

    one = stages["near_dedup"](spark, data.frame(spark, now), str(tmp_path))
    first = {eval(w)[1] for w in brute_classes(now)[0]}
    assert 0 < len(first) < len(now)
    now = [r for r in now if r[0] in first]
    _same(_rows(one), now)

    clean = stages["benchmark_decontamination"](spark, data.frame(spark, now), str(tmp_path))
    hit = {d for d, *_ in brute_pairs(now, items)}
    assert hit
    now = [r for r in now if r[0] not in hit]
    _same(_rows(clean), now)

    mixed = stages["mixing"](spark, data.frame(spark, now), str(tmp_path))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_digest(data.frame(spark, now)).collect()}  # tested row by row on its own
    now = [r for r in now for _ in range(copies[r[0]])]
    _same(_rows(mixed), now)

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(repr((r["doc_id"], r["size"], r["shard"], r["slot"])) for r in got) == plain_shards(now)
