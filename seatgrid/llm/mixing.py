"""Mixing sources to target weights by entropy balancing.

Targets: all words are shared out to the sources by weight; a target stops at ``MOST`` times its source's
words and the excess goes to the others by weight, until none is above.

Rates: document i of source s is taken r_i times on average, 0 <= r_i <= MOST, with the least relative
entropy to taking each once, sum r log r - r + 1, such that each source's words sum r_i size_i meet its
target. The solution is the tilt r_i = min(MOST, exp(lambda_s x_i)), x_i: size over the source's
word-weighted mean size. The dual is convex and splits by source; Newton steps on log g(lambda),
g = sum n size r, run for all sources at once, each kept inside a bracket (bisection beyond it), as Spark
aggregations over the exact table of (source, size) counts until every source meets its target to
``TOLERANCE``.

Copies: rates in whole 2^-20 are summed along each source in order of (size, seeded hash, doc_id); a document gets
floor(sum up to it + 1/2) - floor(sum before it + 1/2) copies, which is the floor or the ceiling of its rate, and
documents of like size share out the rounding, so a source's words come near its target. Rates and sums are whole numbers,
so reruns agree.

A null text has no words (size 0, taken 0); a null source is a source of its own, last; a repeated row counts
each time. Only ``doc_id``, ``source`` and ``text`` are read. Empty tables give empty results; if no text has a word
all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatgrid.llm.common import SPACE_WORD, text_key, whole_text
from seatgrid.operators.ranking import ordered_positions
from seatgrid.session import cut_lineage

MOST = 3
WEIGHTS = (5.0, 2.0, 1.0)
TOLERANCE = 1e-9
UNIT = 1 << 20
SEED = 7
STEPS = 400  # more than bisection needs; beyond it the job fails, it never goes on unsolved


def _source_key():
    """Null last, else by code point; equal keys, equal sources."""
    return F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))


def narrow_rows(docs: DataFrame, *more) -> DataFrame:
    size = F.size(F.regexp_extract_all(whole_text(), F.lit(SPACE_WORD), F.lit(0))).cast("bigint")
    return docs.select("doc_id", _source_key().alias("_src"), size.alias("size"), *more)


def targets(hist: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """_src, source_size, weighted mean size, least size above 0, target. hist: _src, size, n."""
    s = hist.groupBy("_src").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"),
        F.sum(F.col("size").cast("double") * F.col("size") * F.col("n")).alias("_sq"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("_least"))
    ranked = ordered_positions(cut_lineage(s), [F.col("_src")])
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = cut_lineage(ranked.select("_src", "source_size", "_sq", "_least", F.get(cycle, ((F.col("_pos") - 1) % len(weights)).cast("int")).alias("w")))
    cap = F.lit(float(most)) * F.col("source_size")
    total, level = float(s.agg(F.sum("source_size")).first()[0] or 0), None
    while True:  # each pass caps at least one more source, or it is the last
        over = F.lit(False) if level is None else cap < F.col("w") * F.lit(level)
        capped, free, n = s.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("w"))), F.count(F.when(over, 1))).first()
        new = (total - (capped or 0.0)) / free if free else 0.0
        if level is not None and n == n_capped:
            break
        level, n_capped = new, n if level is not None else 0
    return s.select("_src", "source_size", F.greatest(F.col("_sq") / F.greatest(F.col("source_size"), F.lit(1)), F.lit(1.0)).alias("_scale"), "_least",
                    F.least(cap, F.col("w") * F.lit(level)).alias("target"))


def solve_rates(hist: DataFrame, goal: DataFrame, most: int = MOST, tolerance: float = TOLERANCE) -> DataFrame:
    """goal with ``lam``: the dual solution of each source."""
    x_least = F.col("_least") / F.col("_scale")
    none = (F.col("source_size") == 0)
    top = F.log(F.lit(float(most))) / x_least * (1 + 1e-12)  # from here on every rate is ``most``
    state = goal.withColumn("hi", F.when(none, F.lit(0.0)).otherwise(top)).withColumn(
        "lo", F.when(none, F.lit(0.0)).otherwise(F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size")) / x_least) - 1)) \
        .withColumn("full", none | (F.col("target") >= F.lit(float(most)) * F.col("source_size") * (1 - tolerance))) \
        .withColumn("lam", F.when(F.col("full"), F.col("hi")).otherwise(F.lit(0.0))) \
        .withColumn("done", F.col("full"))
    state = cut_lineage(state)
    for _ in range(STEPS):
        if state.filter(~F.col("done")).isEmpty():
            return state.drop("hi", "lo", "full", "done")
        live = state.filter(~F.col("done")).select("_src", "lam", "_scale")
        x = F.col("size") / F.col("_scale")
        r = F.least(F.lit(float(most)), F.exp(F.col("lam") * x))
        mass = F.col("n") * F.col("size") * r
        seen = hist.join(live, "_src").groupBy("_src").agg(
            F.sum(mass).alias("g"), F.sum(F.when(r < most, mass * x).otherwise(F.lit(0.0))).alias("dg"))
        s = state.join(seen, "_src", "left")
        t, g = F.col("target"), F.col("g")
        ok = F.col("done") | (F.abs(g - t) <= tolerance * t)
        lo = F.when(g < t, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(g > t, F.col("lam")).otherwise(F.col("hi"))
        step = F.when(F.col("dg") > 0, F.col("lam") + F.log(t / g) * g / F.col("dg"))
        inside = (step > F.col("lo2")) & (step < F.col("hi2"))
        s = s.withColumn("ok", ok).withColumn("lo2", lo).withColumn("hi2", hi)
        state = cut_lineage(s.select(
            "_src", "source_size", "_scale", "_least", "target",
            F.when(F.col("ok"), F.col("hi")).otherwise(F.col("hi2")).alias("hi"),
            F.when(F.col("ok"), F.col("lo")).otherwise(F.col("lo2")).alias("lo"), "full",
            F.when(F.col("ok"), F.col("lam")).when(inside, step).otherwise((F.col("lo2") + F.col("hi2")) / 2).alias("lam"),
            (F.col("ok") | (F.col("hi2") - F.col("lo2") <= 1e-15 * F.abs(F.col("hi2")))).alias("done")))
    raise RuntimeError(f"the dual did not converge in {STEPS} steps")


def mix_documents(rows: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """rows (doc_id, _src, size, more) with source_size, target, rate and copies."""
    columns = rows.columns
    # rows alike in size and doc_id (null ids) can be many: a number of their own, the same in every later pass, tells them apart
    rows = cut_lineage(rows.withColumn("_tie", F.monotonically_increasing_id()))
    hist = cut_lineage(rows.groupBy("_src", "size").agg(F.count(F.lit(1)).alias("n")))
    goal = cut_lineage(targets(hist, weights, most))
    solved = solve_rates(hist, goal, most)
    # lam to nine digits, so that the last bits of a sum don't decide a rate
    lam = F.round(F.col("lam") * F.lit(1e9)) / F.lit(1e9)
    rate = F.least(F.lit(float(most)), F.exp(lam * F.col("size") / F.col("_scale")))
    r = rows.join(solved.select("_src", "source_size", "_scale", "target", "lam"), "_src")
    r = r.withColumn("_q", F.round(rate * UNIT).cast("bigint")).drop("lam", "_scale") \
        .withColumn("_mix", F.xxhash64(F.lit(seed), F.col("doc_id")))
    placed = ordered_positions(r, [F.col("size"), F.col("_mix"), F.col("doc_id"), F.col("_tie")], keys=["_src"], weight=F.col("_q"))
    half = UNIT // 2
    copies = F.expr(f"(_before + _q + {half}) div {UNIT} - (_before + {half}) div {UNIT}")
    return placed.select(*columns, "source_size", "target", (F.col("_q") / F.lit(float(UNIT))).alias("rate"), copies.alias("copies"))


def mix_digest(docs: DataFrame) -> DataFrame:
    m = mix_documents(narrow_rows(docs))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate",
                    "copies", F.expr("if(_src = '1', null, substring(_src, 2))").alias("source"))


def take_copies(docs: DataFrame) -> DataFrame:
    """The mix itself: every row as often as it is taken, with all its columns.

    Rows alike in doc_id, text and source are one row here that gets all their copies.
    """
    m = mix_documents(narrow_rows(docs, text_key().alias("text_key")))
    c = m.filter("copies > 0").groupBy("doc_id", "text_key", "_src").agg(F.sum("copies").cast("int").alias("__copies")) \
        .select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("_src").alias("__of"), "__copies")
    d = docs.withColumn("__text_key", text_key()).withColumn("__src", _source_key())
    hit = d["doc_id"].eqNullSafe(c["__id"]) & (d["__text_key"] == c["__key"]) & (d["__src"] == c["__of"])
    one = d.join(c, hit).dropDuplicates(["doc_id", "__text_key", "__src"])
    return one.withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
