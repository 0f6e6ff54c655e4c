"""Quality rules: robust multivariate outliers by minimum covariance determinant (MCD).

Each document gets a vector of transformed statistics (``FEATURES``). For every (language, source), for every language and for
all documents, the MCD estimate is the mean and covariance of the ``SHARE`` of rows with the smallest Mahalanobis
distance, found by concentration steps: distances, the closest share, its mean and covariance, again, from two
deterministic starts (plain mean and covariance; median and absolute deviation), of which the one with the smaller
determinant stays. A document is rejected if its squared distance, by the estimate of its (language, source), is above
``CUTOFF``. A group with fewer than ``LEAST`` rows uses its language's estimate, a small language all documents', and
below ``LEAST`` documents in all nothing is rejected but by the base rule.

Distributed form: a step joins each row's vector with its groups' current estimates and sums rows by (group, distance
bin): counts, sums and products, combined before the shuffle. Groups with more than 1 / ``HEAVY`` of the rows, of which there
are at most ``HEAVY`` to a level whatever the corpus, have their estimates broadcast; only rows of the other groups are shuffled by group.
Bins are 1/16 of a factor two wide, so a group has at most ``MOST_BIN`` of them whatever its size, and a step's share is the lowest
bins that reach it, the last one whole. Vectors are whole numbers (1/1000), so the sums are exact and reruns agree.

Statistics are shrunk towards a usual value by a few imaginary words, so short texts don't stand out by chance,
and covariances get a floor (``FLOOR``), as clean groups may not vary at all in some statistic.

Base rule: fewer than ten words, or over 20 % of the words in repeated five-word windows. Such documents are rejected and take no
part in the estimates. A null text is empty; a null language or source is a group of its own; repeated rows count
each time and get the same verdict; an empty table gives an empty result. Only ``doc_id``, ``text``, ``lang`` and ``source`` are
read.
"""

from __future__ import annotations

import re
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatgrid.llm.common import keep_rows, text_key, whole_text
from seatgrid.session import cut_lineage

FEATURES = ("word_length", "symbols", "duplicate_lines", "repeated_words", "upper_case", "marks")
SHARE = 0.6
STEPS = 4
LEAST = 60
CUTOFF = 40.0
FLOOR = (0.08, 0.08, 0.06, 0.05, 0.06, 0.08)  # least standard deviation of each statistic
SCALE = 1000
MOST_BIN = 640
HEAVY = 1000

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = re.compile(r"[A-Z\u00c0-\u00d6\u00d8-\u00de]")
SYMBOLS = "#*$%&|<>"
MARKS = "!?=_~^@\\/{}[]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_echoes", "n_upper", "n_marks")


def text_counts(text: str) -> dict[str, int]:
    words = WORD.findall(text)
    n = len(words)
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        until = 0  # words before this place are counted
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeated += i + 5 - max(i, until)
                until = i + 5
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeated, "n_lines": len(lines), "n_echoes": sum(map(eq, words, words[1:])),
        "n_upper": len(UPPER.findall(text)), "n_marks": sum(map(text.count, MARKS)),
    }


_ARROW = pa.struct([(c, pa.int64()) for c in COUNTS])


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def count_text(texts: pa.Array) -> pa.Array:
    return pa.array([text_counts(t.as_py()) for t in texts], _ARROW)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, lang, source, the counts, base_failed and the vector x0, x1, ... (bigint, 1/1000)."""
    c = docs.select("doc_id", "lang", "source", text_key().alias("text_key"), count_text(whole_text()).alias("c")) \
        .select("doc_id", "text_key", "lang", "source", "c.*")
    n = F.col("n_words")
    vector = (
        F.log((F.col("word_chars") + 60) / (n + 12)),
        F.log1p(4 * F.col("n_symbols") / (n + 12)),
        F.col("n_dup_lines") / (F.col("n_lines") + 4),
        (F.col("n_repeat_words") + 2 * F.col("n_echoes")) / (n + 20),
        F.col("n_upper") / (F.col("word_chars") + 60),
        F.log1p(4 * F.col("n_marks") / (n + 12)),
    )
    return c.withColumn("base_failed", (n < 10) | (100 * F.col("n_repeat_words") > 20 * n)) \
        .select("*", *[F.round(v * SCALE).cast("bigint").alias(f"x{i}") for i, v in enumerate(vector)])


def _levels(lang: Column, source: Column) -> list[Column]:
    """Names of the groups a row belongs to, from the narrowest; null has a name of its own."""
    name = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), c))
    return [F.concat_ws("\x1f", F.lit("s"), name(lang), name(source)), F.concat_ws("\x1f", F.lit("l"), name(lang)), F.lit("a")]


_P = len(FEATURES)
_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]


def _moments() -> list[Column]:
    """Exact sums of the vectors and their products."""
    return [F.count(F.lit(1)).alias("n")] + [F.sum(f"x{i}").alias(f"s{i}") for i in range(_P)] \
        + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in _PAIRS]


_FIT = T.StructType([T.StructField("grp", T.StringType()), T.StructField("start", T.IntegerType())] + [
    T.StructField(c, T.DoubleType()) for c in ("logdet", *(f"mu{i}" for i in range(_P)), *(f"v{i}_{j}" for i, j in _PAIRS))])
_MODEL = [c for c in _FIT.names if c not in ("grp", "start", "logdet")]


def _fit(tables):
    """Mean, inverse covariance and log determinant of each row of sums: one row in, one row out."""
    for t in tables:
        out = []
        for r in t.to_pylist():
            n = max(1, r["n"])
            mu = np.array([float(r[f"s{i}"]) for i in range(_P)]) / n / SCALE
            cov = np.zeros((_P, _P))
            for i, j in _PAIRS:
                cov[i, j] = cov[j, i] = float(r[f"p{i}_{j}"]) / n / SCALE**2 - mu[i] * mu[j]
            cov = cov * r["widen"] + np.diag(np.square(FLOOR))
            inv = np.linalg.inv(cov)
            out.append({"grp": r["grp"], "start": r["start"], "logdet": float(np.linalg.slogdet(cov)[1])}
                       | {f"mu{i}": float(mu[i]) for i in range(_P)} | {f"v{i}_{j}": float(inv[i, j]) for i, j in _PAIRS})
        schema = pa.schema([(f.name, {"string": pa.string(), "int": pa.int32()}.get(f.dataType.simpleString(), pa.float64())) for f in _FIT])
        yield from pa.Table.from_pylist(out, schema).to_batches()


def with_distance(rows: DataFrame) -> DataFrame:
    """Adds dist2, the squared Mahalanobis distance of the vector by the model columns beside it."""
    rows = rows.select("*", *[(F.col(f"x{i}") / F.lit(float(SCALE)) - F.col(f"mu{i}")).alias(f"d{i}") for i in range(_P)])
    total = F.lit(0.0)
    for i, j in _PAIRS:
        total = total + F.col(f"d{i}") * F.col(f"d{j}") * F.col(f"v{i}_{j}") * F.lit(1.0 if i == j else 2.0)
    return rows.select("*", F.when(total < 0, F.lit(0.0)).otherwise(total).alias("dist2")).drop(*[f"d{i}" for i in range(_P)])


def heavy_groups(rows: DataFrame, key: str) -> DataFrame:
    """The key's values that more than 1 / ``HEAVY`` of the rows have: at most ``HEAVY`` of them."""
    total = rows.count()
    return cut_lineage(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * HEAVY > total).select(key))


def group_join(rows: DataFrame, table: DataFrame, key: str, heavy: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with a table of one or two rows to a key, without dealing a heavy key's rows by the key."""
    mark = F.broadcast(heavy.withColumn("_heavy", F.lit(True)))
    tagged = rows.join(mark, key, "left")
    few = table.join(mark.drop("_heavy"), key, "left_semi")
    own = tagged.filter("_heavy").drop("_heavy").join(F.broadcast(few), key, how)
    return own.unionByName(tagged.filter("_heavy is null").drop("_heavy").join(table, key, how))


def estimate(vectors: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """vectors: grps array<string>, x0... One row per group: grp, n and the MCD estimate's model columns."""
    xs = [f"x{i}" for i in range(_P)]
    rows = vectors.select(F.explode("grps").alias("grp"), *xs)
    heavy = heavy_groups(rows, "grp")
    first = cut_lineage(rows.groupBy("grp").agg(*_moments(), *[F.percentile_approx(x, 0.5, 1000).alias(f"m{i}") for i, x in enumerate(xs)]))
    sizes = first.select("grp", F.col("n").alias("total"))
    plain = first.select("grp", F.lit(0).alias("start"), F.lit(1.0).alias("widen"), "n", *[f"s{i}" for i in range(_P)], *[f"p{i}_{j}" for i, j in _PAIRS])
    # medians with the deviations around them: sums as if the median were the mean, without correlations
    mid = group_join(rows, first.select("grp", *[f"m{i}" for i in range(_P)]), "grp", heavy).groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), *[F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5, 1000).alias(f"a{i}") for i in range(_P)],
        *[F.min(f"m{i}").alias(f"m{i}") for i in range(_P)])
    robust = mid.select(
        "grp", F.lit(1).alias("start"), F.lit(1.0).alias("widen"), "n", *[(F.col(f"m{i}") * F.col("n")).alias(f"s{i}") for i in range(_P)],
        *[(F.col("n") * (F.col(f"m{i}") * F.col(f"m{j}") + (F.round(F.lit(2.198) * F.col(f"a{i}") * F.col(f"a{i}")).cast("bigint") if i == j else 0)))
          .alias(f"p{i}_{j}") for i, j in _PAIRS])
    fit = cut_lineage(plain.unionByName(robust).mapInArrow(_fit, _FIT))
    widen = _consistency(share)
    for _ in range(steps):
        near = with_distance(group_join(rows, fit.drop("logdet"), "grp", heavy))
        b = F.least(F.lit(MOST_BIN), F.floor(16 * F.log2(1 + 256 * F.col("dist2")))).cast("int")
        bins = near.select("grp", "start", b.alias("b"), *xs).groupBy("grp", "start", "b").agg(*_moments())
        before = F.sum("n").over(Window.partitionBy("grp", "start").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
        close = bins.withColumn("_before", F.coalesce(before, F.lit(0))).join(sizes, "grp") \
            .filter(F.col("_before") < F.ceil(F.lit(share) * F.col("total")))
        sums = close.groupBy("grp", "start").agg(*[F.sum(c).alias(c) for c in ("n", *(f"s{i}" for i in range(_P)), *(f"p{i}_{j}" for i, j in _PAIRS))])
        fit = cut_lineage(sums.withColumn("widen", F.lit(widen)).mapInArrow(_fit, _FIT))
    best = fit.groupBy("grp").agg(F.min_by(F.struct(*_MODEL), F.struct("logdet", "start")).alias("f"))
    return best.join(sizes, "grp").select("grp", F.col("total").alias("n"), "f.*")


def _consistency(share: float) -> float:
    """share / P(chi2 with _P + 2 degrees < q), q the share's quantile of chi2 with _P degrees (even _P)."""
    def cdf(q, k):  # closed form for even k
        term, total = 1.0, 0.0
        for i in range(k // 2):
            total += term
            term *= q / 2 / (i + 1)
        return 1 - np.exp(-q / 2) * total

    lo, hi = 0.0, 100.0
    for _ in range(100):
        q = (lo + hi) / 2
        lo, hi = (q, hi) if cdf(q, _P) < share else (lo, q)
    return float(share / cdf(lo, _P + 2))


def judge(docs: DataFrame, cutoff: float = CUTOFF, least: int = LEAST) -> DataFrame:
    """One row per document row: doc_id, text_key, the counts, base_failed, distance (null if no group is
    large enough), grp (whose estimate was used) and kept."""
    rows = cut_lineage(statistics(docs).withColumn("grps", F.array(*_levels(F.col("lang"), F.col("source")))))
    fits = cut_lineage(estimate(rows.filter(~F.col("base_failed"))).filter(F.col("n") >= least).drop("n"))
    # The narrowest of a row's groups that has an estimate, by group names first (few distinct combinations)
    combos = rows.select("grps").distinct()
    picks = combos.select("grps", F.posexplode("grps").alias("k", "grp")).join(fits, "grp") \
        .groupBy("grps").agg(F.min_by(F.struct("grp", *_MODEL), "k").alias("f")).select("grps", "f.*")
    own = rows.select(*[c for c in rows.columns if c != "grps"], F.col("grps")[0].alias("g"))
    picked = cut_lineage(picks.withColumn("g", F.col("grps")[0]).drop("grps"))
    out = with_distance(group_join(own, picked, "g", heavy_groups(own, "g"), "left"))
    far = F.coalesce(F.col("dist2") > cutoff, F.lit(False))
    return out.select("doc_id", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", (~F.col("base_failed") & ~far).alias("kept"), F.col("dist2").alias("distance"), "grp")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents the rules keep, every column kept."""
    good = judge(docs).filter("kept").select("doc_id", "text_key")
    return keep_rows(docs, cut_lineage(good))
