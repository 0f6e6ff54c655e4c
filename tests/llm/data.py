"""Small document tables with every odd case, for the operators' tests."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: further columns whose names the operators use inside
MORE = ["size", "n", "w", "key", "score", "spans", "words", "copies", "rate", "c", "b", "h", "x0", "grp", "shard", "text_key", "kept", "_src"]


def sentence(rng: random.Random, n: int) -> str:
    parts = ["an", "be", "co", "du", "el", "fi", "go", "ha", "in", "jo", "ka", "lu"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def documents(n: int = 60, seed: int = 1) -> list[tuple]:
    """Plain rows, then nulls, empties, a very long text, ties and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = ".\n".join(sentence(rng, rng.randint(5, 25)) for _ in range(rng.randint(1, 6)))
        rows.append((i, text, rng.choice(["en", "de"]), rng.choice(["a", "b", "c"])))
    long = sentence(rng, 30_000)
    rows += [(1000, None, "en", "a"), (1001, "", "en", None), (1002, " \n\t ", None, "b"), (None, "no id at all here today", "de", "c"),
             (1003, long, "en", "a"), (1004, "?!... --", "de", None), rows[3], rows[3], (1005, rows[4][1], "de", "b"),
             (7, "the id seven again with other words", "en", "b"), (1006, "é ü ß 漢字 \U0001f600 text", "en", "c")]
    return [(*r, len(r[1] or "")) for r in rows]


def frame(spark, rows=None, extra: bool = False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    return df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(MORE)]) if extra else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *drop) -> list[tuple]:
    cols = sorted(c for c in df.columns if c not in drop)
    return sorted((tuple(repr(r[c]) for c in cols) for r in df.collect()))
