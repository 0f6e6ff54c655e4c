"""License scans: exact set-similarity join of text blocks with license templates.

A block is one line of a document and, with ``wrapped`` (as the registered query runs), also every run of
``ceil(words of the template / threshold)`` consecutive words, wherever the lines end, so that a notice broken
over lines is one block. A block meets a template when at least ``threshold`` of the template's distinct words
occur in it (containment |T and B| / |T|); every meeting block is a match. A match is ``confirmed`` if the block also holds the words that
tell the license from others (``REQUIRED``). The join is exact and runs as

1. token frequencies of the template vocabulary over the whole corpus give one global order
   (rarest first; words outside the vocabulary can never match and count as first);
2. a template's prefix is its first ``n - need + 1`` tokens in that order, ``need = ceil(threshold n)``:
   a meeting block holds one of them, so only blocks with a prefix token leave the scan;
3. the token join keeps pairs that pass the length filter (enough vocabulary words), the block's own
   prefix filter, and the positional filter (tokens left after the first shared one suffice);
4. the overlap of what is left is counted exactly;
5. a document of several lines goes through 1 to 4 as one more block: only where it meets a template as a whole can
   one of its runs of words do so, and those runs are counted one by one, from each template word on. A run is
   listed where it holds more of the template than any single line, or is confirmed where no line is.

Nulls: a null text is an empty one, with no words; a null doc_id stays null. Repeated rows each get
their own result row. Only ``doc_id`` and ``text`` are read, so further columns cannot clash.
Empty tables give empty results.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatgrid.llm.common import alnum_words, whole_text
from seatgrid.session import cut_lineage

THRESHOLD = 0.8

# Phrases that always count, and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Public license notices searched by containment, one label each.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted "
           "provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
                "and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "reserved-notice": "All rights reserved.",
}


# Words without which a matching block may be another license's: such a match is listed but not confirmed.
REQUIRED = {
    "apache-2.0": ["apache", "2"],
    "cc-by-nc-4.0": ["cc", "nc", "4"],
    "gpl-3.0": ["general", "public", "3"],
    "mit": ["mit"],
    "mpl-2.0": ["mozilla", "2"],
}


def template_tokens(templates: dict[str, str]) -> dict[str, list[str]]:
    return {k: sorted(set(re.findall(r"[a-z0-9]+", v.lower()))) for k, v in templates.items()}


def needed(n: int, threshold: float) -> int:
    """Least overlap of a template of n tokens: ceil(threshold * n), free of binary rounding."""
    return -(-round(threshold * 1000) * n // 1000)


def window_words(text: str, threshold: float) -> int:
    """Length in words of the runs that may cross line ends: ceil(words / threshold)."""
    return -(-len(re.findall(r"[a-z0-9]+", text.lower())) * 1000 // round(threshold * 1000))


def token_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The template vocabulary by its frequency over all documents, rarest first (ties: by token).

    The result is as long as the vocabulary, whatever the corpus: a bounded collect.
    """
    words = docs.select(F.explode(alnum_words(whole_text())).alias("w")).filter(F.col("w").isin(vocabulary))
    counts = {r["w"]: r["n"] for r in words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))


def _base_places(words):
    """Word positions where a base phrase starts, with its label."""
    def hit(i):
        cases = F.lit(None).cast("string")
        for phrase, label in BASE_PHRASES.items():
            cond = F.lit(True)
            for k, w in enumerate(phrase.split()):
                cond = cond & (F.get(words, i + k) == w)
            cases = F.when(cond, F.lit(label)).otherwise(cases)
        return F.struct(i.alias("at"), cases.alias("label"))

    spots = F.transform(F.sequence(F.lit(0), F.size(words) - 1), hit)
    return F.filter(spots, lambda s: s["label"].isNotNull())


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD,
                  wrapped: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, base array<struct<at, label>>, matches
    array<struct<label, block, containment, confirmed>> (block: line number from 0; of a run over line ends, where it starts)."""
    spark = docs.sparkSession
    must = REQUIRED if templates is None else {}
    templates = TEMPLATES if templates is None else templates
    tokens = template_tokens(templates)
    order = token_order(docs, sorted({t for ts in tokens.values() for t in ts}))
    at = {t: i for i, t in enumerate(order)}
    shape = []  # label, tokens in global order, need
    for label, ts in tokens.items():
        if ts:
            shape.append((label, sorted(ts, key=at.get), needed(len(ts), threshold)))
    prefix = sorted({t for _, ts, need in shape for t in ts[: len(ts) - need + 1]})
    ranks = F.create_map(*[F.lit(x) for t in order for x in (t, at[t])]) if order else None

    lines = docs.select(F.col("doc_id"), F.split(F.lower(whole_text()), "\n").alias("ls")) \
        .select("doc_id", F.transform("ls", lambda t: alnum_words(t)).alias("lw")) \
        .select("doc_id", "lw", F.flatten("lw").alias("words"))
    w = F.col("words")
    ends = F.array_contains(w, "license") | F.array_contains(w, "reserved") | F.array_contains(w, "cc")
    empty = F.array().cast("array<struct<at:int,label:string>>")
    holds = F.arrays_overlap(w, F.array(*[F.lit(t) for t in prefix])) if prefix else F.lit(False)
    marked = F.transform("lw", lambda ws, i: F.struct(i.alias("block"), ws.alias("ws")))
    blocks = F.when(holds, F.filter(marked, lambda b: F.arrays_overlap(b["ws"], F.array(*[F.lit(t) for t in prefix])))) \
        if prefix else F.lit(None).cast("array<struct<block:int,ws:array<string>>>")
    placed = F.flatten(F.transform("lw", lambda ws, i: F.transform(ws, lambda t: F.struct(i.alias("line"), t.alias("w")))))
    spots = F.transform(placed, lambda s, i: F.struct(i.alias("at"), s["line"].alias("line"), s["w"].alias("w")))
    spots = F.when(holds & (F.size("lw") > 1), F.filter(spots, lambda s: s["w"].isin(order))) \
        if prefix and wrapped else F.lit(None).cast("array<struct<at:int,line:int,w:string>>")
    # One narrow row per document; the written row id stays the same in every later pass.
    rows = cut_lineage(lines.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", F.size("words").cast("bigint").alias("n_words"),
        F.when(ends, _base_places(w)).otherwise(empty).alias("base"), blocks.alias("blocks"), spots.alias("spots")))
    if not shape:
        none = F.array().cast("array<struct<label:string,block:int,containment:double,confirmed:boolean>>")
        return rows.select("doc_id", "n_words", "base", none.alias("matches"))

    index = spark.createDataFrame(  # template prefix tokens: as many rows as the templates have words
        [(t, label, p, len(ts), need, ts, window_words(templates[label], threshold), must.get(label, []))
         for label, ts, need in shape for p, t in enumerate(ts[: len(ts) - need + 1])],
        "token string, label string, tpos int, tn int, need int, ttokens array<string>, win int, must array<string>")
    blocks = rows.select("rid", F.explode("blocks").alias("b")).select(
        "rid", F.col("b.block").alias("block"), F.filter("b.ws", lambda t: t.isin(order)).alias("ws"))
    if wrapped:  # the document as one block, known by the line -1
        blocks = blocks.unionAll(rows.filter(F.col("spots").isNotNull()).select("rid", F.lit(-1), F.col("spots.w")))
    blocks = blocks.select("rid", "block", F.array_sort(F.array_distinct("ws"), lambda a, b: ranks[a] - ranks[b]).alias("ts"))
    tokened = blocks.select("rid", "block", "ts", F.size("ts").alias("bn"), F.posexplode("ts").alias("bpos", "token"))
    pairs = tokened.join(index, "token").filter(
        (F.col("bn") >= F.col("need")) & (F.col("bpos") <= F.col("bn") - F.col("need"))) \
        .groupBy("rid", "block", "label").agg(
            F.min(F.struct("bpos", "tpos", "bn", "tn", "need", "ts", "ttokens", "win", "must")).alias("f")).select(
            "rid", "block", "label", "f.*") \
        .filter(F.least(F.col("bn") - F.col("bpos"), F.col("tn") - F.col("tpos")) >= F.col("need"))  # positional
    overlap = F.size(F.array_intersect("ts", "ttokens"))
    met = pairs.withColumn("o", overlap).filter(F.col("o") >= F.col("need")) \
        .withColumn("confirmed", F.size(F.array_except("must", "ts")) == 0)
    match = F.struct("label", "block", (F.col("o") / F.col("tn")).alias("containment"), "confirmed")
    if wrapped:
        met = cut_lineage(met.select("rid", "block", "label", "o", "tn", "need", "ttokens", "win", "must", "confirmed"))
        own = met.filter("block = -1").select("rid", "label", "tn", "need", "ttokens", "win", "must").join(rows.select("rid", "spots"), "rid")
        own = own.withColumn("own", F.filter("spots", lambda s: F.array_contains("ttokens", s["w"])))
        run = lambda s, i: F.array_distinct(F.transform(F.filter(
            F.slice("own", i + 1, F.col("win")), lambda u: u["at"] < s["at"] + F.col("win")), lambda u: u["w"]))
        runs = own.withColumn("runs", F.transform("own", lambda s, i: F.struct(run(s, i).alias("ws"), s["line"].alias("line")))) \
            .withColumn("confirmed", F.exists("runs", lambda x: (F.size(x["ws"]) >= F.col("need")) & (
                F.size(F.array_except("must", x["ws"])) == 0))) \
            .withColumn("best", F.array_max(F.transform("runs", lambda x: F.struct(
                F.size(x["ws"]).alias("o"), (-x["line"]).alias("before"))))) \
            .select("rid", "label", (-F.col("best.before")).alias("block"), F.col("best.o").alias("o"), "tn", "need", "confirmed") \
            .filter(F.col("o") >= F.col("need"))
        lines_of = met.filter("block >= 0").select("rid", match.alias("m"), F.lit(False).alias("run"))
        each = lines_of.unionAll(runs.select("rid", match.alias("m"), F.lit(True).alias("run")))
        met = each.groupBy("rid").agg(F.collect_list(F.when(~F.col("run"), F.col("m"))).alias("of_lines"),
                                      F.collect_list(F.when(F.col("run"), F.col("m"))).alias("of_runs"))
        more = F.filter("of_runs", lambda x: ~F.exists("of_lines", lambda y: (y["label"] == x["label"]) & (
            y["containment"] >= x["containment"]) & (y["confirmed"] | ~x["confirmed"])))
        found = met.select("rid", F.array_sort(F.concat("of_lines", more)).alias("found"))
    else:
        found = met.groupBy("rid").agg(F.array_sort(F.collect_list(match)).alias("found"))
    none = F.array().cast("array<struct<label:string,block:int,containment:double,confirmed:boolean>>")
    return rows.join(found, "rid", "left").select(
        "doc_id", "n_words", "base", F.coalesce("found", none).alias("matches"))


def license_digest(scan: DataFrame) -> DataFrame:
    """The contract's columns from :func:`scan_licenses`, and confirmed_labels (base ones and confirmed matches); score: 1 with
    a base phrase, else the largest containment found, else 0."""
    base, m = F.col("base"), F.col("matches")
    own = F.transform(base, lambda b: b["label"])
    return scan.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"),
        F.array_min(F.transform(base, lambda b: b["at"])).cast("bigint").alias("first_word"),
        F.array_max(F.transform(base, lambda b: b["at"])).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(own)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(own, F.transform(m, lambda x: x["label"])))), ",").alias("labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(own, F.transform(F.filter(m, lambda x: x["confirmed"]), lambda x: x["label"])))), ",")
        .alias("confirmed_labels"),
        F.when(F.size(base) > 0, F.lit(1.0)).otherwise(
            F.coalesce(F.array_max(F.transform(m, lambda x: x["containment"])), F.lit(0.0))).alias("score"))


def oracle(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL: every line, and every run of words from a template word on, against every template, with no filter."""
    must = REQUIRED if templates is None else {}
    templates = TEMPLATES if templates is None else templates
    listed = lambda xs: f"{xs!r}::VARCHAR[]"
    rows = ", ".join(f"('{k}', {len(v)}, {needed(len(v), threshold)}, {listed(v)}, {listed(must.get(k, []))}, {window_words(templates[k], threshold)})"
                     for k, v in template_tokens(templates).items())
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents),
w AS (SELECT rid, doc_id, regexp_extract_all(t, '{word}') AS ws, string_split(t, chr(10)) AS ls FROM d),
p AS (SELECT rid, unnest(range(len(ws))) AS i, ws FROM w),
b AS (SELECT rid, i, 'cc-by' AS label FROM p WHERE ws[i + 1] = 'cc' AND ws[i + 2] = 'by'
      UNION ALL SELECT rid, i, 'gpl' FROM p WHERE ws[i + 1] = 'general' AND ws[i + 2] = 'public' AND ws[i + 3] = 'license'
      UNION ALL SELECT rid, i, 'reserved' FROM p WHERE ws[i + 1] = 'all' AND ws[i + 2] = 'rights' AND ws[i + 3] = 'reserved'),
bg AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM b GROUP BY rid),
tm(label, tn, need, toks, must, win) AS (VALUES {rows}),
ln AS (SELECT rid, unnest(ls) AS line FROM w),
lw AS (SELECT rid, list_distinct(regexp_extract_all(line, '{word}')) AS lt FROM ln),
ml AS (SELECT rid, label, len(list_intersect(lt, toks)) / tn AS c, len(list_intersect(lt, must)) = len(must) AS sure FROM lw, tm
       WHERE len(list_intersect(lt, toks)) >= need),
sp AS (SELECT rid, label, i, ws[i + 1] AS t, tn, need, must, win FROM p JOIN tm ON list_contains(toks, ws[i + 1])),
may AS (SELECT rid, label FROM sp GROUP BY rid, label HAVING count(DISTINCT t) >= any_value(need)),
rn AS (SELECT x.rid, x.label, x.i, any_value(x.tn) AS tn, any_value(x.must) AS must, any_value(x.need) AS need, list(DISTINCT y.t) AS lt
       FROM sp x SEMI JOIN may USING (rid, label) JOIN sp y ON y.rid = x.rid AND y.label = x.label AND y.i BETWEEN x.i AND x.i + x.win - 1
       GROUP BY x.rid, x.label, x.i),
mr AS (SELECT rid, label, len(lt) / tn AS c, len(list_intersect(lt, must)) = len(must) AS sure FROM rn WHERE len(lt) >= need),
m AS (SELECT rid, label, max(c) AS c, bool_or(sure) AS sure FROM (SELECT * FROM ml UNION ALL SELECT * FROM mr) GROUP BY rid, label),
ba AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS s FROM (SELECT DISTINCT rid, label FROM b) GROUP BY rid),
aa AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS s FROM (SELECT rid, label FROM b UNION SELECT rid, label FROM m) GROUP BY rid),
ca AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS s FROM (SELECT rid, label FROM b UNION SELECT rid, label FROM m WHERE sure) GROUP BY rid),
mc AS (SELECT rid, max(c) AS c FROM m GROUP BY rid)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(bg.n_base, 0) AS BIGINT) AS n_base,
       CAST(bg.first_word AS BIGINT) AS first_word, CAST(bg.last_word AS BIGINT) AS last_word,
       coalesce(ba.s, '') AS base_labels, coalesce(aa.s, '') AS labels, coalesce(ca.s, '') AS confirmed_labels,
       CAST(CASE WHEN bg.n_base > 0 THEN 1 ELSE coalesce(mc.c, 0) END AS DOUBLE) AS score
FROM w LEFT JOIN bg USING (rid) LEFT JOIN ba USING (rid) LEFT JOIN aa USING (rid) LEFT JOIN ca USING (rid) LEFT JOIN mc USING (rid)"""
