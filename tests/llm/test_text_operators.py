"""Quality rules, license scans and personal data against plain Python."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from seatgrid.llm import license_scan, pii, quality_rules

from . import data

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(text):
    words = SPACE.findall(text or "")
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i:i + 5]), []).append(i)
    covered = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


@pytest.mark.parametrize("text", ["", "a b c d e", "a b c d e a b c d e", "x " * 30, "l\nl\n\n \nl\nm", "a#b $$ |\n<x>", "one two three four five six one two three four five"])
def test_counts(text):
    c = quality_rules.text_counts(text)
    assert (c["n_words"], c["word_chars"], c["n_symbols"], c["n_dup_lines"], c["n_repeat_words"]) == counts(text)


def junky(n=300):
    rows = data.documents(n)
    for i in range(20):
        junk = " ".join(w + "###" for w in rows[i][1].split())
        rows.append((5000 + i, junk, "en", "a", len(junk)))
    return rows


def test_quality_rules_reject_outliers(spark):
    rows = junky()
    got = quality_rules.judge(data.frame(spark, rows, extra=True)).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["n_words"], r["word_chars"]): r for r in got}
    for doc_id, text, *_ in rows:
        n, chars, symbols, dup, repeat = counts(text)
        r = by[doc_id, n, chars]
        assert (r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (symbols, dup, repeat)
        assert r["base_failed"] == (n < 10 or 100 * repeat > 20 * n)
        assert r["kept"] == (not r["base_failed"] and not (doc_id or 0) >= 5000)


def test_quality_rules_small_and_empty_tables(spark):
    few = quality_rules.judge(data.frame(spark, data.documents(20)))
    assert all(r["kept"] != r["base_failed"] and r["distance"] is None for r in few.collect())
    assert quality_rules.judge(data.empty(spark)).count() == 0


def test_quality_stage_keeps_columns_and_repeats(spark):
    docs = data.frame(spark, junky(), extra=True)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert kept.filter("doc_id = 3").count() == 3
    assert kept.filter("doc_id >= 5000").count() == 0


def _numpy_mcd(x, share=quality_rules.SHARE, steps=quality_rules.STEPS):
    """The estimate's rule over a whole-number matrix in plain numpy: both starts, the same bins and steps."""
    p, scale, floor = x.shape[1], quality_rules.SCALE, np.diag(np.square(quality_rules.FLOOR))

    def fit(mean, cov, widen):
        cov = cov * widen + floor
        return np.linalg.slogdet(cov)[1], mean, np.linalg.inv(cov)

    def plain(rows, widen):
        v = rows / scale
        return fit(v.mean(axis=0), v.T @ v / len(v) - np.outer(v.mean(axis=0), v.mean(axis=0)), widen)

    middle = lambda v: np.sort(v, axis=0)[-(-len(v) // 2) - 1]
    m = middle(x)
    a = middle(np.abs(x - m))
    starts = [plain(x, 1.0), fit(m / scale, np.diag(np.round(2.198 * a * a) / scale**2), 1.0)]
    out = []
    for f in starts:
        for _ in range(steps):
            d = distances(x, f)
            b = np.minimum(quality_rules.MOST_BIN, np.floor(16 * np.log2(1 + 256 * d))).astype(int)
            need = np.ceil(share * len(x))
            sizes = np.bincount(b)
            last = np.flatnonzero(np.cumsum(sizes) - sizes < need)
            f = plain(x[np.isin(b, last)], quality_rules._consistency(share))
        out.append(f)
    return min(out, key=lambda f: f[0])


def distances(x, f):
    v = x / quality_rules.SCALE - f[1]
    return np.maximum(np.einsum("ni,ij,nj->n", v, f[2], v), 0)


def numpy_verdicts(docs):
    """(doc_id, n_words, kept, distance) of every row by the same starts and steps in numpy."""
    stats = [r.asDict() for r in quality_rules.statistics(docs).collect()]
    groups = {}
    for r in stats:
        r["x"] = np.array([r[f"x{i}"] for i in range(6)], float)
        r["g"] = [("s", r["lang"], r["source"]), ("l", r["lang"]), ("a",)]
        for g in () if r["base_failed"] else r["g"]:
            groups.setdefault(g, []).append(r["x"])
    fits = {g: _numpy_mcd(np.array(v)) for g, v in groups.items() if len(v) >= quality_rules.LEAST}
    out = []
    for r in stats:
        g = next((g for g in r["g"] if g in fits), None)
        d = distances(r["x"][None], fits[g])[0] if g else None
        out.append((r["doc_id"], r["n_words"], not r["base_failed"] and not (d is not None and d > quality_rules.CUTOFF), d))
    return out


@pytest.mark.parametrize("heavy", [quality_rules.HEAVY, 2])
def test_verdicts_match_numpy(spark, heavy, monkeypatch):
    """Distances and verdicts of every row against the same starts and steps in numpy; with few heavy groups too."""
    monkeypatch.setattr(quality_rules, "HEAVY", heavy)
    rows = junky()
    docs = data.frame(spark, rows)
    want = numpy_verdicts(docs)
    got = [(r["doc_id"], r["n_words"], r["kept"], r["distance"]) for r in quality_rules.judge(docs).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    for x, y in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert x[:3] == y[:3]
        assert (x[3] is None) == (y[3] is None) and (x[3] is None or abs(x[3] - y[3]) <= 0.05 * max(1, y[3]))


LICENSED = [
    (1, "Released under the MIT License.", None), (2, "intro\nLICENSED under the Apache License, Version 2.0.\nmore", None),
    (3, "CC BY\nand cc by cc\nby", None), (4, "All rights reserved. all RIGHTS\nreserved", None),
    (5, "the MIT", None), (6, "under license of the released mit", None), (7, None, None), (None, "GNU General Public License", None),
    (8, "", None), (8, "", None), (9, "licensed under cc by nc 4 0 " * 200, None),
    (10, "this work is licensed\nunder the gnu general public license version 3", None), (11, "général public license", None),
]


def brute_licenses(text):
    t = (text or "").translate(LOWER)
    words = ALNUM.findall(t)
    base = [(i, label) for phrase, label in license_scan.BASE_PHRASES.items() for i in range(len(words))
            if words[i:i + len(phrase.split())] == phrase.split()]
    labels, score = {x for _, x in base}, 1.0 if base else 0.0
    for label, tokens in license_scan.template_tokens(license_scan.TEMPLATES).items():
        for line in t.split("\n"):
            o = len(set(tokens) & set(ALNUM.findall(line)))
            if 10 * o >= 8 * len(tokens):
                labels.add(label)
                score = max(score, o / len(tokens))
    at = [i for i, _ in base]
    return (len(words), len(base), min(at, default=None), max(at, default=None),
            ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), 1.0 if base else score)


def test_license_scan_is_exact(spark):
    rows = [(i, t, "en", "a", 0) for i, t, _ in LICENSED] + data.documents()
    got = license_scan.license_digest(license_scan.scan_licenses(data.frame(spark, rows, extra=True))).collect()
    want = sorted(repr((r[0], *brute_licenses(r[1]))) for r in rows)
    assert sorted(repr((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]))
                  for r in got) == want


WRAPPED = [
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"),
    ("bsd", " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the\n"
            " * following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy"),
    ("gpl,gpl-3.0", "this work is licensed\nunder the gnu general public license version 3"),
    ("mit", "intro words\nReleased\n\nunder the\nMIT License."), ("mit", "Released under the MIT\nLicense."),
    ("", "released\n" + "some other words of the text\n" * 3 + "under\n" + "and more of the other words\n" * 3 + "mit license"),
]


def brute_runs(text):
    """Labels and best containment of lines and of runs of words over line ends."""
    _, n_base, *_, labels, score = brute_licenses(text)
    labels, words = set(labels.split(",")) - {""}, ALNUM.findall((text or "").translate(LOWER))
    for label, tokens in license_scan.template_tokens(license_scan.TEMPLATES).items():
        n = -(-10 * len(ALNUM.findall(license_scan.TEMPLATES[label].lower())) // 8)
        o = max((len(set(tokens) & set(words[i:i + n])) for i in range(len(words))), default=0)
        if 10 * o >= 8 * len(tokens):
            labels.add(label)
            score = max(score, o / len(tokens))
    return ",".join(sorted(labels)), 1.0 if n_base else score


def test_license_scan_reads_over_line_ends(spark):
    assert [brute_runs(t)[0] for _, t in WRAPPED] == [x for x, _ in WRAPPED]
    rng = random.Random(4)
    broken = [re.sub(r"[ ]", lambda _: rng.choice([" ", " ", "\n", " extra "]), t) for t in license_scan.TEMPLATES.values() for _ in range(6)]
    texts = [t for _, t in WRAPPED] + broken + [t for _, t, _ in LICENSED]
    rows = [(7000 + i, t, "en", "a", 0) for i, t in enumerate(texts)] + data.documents()
    scan = license_scan.scan_licenses(data.frame(spark, rows, extra=True), wrapped=True)
    got = license_scan.license_digest(scan).collect()
    assert sorted(repr((r["doc_id"], r["labels"], r["score"])) for r in got) == sorted(repr((r[0], *brute_runs(r[1]))) for r in rows)
    at = {r["doc_id"]: [(m["label"], m["block"], m["containment"]) for m in r["matches"]] for r in scan.filter("doc_id in (7004, 7005)").collect()}
    assert at == {7004: [("mit", 1, 1.0)], 7005: [("mit", 0, 0.8), ("mit", 0, 1.0)]}


OTHERS = ["Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0.", "Released under the Apache License.",
          "This work is licensed under the GNU General Public License, version 2.", "Licensed under the Apache License, Version 1.0.",
          "This work is licensed\nunder the GNU General Public License, version 2.", "Released under\nthe Apache License."]


def test_license_scan_confirms_no_other_license(spark):
    """Every block at the threshold is a match; only those with the words that tell licenses apart are confirmed."""
    own = ["Licensed under the Apache License, Version 2.", "Released under MIT License.", "work is licensed under the GNU General\nPublic License, version 3"]
    rows = [(7000 + i, t, "en", "a", 0) for i, t in enumerate(OTHERS + own)]
    for wrapped in (False, True):
        scan = license_scan.scan_licenses(data.frame(spark, rows), wrapped=wrapped).orderBy("doc_id").collect()
        got = [",".join(sorted({m["label"] for m in r["matches"] if m["confirmed"]})) for r in scan]
        assert got == [""] * len(OTHERS) + ["apache-2.0", "mit", "gpl-3.0" if wrapped else ""]
        found = [",".join(sorted({m["label"] for m in r["matches"]})) for r in scan]
        assert found == ["cc-by-nc-4.0", "cc-by-nc-4.0", "mit", "gpl-3.0", "apache-2.0", "gpl-3.0" if wrapped else "", "mit" if wrapped else "",
                         "apache-2.0", "mit", "gpl-3.0" if wrapped else ""]


def test_license_oracle_agrees_on_blocks_near_the_threshold(spark):
    rng = random.Random(6)
    texts = [t for _, t in WRAPPED] + [t for _, t, _ in LICENSED] + OTHERS
    for t in license_scan.TEMPLATES.values():
        words = t.split()
        for _ in range(12):  # words dropped, changed and broken over lines
            kept = [w if rng.random() < 0.9 else rng.choice(["", "other"]) for w in words]
            texts.append("".join(w + rng.choice([" ", " ", " ", "\n"]) for w in kept) + rng.choice(["", " version 2", "\nmit"]))
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)] + [r for r in data.documents() if r[0] is not None]
    got = license_scan.license_digest(license_scan.scan_licenses(data.frame(spark, rows, extra=True), wrapped=True))
    documents = pa.Table.from_pylist([{"doc_id": r[0], "text": r[1]} for r in rows])  # noqa: F841
    cols = sorted(got.columns)
    want = duckdb.sql(license_scan.oracle()).project(", ".join(cols)).fetchall()
    assert sorted(repr(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(map(repr, want))
    assert len({r for r in want if r[cols.index("labels")] != r[cols.index("confirmed_labels")]}) > 5


def test_license_scan_empty(spark):
    assert license_scan.license_digest(license_scan.scan_licenses(data.empty(spark))).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(text):
    t, out = text or "", []
    out += [("email", m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(t):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(t) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


PERSONAL = [
    "write to a@b.co, x@y@z.org a@b.c@d.e _q@w.x.y@m.no a@b .. @x.y", "hosts 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 007.0.0.255 1.2.3",
    "card 4111111111111111 4111-1111 1111-1111 5500 0000 0000 0004x 4111111111111112 4111  1111", "+1 (499) 555-6503%%% +12 +1234567890123456 +49 30 1234567.",
    "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, ssn 123-45-6789 key \"a1b2c3d4e5f6a1b2c3d4e5f6\"", "é 1.1.1.1 漢 \U0001f600 z@y.xx",
    "1" * 5000 + "." + "2" * 5000, "a" * 20000 + "@", "+" * 1000 + "1 2", None, "",
]


@pytest.mark.parametrize("text", PERSONAL)
def test_pii_base_is_exact(text):
    assert [s for s in pii.proposals(text or "") if s[0] in pii.BASE_KINDS] == brute_pii(text)


def test_pii_validators():
    kinds = [s["kind"] for s in pii.scored(PERSONAL[4])]
    assert kinds.count("iban") == 2 and kinds.count("ssn") == 1 and kinds.count("secret") == 1
    assert not any(s["kind"] == "iban" for s in pii.scored("IBAN DE88 3704 0044 0532 0130 00"))
    assert not any(s["kind"] == "ssn" for s in pii.scored("part 123-45-6789"))
    near, far = pii.scored("call +1 499 555 6503")[0], pii.scored("order +1 499 555 6503")[0]
    assert near["score"] > far["score"]


IBANS = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32",
         "NO9386011117947", "MT84MALT011000012345MTLCAST001S"]


@pytest.mark.parametrize("iban", IBANS)
@pytest.mark.parametrize("after", ["", " BIC COBADEFF", " 2024", " I wrote", " A", " COBADEFFXXX 12 AND MORE OF THE SAME LINE", ", 5", " x",
                                   " XY12 3456 7890 1234 5678"])
def test_pii_iban_before_capitals_and_digits(iban, after):
    for before in ("", "IBAN ", "AB12 3456 7890 1235 "):
        found = [(before + iban + after)[b:e] for k, b, e in pii.proposals(before + iban + after) if k == "iban"]
        assert found == [iban]


def test_pii_ibans_in_a_row():
    text = " ".join(IBANS)
    assert [text[b:e] for k, b, e in pii.proposals(text) if k == "iban"] == IBANS
    assert list(pii.ibans("DE89370400440532013000COBADEFF DE88370400440532013000 2024 DE89370400440532013000é")) == [(59, 81)]
    assert list(pii.ibans("AB12" * 50_000 + " AB12 3456" * 50_000)) == list(pii.ibans("AB12 3456" + " AB12 3456" * 50_000))


@pytest.mark.parametrize("text, found", [
    ("123-45-6789 (SSN)", True), ("123-45-6789 is my social security number", True), ("123-45-6789", False),
    ("123-45-6789 " + "x" * 39 + " ssn", False), ("123-45-6789 " + "x " * 18 + "security", True),
    ("security " + "x " * 17 + "123-45-6789", True), ("reorder ssn " + "x " * 16 + "123-45-6789", True),
    ("SSN 123-45-6789, order 5", True), ("order 123-45-6789 (SSN)", False), ("a" * 200_000 + " 123-45-6789 " + "b" * 200_000, False),
])
def test_pii_context_on_both_sides(text, found):
    assert any(s["kind"] == "ssn" for s in pii.scored(text)) == found


def test_pii_digest(spark):
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(PERSONAL)] + data.documents()
    got = pii.pii_digest(pii.find_pii(data.frame(spark, rows, extra=True))).collect()
    want = []
    for doc_id, text, *_ in rows:
        b = brute_pii(text)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in b)
        want.append(repr((doc_id, *[sum(x[0] == k for x in b) for k in pii.BASE_KINDS], hashlib.sha256(joined.encode()).hexdigest())))
    assert sorted(repr((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"])) for r in got) == sorted(want)
    assert pii.pii_digest(pii.find_pii(data.empty(spark))).count() == 0
