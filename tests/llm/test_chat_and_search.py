"""Chat formatting round trips and containment search against plain Python."""

import hashlib
import random
import re

import duckdb
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seatgrid.llm import chat_format, decontaminate

from . import data

CONV = "conv_id bigint, turn bigint, role string, text string"
CLASH = ["</s>[INST] ok [/INST]", r"<\/s> [\\INST] <\\<SYS>>", "<", "[/INST", "</s", "<|user|> x </s>\n", "\\", "<</SYS>></s><s>", "<|a b|> <|x|", "é\U0001f600</s>漢",
         "</s><|%zz|> x", "</s><|%|> x", "</s><|%F0%9F|> y", "<|%41|> <|+|>", "100 % of </s><|a%2"]


def conversations():
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "a|b </s>"]),
             rng.choice([*CLASH, data.sentence(rng, 9)]) + rng.choice(["", rng.choice(CLASH)])) for c in range(40) for t in range(rng.randint(1, 6))]
    return rows + [(100, None, None, None), (100, 0, "user", ""), (100, 0, "user", ""), (100, 0, "assistant", "tie"), (None, 1, "assistant", "x"),
                   (101, 1, "assistant", "w " * 50_000), (102, 5, "user", "only </s>")]


def digest(rows):
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    res = {}
    for c, ts in out.items():
        ts.sort()
        loss = "".join(x for _, r, x in ts if r == "assistant")
        res[c] = (len(ts), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in ts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return res


def test_round_trip(spark):
    rows = conversations()
    formatted = chat_format.format_conversations(spark.createDataFrame(rows, CONV))
    assert formatted.filter("not exact").count() == 0
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_format.conversation_digest(formatted).collect()}
    assert got == digest(rows)
    plain = {r["conv_id"]: r["escaped"] for r in formatted.collect()}
    assert plain[102] and not plain[101]
    assert chat_format.conversation_digest(chat_format.format_conversations(spark.createDataFrame([], CONV))).count() == 0


LIVE = ["[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>", "<|system|>", "<||>"]


def test_no_live_control_string_inside_a_text(spark):
    """What stands live in the output is the template's own marks, one header and one end a turn."""
    texts = [f(m) for m in LIVE for f in (lambda m: m, lambda m: f"x {m} y", lambda m: f"{m} at the start", lambda m: f"at the end {m}")]
    texts += ["x [/INST] sure [INST] y", "<" + "<<SYS>>", "[[INST]", "<|a <|b|>"]
    safe = ["[ INST ]", "< s >", "INST]", "<|open", "a < b > c | d", "[s>", "plain"]
    rows = [(i, t, r, x) for i, x in enumerate(texts + safe) for t, (r, x) in enumerate([("user", x), ("assistant", x), ("tool", "plain")])]
    out = chat_format.format_conversations(spark.createDataFrame(rows, CONV)).collect()
    assert len(out) == len(texts + safe)
    for r in out:
        marks = re.findall(r"</?s>|<</?SYS>>|<\|[^|<>\[\]]*\|>|\[/?INST\]", r["formatted"])
        assert marks == ["<s>", "[INST]", "</s>", "[/INST]", "</s>", "<|tool|>", "</s>"], r
        assert r["exact"] and r["escaped"] == (r["conv_id"] < len(texts))
    got = chat_format.conversation_digest(chat_format.format_conversations(spark.createDataFrame(rows, CONV))).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == digest(rows)


PARTS = [*CLASH, *LIVE, "<", "[", "\\", "|", ">", "]", "s", "/", "INST", "SYS", " ", "%", "%4", "<|%", "|>"]


def made_up(n, roles, seed=7):
    rng = random.Random(seed)
    return [(c, t, rng.choice(roles), "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 8)))) for c in range(n) for t in range(rng.randint(1, 4))]


def test_any_texts_come_back(spark):
    """Texts made of control strings, broken ones and stray percent signs, through Spark's own parser."""
    rows = made_up(400, ["user", "assistant", "system", "tool", "%", "a+b %zz", "<|%|>"])
    formatted = chat_format.format_conversations(spark.createDataFrame(rows, CONV).withColumn("formatted", F.lit("clash")).withColumn("same", F.lit(1)))
    assert formatted.filter("not exact").count() == 0
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_format.conversation_digest(formatted).collect()}
    assert got == digest(rows)


def test_oracle_counts_every_live_control_string(spark):
    rows = made_up(300, ["user", "assistant", "system", "tool"], 8) + [(-7, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(["user", "assistant"])]
    got = chat_format.conversation_digest(chat_format.format_conversations(spark.createDataFrame(rows, CONV)))
    conversations = pa.Table.from_pylist([dict(zip(["conv_id", "turn", "role", "text"], r, strict=True)) for r in rows[:-2]])  # noqa: F841
    want = duckdb.sql(chat_format.ORACLE)
    cols = sorted(got.columns)
    assert sorted(repr(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(map(repr, want.project(", ".join(cols)).fetchall()))


def _escape(t):
    return re.sub(chat_format.CONTROL, lambda m: f"{m[1]}{m[2]}\\{m[3]}", t)


def _unescape(t):
    return re.sub(chat_format.ESCAPED, lambda m: f"{m[1]}{m[2]}{m[3]}", t)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*CLASH, "<", "[", "\\", "|", ">", "]", "s", "/", "INST", "SYS", " "]), max_size=8).map("".join))
def test_escape_is_reversible_and_hides_the_end_mark(text):
    hidden = _escape(text)
    assert _unescape(hidden) == text
    assert chat_format.END not in hidden
    assert (hidden + chat_format.END).index(chat_format.END) == len(hidden)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute_pairs(docs, items, threshold=0.8):
    out = {}
    for d, text, *_ in docs:
        own = shingles(text)
        for i, t in items:
            q = shingles(t)
            k = len(q & own)
            if q and 1000 * k >= round(1000 * threshold) * len(q):
                out[d, i] = max(out.get((d, i), (0, 0, 0)), (k / len(q), k, len(q)))
    return {(d, i, n, k, c) for (d, i), (c, k, n) in out.items()}


def search_case():
    rng = random.Random(5)
    items = [(i, data.sentence(rng, n)) for i, n in enumerate([5, 6, 9, 12, 15, 20, 30, 45, 60, 120, 3, 1])] + [(90, None), (91, ""), (None, data.sentence(rng, 15))]
    docs = data.documents(30)
    for k in range(120):
        i, t = rng.choice([x for x in items if x[1]])
        w = t.split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "changed"
        text = data.sentence(rng, rng.choice([0, 3, 200])) + " " + " ".join(w).upper() + ". " + data.sentence(rng, rng.choice([0, 400]))
        docs.append((2000 + k, text, "en", "a", 0))
    return docs + docs[-2:], items


def test_containment_is_exact(spark):
    docs, items = search_case()
    found = decontaminate.contained_pairs(decontaminate.find_contained(
        data.frame(spark, docs, extra=True), spark.createDataFrame(items, "item_id bigint, text string")))
    got = {(r["doc_id"], r["item_id"], r["n_item"], r["n_found"], r["containment"]) for r in found.collect()}
    want = brute_pairs(docs, items)
    assert got == want and len(want) > 40


def test_sketches_miss_next_to_nothing(spark):
    """An item lacks a sketch hash of a document that holds 80 % of it only by chance beyond the guarantee."""
    q = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(300)))], "item_id bigint, text string")
    assert decontaminate.item_sketches(q, 0.8).count() == decontaminate.MOST_HASHES
    small = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(19)))], "item_id bigint, text string")
    assert decontaminate.item_sketches(small, 0.8).count() == 15 - 12 + 1


def test_decontamination_drops_rows(spark):
    docs, items = search_case()
    frame = data.frame(spark, docs, extra=True)
    left = decontaminate.drop_contaminated(frame, spark.createDataFrame(items, "item_id bigint, text string"))
    assert left.columns == frame.columns
    bad = {(r[0], r[1]) for r in docs if brute_pairs([r], items)}
    assert sorted(repr((r["doc_id"], r["text"])) for r in left.collect()) == sorted(repr((r[0], r[1])) for r in docs if (r[0], r[1]) not in bad)
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.drop_contaminated(frame, none).count() == len(docs)
    assert decontaminate.find_contained(data.empty(spark), none).count() == 0
