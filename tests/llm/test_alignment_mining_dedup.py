"""Token alignment, hard-negative mining and repeated-passage removal against brute force."""

import hashlib
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from seatgrid.llm import hard_negatives, run_dedup, token_alignment
from seatgrid.llm.run_index import RunIndex
from tests.llm import data

# ------------------------------------------------------------------ run-length index


def _cat(xs):
    return np.frombuffer(b"".join(xs), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int64)


@pytest.mark.parametrize("seed", range(40))
def test_matching_statistics(seed):
    rng = random.Random(seed)
    length = rng.choice([7, 8, 10, 15, 20])
    letters = b"ab" if seed % 2 else bytes([0, 1, 255, 97])
    base = bytes(rng.choice(letters) for _ in range(60))
    xs = []
    for _ in range(rng.randint(1, 12)):
        a = rng.randint(0, 40)
        s = bytearray(base[a:a + rng.randint(1, 30)])
        for _ in range(rng.randint(0, 2)):
            s[rng.randrange(len(s))] = rng.choice(letters)
        xs.append(bytes(s))
    owner = np.array([rng.randint(0, 5) for _ in xs], np.int64)
    index = RunIndex(*_cat(xs), owner, length)
    patterns = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(6)] + xs
    got = {}
    for who, offset, n, place in index.stream(*_cat(patterns)):
        got |= {(w, o): (k, m) for w, o, k, m in zip(who, offset, n, index.least_owner(place), strict=True)}
    for w, p in enumerate(patterns):
        for o in range(len(p)):
            longest = max(k for k in range(length + 1) if k <= len(p) - o and any(p[o:o + k] in x for x in xs))
            assert got[w, o][0] == longest
            if longest == length:
                owners = [owner[j] for j, x in enumerate(xs) for i in range(len(x) - length + 1) if x[i:i + length] == p[o:o + length]]
                assert got[w, o][1] == (min(owners) if len(owners) > 1 else np.iinfo(np.int64).max)


# ------------------------------------------------------------------ repeated passages


def _removed(rows):
    n = run_dedup.LENGTH
    least = {}
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    for i, t in texts:
        if i is not None:
            for k in range(len(t) - n + 1):
                w = t[k:k + n]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        if i is not None:
            for k in range(len(t) - n + 1):
                if least[t[k:k + n]] < i:
                    gone[k:k + n] = b"\x01" * n
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def _passages(seed=3):
    rng = random.Random(seed)
    line = data.sentence(rng, 14)
    rows = []
    for i in range(60):
        parts = [data.sentence(rng, rng.randint(3, 30)) for _ in range(4)]
        if i % 2:
            parts.insert(rng.randint(0, 4), line)
        if i % 5 == 0:
            parts.append(line[:49])  # one byte short of a passage
        if i % 7 == 0:
            parts.append("ab" * 120)
        if i % 11 == 0:
            parts.append("x" * 300)
        rows.append((rng.randint(0, 200), "\n".join(parts), "en", "a", 0))
    return rows


def _got(df):
    return sorted(repr((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in df.collect())


def test_repeats_match_brute_force(spark):
    rows = data.documents() + _passages() + [(5, "", "en", "a", 0), (300, "y" * 50, "en", "a", 0), (301, "y" * 50, "en", "a", 0),
                                             (302, "y" * 49, "en", "a", 0), (303, "y" * 49, "en", "a", 0)]
    df = data.frame(spark, rows, extra=True)
    assert _got(run_dedup.remove_repeats(df)) == _removed(rows)


def test_hot_keys_are_cut_finer(spark):
    """One line in every text, with other words around it: its keys hold more segments than a task may get."""
    rng = random.Random(9)
    line = data.sentence(rng, 10)
    rows = [(i, f"{data.sentence(rng, 8)} {line} {data.sentence(rng, 8)}", "en", "a", 0) for i in range(80)]
    df = data.frame(spark, rows)
    assert _got(run_dedup.remove_repeats(df, most=5, indexed=500)) == _removed(rows)


def test_repeats_of_nothing(spark):
    assert run_dedup.remove_repeats(data.empty(spark)).collect() == []


# ------------------------------------------------------------------ hard negatives

VECTORS = "vec_id bigint, embedding array<float>, label int, score string, anchor string"


def _mined(rows):
    use = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], (lb + 1) % 10 if i % 7 == 0 else lb)
           for i, v, lb in rows if None not in (i, v, lb) and None not in v and np.isfinite(v).all()]
    out = []
    for a, (i, v, label) in enumerate(use):
        if i % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=False)), j, lb) for b, (j, w, lb) in enumerate(use) if b != a]
        pos = sorted((s, j) for s, j, lb in scored if lb == label)[:5]
        for s, j in pos:
            neg = sorted((t, k) for t, k, lb in scored if lb != label and 80 * -s <= 100 * -t <= 100 * -s)[:5]
            out += [repr((i, j, r + 1, k, -s, -t)) for r, (t, k) in enumerate(neg)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "big"), [(1, 1.0), (2, 1.0), (3, 1e6)])
def test_hard_negatives_match_brute_force(spark, seed, big):
    rng = random.Random(seed)
    centre = [rng.uniform(-1, 1) for _ in range(6)]
    rows = [(i * 5, [big * (c + rng.choice([-0.2, 0.0, 0.1, 0.2])) for c in centre], rng.randint(0, 3)) for i in range(400)]
    rows += [(5000 + 100 * k, [big * c for c in centre], 1) for k in range(6)]  # ties
    rows += [(100, [big * 0.5] * 6, 2), (100, [big * 0.5] * 6, 2), (None, centre, 1), (7, None, 1), (8, centre, None), (9, [None] * 6, 1),
             (200, [float("nan")] * 6, 1), (300, [float("inf")] * 6, 1), (-100, [-c for c in centre], 1), (400, [], 1), (500, [0.5], 1)]
    df = spark.createDataFrame([(i, v, lb, "x", "y") for i, v, lb in rows], VECTORS)
    got = hard_negatives.mine(hard_negatives.contract_rows(df), F.col("vec_id") % 100 == 0, chunk=150, block=4)
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in got.collect()) == _mined(rows)


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(hard_negatives.contract_rows(empty), F.col("vec_id") % 100 == 0).collect() == []


# ------------------------------------------------------------------ token alignment


def _aligned(rows):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    shown = {c: bytes([x]) for c, x in token_alignment.byte_alphabet().items()}

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    docs = []
    for i, text in rows:
        tokens = None
        if text:
            raw = (" " + text).encode()
            x = [(t, b"".join(shown[c] for c in a.id_to_token(t))) for t in a.encode(" " + text, add_special_tokens=False).ids]
            y = [(t, b_bytes(t)) for t in b.encode(text)]
            if b"".join(v for _, v in x) == raw == b"".join(v for _, v in y):
                spans = []
                for side in (x, y):
                    at, out = 0, []
                    for t, v in side:
                        out.append((t, at, at + len(v)))
                        at += len(v)
                    spans.append(out)
                tokens = spans
        docs.append((i, tokens))
    held, linked = {}, []
    for _, tokens in docs:
        pairs = [(x[0], y[0]) for x in tokens[0] for y in tokens[1] if x[1] < y[2] and y[1] < x[2]] if tokens else []
        linked.append(pairs)
        for p in set(pairs):
            held[p] = held.get(p, 0) + 1
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for (i, tokens), pairs in zip(docs, linked, strict=True):
        if not tokens:
            out.append(repr((i, 0, 0, 0, 0, 0, 0, "")))
            continue
        ends = sorted({s[2] for s in tokens[0]} & {s[2] for s in tokens[1]})
        parts, low = [], 0
        for e in ends:
            sides = [",".join(str(s[0]) for s in side if low < s[2] <= e) for side in tokens]
            parts.append("|".join(sides))
            low = e
        out.append(repr((i, len(tokens[0]), len(tokens[1]), len(ends), len(pairs), sum(held[p] == most[p[0]] for p in pairs),
                         sum(held[p] for p in pairs), hashlib.sha256(";".join(parts).encode()).hexdigest())))
    return sorted(out)


ODD = ["é漢\U0001f600x a", " a  b\n\tc ", "a▁b", "<|endoftext|> and </s> <s> <unk> <0x41>", " ​ zero\x00byte", "ﬁ ligature ½", "日本語の文章 と English",
       "👩‍👩‍👧‍👦 family", "é combining", "\r\n\r\n", " ", "▁", "x" * 300]


@pytest.mark.parametrize("held", [token_alignment.HELD, 300])
def test_alignment_matches_brute_force(spark, held):
    rng = random.Random(4)
    letters = string.ascii_letters + "  \n.é漢ßя😀▁"
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, "".join(rng.choice(letters) for _ in range(rng.randint(1, 80)))) for i in range(60)]
    rows += [(r[0], r[1]) for r in data.documents(20) if len(r[1] or "") < 5000] + [rows[0], (None, "no id")]
    df = data.frame(spark, [(i, t, "en", "a", 0) for i, t in rows], extra=True).drop("n_chars")
    got = token_alignment.align(df, held=held)
    assert sorted(repr(tuple(r)) for r in got.collect()) == _aligned(rows)


def test_alignment_of_nothing(spark):
    assert token_alignment.align(data.empty(spark)).collect() == []


def test_spans_are_refined():
    ends = np.array([2, 3, 5])
    assert token_alignment.refine(np.array([2, -1, 5]), ends).tolist() == [2, 3, 5]


def test_spans_that_disagree_with_the_decoded_bytes_fail():
    assert token_alignment.refine(np.array([-1, 3, -1, -1, 7]), np.array([1, 3, 4, 5, 7])).tolist() == [1, 3, 4, 5, 7]
    with pytest.raises(ValueError):
        token_alignment.refine(np.array([2, -1, 6]), np.array([2, 3, 5]))


@pytest.mark.parametrize("side", ["a_len", "b_len"])
def test_ends_come_from_the_spans(side):
    t = token_alignment.Tokenizers(f"{token_alignment.FOLDER}/{token_alignment.A_FILE}", f"{token_alignment.FOLDER}/{token_alignment.B_FILE}")
    a_ids, a_ends, b_ids, b_ends = t.encode(["plain words and \u6f22\u5b57"])[0]
    assert a_ends[-1] == b_ends[-1] == len(" plain words and \u6f22\u5b57".encode())
    t.a_words.clear(), t.b_words.clear()
    setattr(t, side, getattr(t, side) + 1)  # lengths that the spans contradict
    with pytest.raises(ValueError):
        t.encode(["plain words"])


def test_words_between_spaces_serve_both_tokenizers():
    """One look-up for both where white space allows it; every text as its tokenizers have it whole."""
    t = token_alignment.Tokenizers(f"{token_alignment.FOLDER}/{token_alignment.A_FILE}", f"{token_alignment.FOLDER}/{token_alignment.B_FILE}")
    t.encode(["It's plain, isn't it?\nYes: 12 words."])
    assert set(t.both_words.place) == {"It's", "plain,", "isn't", "it?\nYes:", "12", "words."} and not t.a_words.place and not t.b_words.place
    rng = random.Random(7)
    texts = ["a\n b", "a \nb", "\na", "a\n", "a\n\n", " a", "a ", "a\x85 b", "a\xa0 b", "a \x1cb", "a\t b", "a's 'll b", "'s", "é' d"]
    texts += ["".join(rng.choice("ab'sté1.  \n\n\t\xa0\x1f") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    for text, found in zip(texts, t.encode(texts), strict=True):
        a, b = t.a.encode(f" {text}", add_special_tokens=False).ids, t.b.encode(text)
        if found is None:  # B changes some white space
            assert b"".join(t.b_bytes[i] for i in b) != f" {text}".encode()
        else:
            assert (found[0].tolist(), found[2].tolist()) == (a, b), repr(text)
            assert found[1].tolist() == np.cumsum([len(t.a_bytes[i]) for i in a]).tolist()
            assert found[3].tolist() == np.cumsum([len(t.b_bytes[i]) for i in b]).tolist()
