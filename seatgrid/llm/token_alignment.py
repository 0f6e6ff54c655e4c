"""Cross-tokenizer alignment: two tokenizers' tokens of one text, cut where both end a token.

A is a byte-level BPE (``tokenizers`` file) over space + text, B a sentencepiece model over the text (it adds the space itself).

1. Spans: A's tokens come with character offsets, B's with the spans of sentencepiece's proto (its offset mapping). Both are coarse cuts: a
   character of several bytes that A splits gives all its tokens the same offsets, and B's byte-fallback pieces have empty
   spans but for the last one. Cuts inside a character are put after the known cut before them by the tokens' decoded bytes; where the spans
   and the decoded bytes of a token disagree the job fails.
   A never joins words of its pattern, and B no pieces before a space, so texts are split there and each different word is put through
   the tokenizer once, the new ones of a batch together. Where no other white space is next to a space, what lies between spaces is a
   word of both and looked up once. For A, texts with characters beyond ``LATIN`` are one word (their
   classes may differ between Unicode versions).
2. Groups end where a token of A and one of B end at the same byte. A link is a pair of token occurrences whose byte ranges
   overlap: between two neighbouring ends, of either tokenizer, exactly one pair.
3. A pair of ids counts the documents that hold it linked. Tasks work on blocks of documents of about ``HELD`` links:
   a block's distinct pairs with their documents go to the corpus-wide counts, every A id gets its highest count, and each
   block gets back the counts of its own pairs. So neither the pairs nor the counts are ever in one place, and
   a pair that every document holds is one row per block.

A text that is null, empty, or whose joined A or B bytes differ from space + text has no tokens: zeros and an empty
string. Special tokens' strings inside texts are plain text. Repeated rows, and rows that repeat a doc_id, are documents
of their own. Texts are worked on one by one, so memory is bounded by the longest one. Only ``doc_id`` and
``text`` are read. An empty table gives an empty result. The vocabulary files are read on the executors from ``folder``.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatgrid.llm.common import small_batches
from seatgrid.session import cut_lineage

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
HELD = 2_000_000  # links of a block
ENCODED = 200_000  # bytes of texts encoded at a time
WORDS = 500_000  # different words kept in a worker, of each tokenizer
TOKENS = 8 * WORDS  # and their tokens
LATIN = "\u024f"
OTHER_SPACES = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"  # up to LATIN, but for space and line feed
SPACE = "▁"  # as B writes it
# Fixed value: the words of a byte-level vocabulary.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: what B, which joins no pieces before a space, works on apart: spaces with what comes after, the text's last spaces with the word before.
SPACED = r" ( *[^ ]+(?: +\Z)?| *)"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the
    others for the characters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class _Column:
    """An array that is added to."""

    def __init__(self):
        self.n, self.held = 0, np.zeros(1 << 12, np.int64)

    def extend(self, more: np.ndarray) -> None:
        n = self.n + len(more)
        if n > len(self.held):
            self.held = np.append(self.held[:self.n], np.zeros(2 * n - self.n, np.int64))
        self.held[self.n:n] = more
        self.n = n


class _Places(dict):
    """A number for each different word, in the order they come; ``new`` are those that came since it was last emptied."""

    def __init__(self):
        self.new = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class _Tokens:
    """A tokenizer's tokens of words: ids and how many bytes each covers. ``tokens`` gives, of words, the order it took them in, the
    ids and ends of all their tokens one after another, and whether each word's tokens have its bytes, with ``added`` ones before them."""

    def __init__(self, tokens, added: int = 0):
        self.tokens, self.added = tokens, added
        self.clear()

    def clear(self) -> None:
        self.ids, self.covers, self.starts, self.counts, self.whole = [_Column() for _ in range(5)]

    def add(self, new: list[str]) -> None:
        order, ids, ends, whole = self.tokens(new)
        last = np.searchsorted(ends, np.cumsum(np.fromiter((len(w.encode()) for w in new), np.int64, len(new))[order] + self.added))
        counts = np.diff(last, prepend=-1)
        back = np.empty(len(new), np.int64)
        back[order] = np.arange(len(new))
        for column, more in ((self.starts, (self.ids.n + last + 1 - counts)[back]), (self.counts, counts[back]), (self.whole, whole[back]),
                             (self.ids, ids), (self.covers, np.diff(ends, prepend=0))):
            column.extend(more)

    def of(self, at: np.ndarray, words: np.ndarray) -> list[tuple | None]:
        """Ids and ends of each text, given by its words' numbers; none if it has no tokens or their bytes differ from the text's."""
        counts = self.counts.held[at]
        after = np.cumsum(counts)
        token = np.arange(after[-1] if len(after) else 0) + np.repeat(self.starts.held[at] - after + counts, counts)
        ids, ends = self.ids.held[token], np.append(0, np.cumsum(self.covers.held[token]))
        bad = np.append(0, np.cumsum(self.whole.held[at] == 0))
        cuts, bad = np.append(0, after)[words], bad[words]
        return [None if a == b or x != y else (ids[a:b], ends[a + 1:b + 1] - ends[a])
                for a, b, x, y in zip(cuts[:-1], cuts[1:], bad[:-1], bad[1:], strict=True)]


class _Words:
    """Tokens of each different word, of one tokenizer or of both."""

    def __init__(self, *kinds: _Tokens):
        self.kinds, self.place = kinds, _Places()

    def clear(self) -> None:
        self.place = _Places()
        for k in self.kinds:
            k.clear()

    def of(self, texts: list[list[str]]) -> list[list[tuple | None]]:
        """For each tokenizer its ids and ends of each text, given as words."""
        if len(self.place) > WORDS or any(k.ids.n > TOKENS for k in self.kinds):
            self.clear()
        place = self.place
        at = np.fromiter(map(place.__getitem__, chain.from_iterable(texts)), np.int64)
        if place.new:
            for k in self.kinds:
                k.add(place.new)
            place.new = []
        words = np.cumsum([0, *map(len, texts)])
        return [k.of(at, words) for k in self.kinds]


class Tokenizers:
    """Both tokenizers, with every id's bytes and their number."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import regex
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = byte_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_fallback = np.array([self.b.is_byte(i) for i in range(len(pieces))])
        self.b_bytes = [bytes([int(piece[3:-1], 16)]) if fallback else piece.replace(SPACE, " ").encode()
                        for piece, fallback in zip(pieces, self.b_fallback, strict=True)]
        self.a_len, self.b_len = (np.array([len(x) for x in xs], np.int64) for xs in (self.a_bytes, self.b_bytes))
        self.a_words, self.b_words = _Words(_Tokens(self._a_tokens)), _Words(_Tokens(self._b_tokens, added=1))
        self.both_words = _Words(_Tokens(lambda words: self._a_tokens([f" {w}" for w in words]), added=1), _Tokens(self._b_tokens, added=1))
        self.a_find, self.b_find = (regex.compile(x).findall for x in (WORD, SPACED))
        # a piece that goes on over a space after another character would join words
        self.b_joins = any(SPACE in piece.lstrip(SPACE) for piece in pieces)
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.step = most  # printed ids: followed by a comma, then by a bar, then by a semicolon
        self.printed = [f"{i}{mark}".encode() for mark in ",|;" for i in range(most)]

    def _a_tokens(self, words: list[str]) -> tuple:
        """Of A: its character offsets, refined inside characters. Words with one space before them are cut apart again by A."""
        order, n = _first([w[0] == " " and not w[1:2].isspace() and len(w) > 1 for w in words])
        words = [words[i] for i in order]
        close, apart = words[:n], words[n:]
        texts = ["".join(close), *apart] if close else apart
        found = self.a.encode_batch(texts, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable([e.ids for e in found]), np.int64)
        full = "".join(texts)
        if b"".join(map(self.a_bytes.__getitem__, ids.tolist())) != full.encode():
            raise ValueError("A's tokens don't cover its words")
        starts = np.cumsum([0, *map(len, texts[:-1])])
        offsets = np.fromiter(chain.from_iterable(chain.from_iterable([e.offsets for e in found])), np.int64).reshape(-1, 2)
        offsets += np.repeat(starts, [len(e) for e in found])[:, None]
        return order, ids, refine(_byte_ends(full, offsets), np.cumsum(self.a_len[ids])), np.ones(len(words), bool)

    def _b_spans(self, text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """B's ids of a text, the byte ends that its proto's spans say (the added space counts), refined inside characters,
        and whether the ids have the bytes of it."""
        found = self.b.encode(text, return_type="offset_mapping", return_bytes=True)
        ids = np.array(found["ids"], np.int64)
        spans = np.fromiter(chain.from_iterable(found["offsets"]), np.int64, 2 * len(ids)).reshape(-1, 2)
        if b"".join(map(self.b_bytes.__getitem__, found["ids"])) != f" {text}".encode():
            return ids, spans[:, 1] + 1, False
        inside = self.b_fallback[ids] & (spans[:, 0] == spans[:, 1])
        return ids, refine(np.where(inside, -1, spans[:, 1] + 1), np.cumsum(self.b_len[ids])), True

    def _b_tokens(self, words: list[str]) -> tuple:
        """Of B: words without the space before them, together in one text but for those with spaces at the end or with B's own
        sign of one."""
        order, n = _first([not (self.b_joins or w[-1] == " " or SPACE in w) for w in words])
        words = [words[i] for i in order]
        close, apart = words[:n], words[n:]
        together = self._b_spans(" ".join(close)) if close else None
        if together and not together[2]:
            close, apart, together = [], words, None
        ids, ends, whole = ([together[0]], [together[1]], [True] * len(close)) if together else ([], [], [])
        at = sum(len(w.encode()) + 1 for w in close)
        for w in apart:
            i, e, fine = self._b_spans(w)
            n = len(w.encode()) + 1
            ids.append(i if fine else np.zeros(1, np.int64))  # never printed
            ends.append(at + (e if fine else np.array([n])))
            whole.append(fine)
            at += n
        return order, np.concatenate(ids), np.concatenate(ends), np.array(whole)

    def _plain(self, t: str, spaced: str) -> bool:
        """Whether words between spaces serve both tokenizers: A's pattern starts anew at each space, as none is next to another white one."""
        return not self.b_joins and "  " not in spaced and " \n" not in spaced and "\n " not in spaced and spaced[-1] != " " \
            and (t.isascii() or max(t) <= LATIN) and not any(c in t for c in OTHER_SPACES)

    def encode(self, texts: list[str]) -> list[tuple | None]:
        """Of each text (A ids, A ends, B ids, B ends) in bytes of space + text, or None if it has no tokens."""
        spaced = [f" {t}" for t in texts]
        plain = [self._plain(t, s) for t, s in zip(texts, spaced, strict=True)]
        both = zip(*self.both_words.of([t.split(" ") for t, x in zip(texts, plain, strict=True) if x]), strict=True)
        rest = [(t, s) for t, s, x in zip(texts, spaced, plain, strict=True) if not x]
        a, = self.a_words.of([[s] if not t.isascii() and max(t) > LATIN else self.a_find(s) for t, s in rest])
        b, = self.b_words.of([[t] if self.b_joins else self.b_find(s) if "  " in s or s[-1] == " " else t.split(" ") for t, s in rest])
        apart = zip(a, b, strict=True)
        found = [next(both if x else apart) for x in plain]
        return [None if x is None or y is None else (*x, *y) for x, y in found]


def _first(is_first: list[bool]) -> tuple[np.ndarray, int]:
    """Places with those that are first before the others, and how many these are."""
    x = np.array(is_first, bool)
    return np.concatenate([np.flatnonzero(x), np.flatnonzero(~x)]), int(x.sum())


def _byte_ends(full: str, offsets: np.ndarray) -> np.ndarray:
    """Byte ends of character offsets; -1 where the token shares its last character with the next token."""
    points = np.frombuffer(full.encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])
    ends = at[offsets[:, 1]]
    ends[:-1][offsets[1:, 0] < offsets[:-1, 1]] = -1
    return ends


def refine(coarse: np.ndarray, decoded: np.ndarray) -> np.ndarray:
    """The coarse ends, with those inside a character (-1) put after the known end before them by the decoded bytes since then. Both
    must then say the same of every token."""
    known = coarse >= 0
    before = np.maximum.accumulate(np.where(known, np.arange(len(coarse)), -1))
    ends = np.where(before >= 0, coarse[before] + decoded - decoded[before], decoded)
    if (ends != decoded).any():
        raise ValueError(f"spans {coarse.tolist()} of tokens that end at {decoded.tolist()}")
    return ends


def merged(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All different ends in order, and which of them both have."""
    both = np.concatenate([a_ends, b_ends])
    both.sort(kind="stable")  # two runs
    last = np.append(both[1:] != both[:-1], True)
    at = np.flatnonzero(last)
    return both[at], np.diff(at, prepend=-1) > 1


def links(a_ids: np.ndarray, a_ends: np.ndarray, b_ids: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A and B ids of all overlapping occurrences, in text order."""
    ends, _ = merged(a_ends, b_ends)
    return a_ids[np.searchsorted(a_ends, ends)], b_ids[np.searchsorted(b_ends, ends)]


def groups_text(t: Tokenizers, a_ids, a_ends, b_ids, b_ends) -> tuple[int, bytes]:
    """Number of groups, and ``a1,a2|b1;a3|b2,b3``."""
    ends, shared = merged(a_ends, b_ends)
    both = ends[shared]
    a_group, b_group = np.searchsorted(both, a_ends), np.searchsorted(both, b_ends)
    order = np.empty(len(a_ids) + len(b_ids), np.int64)
    a_last, b_last = (np.append(g[1:] != g[:-1], True) for g in (a_group, b_group))
    # an A token comes after the B tokens of the groups before, a B token after the A tokens of its group and those before
    n_b, n_a = np.cumsum(np.bincount(b_group, minlength=len(both))), np.cumsum(np.bincount(a_group, minlength=len(both)))
    order[np.arange(len(a_ids)) + np.append(0, n_b)[a_group]] = a_ids + np.where(a_last, t.step, 0)
    order[np.arange(len(b_ids)) + n_a[b_group]] = b_ids + np.where(b_last, 2 * t.step, 0)
    return len(both), b"".join(map(t.printed.__getitem__, order.tolist()))[:-1]


@lru_cache(maxsize=2)
def _tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


# ------------------------------------------------------------------ blocks

_WRITTEN = pa.schema([
    ("block", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")],
    ("groups_sha256", pa.string()), ("places", pa.binary()), ("times", pa.binary()), ("pairs", pa.binary()), ("held_by", pa.binary())])
_WRITTEN_SQL = ("block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
                "places binary, times binary, pairs binary, held_by binary")


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers, none below 0, in as few bytes as the largest needs; the first byte tells how many."""
    width = next(w for w in (1, 2, 4, 8) if x.max(initial=0) < 1 << (8 * w) or w == 8)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _widen(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


class _Block:
    """Documents until they have ``held`` links: a row for each, and one with the block's distinct pairs."""

    def __init__(self, number: int):
        self.number, self.rows, self.pairs, self.links = number, [], [], 0

    def add(self, doc_id, t: Tokenizers, found: tuple | None) -> None:
        if found is None:
            self.rows.append((doc_id, 0, 0, 0, 0, "", b"\x01"))
            self.pairs.append(np.zeros(0, np.int64))
            return
        a, b = links(*found)
        pairs = np.sort((a << 32) | b)
        first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
        pairs, times = pairs[first], np.diff(np.append(first, len(pairs)))
        n_groups, text = groups_text(t, *found)
        self.rows.append((doc_id, len(found[0]), len(found[2]), n_groups, len(a), hashlib.sha256(text).hexdigest(), _narrow(times)))
        self.pairs.append(pairs)
        self.links += len(a)

    def batch(self) -> pa.RecordBatch:
        pairs, place, held_by = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        cuts = np.cumsum([len(p) for p in self.pairs])
        rows = [{"block": self.number, "doc_id": r[0], "n_a": r[1], "n_b": r[2], "n_groups": r[3], "n_links": r[4],
                 "groups_sha256": r[5], "places": _narrow(np.diff(p, prepend=0)), "times": r[6]}
                for r, p in zip(self.rows, np.split(place, cuts[:-1]), strict=True)]
        rows.append({"block": self.number, "pairs": _narrow(np.diff(pairs, prepend=0)), "held_by": _narrow(held_by)})
        return pa.RecordBatch.from_pylist(rows, _WRITTEN)


def _aligner(a_path: str, b_path: str, held: int):
    def run(batches):
        from pyspark import TaskContext
        t, first, n = _tokenizers(a_path, b_path), TaskContext.get().partitionId() << 32, 0
        block = _Block(first)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = []
            for x in batch.column(1).cast(pa.binary()).to_pylist():
                try:
                    texts.append(x.decode() if x else None)
                except UnicodeDecodeError:  # can't be any tokens' bytes
                    texts.append(None)
            a = 0
            while a < len(ids):
                b, size = a, 0
                while b < len(ids) and (b == a or size + len(texts[b] or "") <= ENCODED):
                    size += len(texts[b] or "")
                    b += 1
                found = iter(t.encode([x for x in texts[a:b] if x is not None]))
                for doc_id, text in zip(ids[a:b], texts[a:b], strict=True):
                    block.add(doc_id, t, None if text is None else next(found))
                    if block.links >= held:
                        yield block.batch()
                        n += 1
                        block = _Block(first + n)
                a = b
        if block.rows:
            yield block.batch()
    return run


def _pair_rows(batches):
    """The distinct pairs of blocks as rows."""
    for batch in batches:
        for block, pairs, held_by in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            p = np.cumsum(_widen(pairs))
            yield pa.RecordBatch.from_pydict({
                "block": pa.array(np.full(len(p), block)), "place": pa.array(np.arange(len(p), dtype=np.int32)),
                "a": pa.array((p >> 32).astype(np.int32)), "b": pa.array((p & 0xFFFFFFFF).astype(np.int32)), "n": pa.array(_widen(held_by))})


_RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _answer(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Sums over each document's links of the counts of a block's pairs."""
    place, n, best = (counts[c].to_numpy() for c in ("place", "count", "best"))
    count, top = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    count[place], top[place] = n, best
    sums, bests = [], []
    for places, times in zip(docs["places"].to_pylist(), docs["times"].to_pylist(), strict=True):
        p, k = np.cumsum(_widen(places)), _widen(times)
        sums.append(int((count[p] * k).sum()))
        bests.append(int((top[p] * k).sum()))
    out = {c: docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
    out |= {"n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
    return pa.table({c: out[c] for c in _RESULT})


def align(docs: DataFrame, folder: str = FOLDER, a_file: str = A_FILE, b_file: str = B_FILE, held: int = HELD) -> DataFrame:
    """One row per document row: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair has its A id's highest count,
    ties included), count_sum (of the links' counts), groups_sha256."""
    run = _aligner(os.path.join(folder, a_file), os.path.join(folder, b_file), held)
    with small_batches(docs.sparkSession):
        made = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _WRITTEN_SQL)
        written = cut_lineage(made)
    pairs = written.filter(F.col("pairs").isNotNull()).select("block", "pairs", "held_by") \
        .mapInArrow(_pair_rows, "block bigint, place int, a int, b int, n bigint")
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    counts = cut_lineage(counts)
    best = counts.groupBy("a").agg(F.max("count").alias("most"))  # as many rows as A has ids
    marked = counts.join(F.broadcast(best), "a").select("a", "b", "count", (F.col("count") == F.col("most")).cast("int").alias("best"))
    back = pairs.select("block", "place", "a", "b").join(marked, ["a", "b"]).select("block", "place", "count", "best")
    rows = written.filter(F.col("pairs").isNull()).drop("pairs", "held_by")
    longs = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_answer, longs)
