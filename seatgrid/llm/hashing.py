"""Vectorised words and word-run hashes of many texts at once, for Python stages.

Words are lower-cased runs of letters, digits and non-ASCII characters, found over the UTF-8 bytes of a whole batch;
their 64-bit hashes are polynomial prefix sums, finished by a mixer. Texts are handled in pieces of
about ``PIECE`` bytes (a longer text is a piece of its own), which bounds memory by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1_000_000
_U = np.uint64
_IS_WORD = np.zeros(256, bool)
_IS_WORD[ord("0"):ord("9") + 1] = _IS_WORD[ord("a"):ord("z") + 1] = _IS_WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64's finisher)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64; kept for pieces of the usual length."""
    out = _POWERS.get(base)
    if out is None or len(out) < n:
        out = np.full(max(n, PIECE + PIECE // 4), base, _U)
        out[0] = 1
        out = np.multiply.accumulate(out)
        if n <= 2 * PIECE:
            _POWERS[base] = out
    return out[:n]


def words_of(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data: the bytes of texts, one after another; cuts: where each text starts, and the end.
    Gives the word hashes in order, and the number of words before each cut."""
    data = _LOWER[data]
    inside = _IS_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = cuts[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]  # a word does not run on into the next text
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), out=sums[1:])
    back = _powers(_INVERSE, len(data) + 1)
    h = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(_U))
    return h, np.searchsorted(starts, cuts)


def pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts an Arrow string array (nulls are empty) into (from, to, word hashes, word cuts)."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PIECE, "right")) - 1)
        b = min(b, len(texts))
        cuts = offsets[a:b + 1]
        h, at = words_of(data[cuts[0]:cuts[-1]], cuts - cuts[0])
        yield a, b, h, at
        a = b


def runs(h: np.ndarray, at: np.ndarray, steps: tuple[int, ...], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word tuples (w[i], w[i + steps[0]], ...) inside each text: (hashes, cuts)."""
    reach = steps[-1] if steps else 0
    n = max(0, len(h) - reach)
    out = h[:n] * _U(0xD6E8FEB86659FD93) + _U(salt * 2 + 1)
    for k, s in enumerate(steps):
        out = mix(out) + h[s:s + n] * _U(0xD6E8FEB86659FD93 + 2 * k + 2)
    left = np.maximum(np.diff(at) - reach, 0)  # tuples of each text
    keep = np.arange(n) < np.repeat(at[:-1] + left, np.diff(at))[:n]
    return mix(out[keep]), np.concatenate([[0], np.cumsum(left)])


def shingles(h: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words; a text with one to ``width - 1`` words is one shingle."""
    out, cuts = runs(h, at, tuple(range(1, width)), 0)
    counts, n = np.diff(cuts), np.diff(at)
    short = np.flatnonzero((n > 0) & (n < width))
    if not len(short):
        return out, cuts
    whole = n[short].astype(_U)
    for k in range(width - 1):  # word by word, for all short texts at once
        has = n[short] > k
        whole[has] = mix(whole[has] * _U(0xD6E8FEB86659FD93) + h[at[short[has]] + k])
    new = np.insert(out, cuts[short], whole)
    counts[short] = 1
    return new, np.concatenate([[0], np.cumsum(counts)])
