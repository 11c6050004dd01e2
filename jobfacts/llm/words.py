"""Words and shingles of whole texts as 64-bit hashes, computed on the bytes of an Arrow batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from jobfacts.llm.common import raw

_MIX_A, _MIX_B, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x5851F42D4C957F2D)
WINDOW = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x + _STEP
        x = (x ^ (x >> np.uint64(30))) * _MIX_A
        x = (x ^ (x >> np.uint64(27))) * _MIX_B
        return x ^ (x >> np.uint64(31))


def _letters() -> np.ndarray:
    """A random number for each byte; A-Z have those of a-z."""
    out = mix(np.arange(1, 257, dtype=np.uint64))
    out[65:91] = out[97:123]
    return out


_LETTER = _letters()
#: Bytes that end a word: space and the controls from tab to carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _windows(inside: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of about `WINDOW` bytes that end between words; one word longer than that is a stretch of its own."""
    out, begin, n = [], 0, len(inside)
    while begin < n:
        end = min(n, begin + WINDOW)
        if end < n and inside[end - 1] and inside[end]:
            back = np.flatnonzero(~inside[begin:end])
            if len(back):
                end = begin + int(back[-1]) + 1
            else:
                ahead = np.flatnonzero(~inside[end:])
                end = n if not len(ahead) else end + int(ahead[0])
        out.append((begin, end))
        begin = end
    return out


def _hashed(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lengths = ends - starts
    within = np.arange(int(lengths.sum()), dtype=np.int64)
    heads = np.cumsum(lengths) - lengths
    within -= np.repeat(heads, lengths)
    taken = body[np.repeat(starts, lengths) + within]
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.full(int(lengths.max()), _BASE))
        sums = np.add.reduceat(_LETTER[taken] * powers[within], heads)
        return mix(sums + lengths.astype(np.uint64) * _STEP)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and where each text's words begin (one more entry than texts).

    Words are runs of bytes other than space, tab, newline, vertical tab, form feed and carriage return; A-Z count as
    a-z. Nulls are empty.
    """
    body, at = raw(texts)
    inside = ~_SPACE[body]
    first = np.zeros(len(body) + 1, bool)
    first[at] = True
    starts_at = inside.copy()
    starts_at[1:] &= ~inside[:-1] | first[1:-1]
    ends_at = inside.copy()
    ends_at[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(starts_at), np.flatnonzero(ends_at) + 1
    bounds = np.searchsorted(starts, at)
    if not len(starts):
        return np.empty(0, np.uint64), bounds
    parts = []
    for begin, end in _windows(inside):
        i, j = np.searchsorted(starts, [begin, end])
        if j > i:
            parts.append(_hashed(body, starts[i:j], ends[i:j]))
    return np.concatenate(parts), bounds


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and where each text's begin.

    A text of fewer than `size` words has its whole sequence as one shingle; one without words has none.
    """
    n_words = np.diff(bounds)
    n = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    doc = np.repeat(np.arange(len(n)), n)
    at = np.repeat(bounds[:-1], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    width = np.minimum(n_words, size)[doc]
    with np.errstate(over="ignore"):
        total = mix(width.astype(np.uint64))
        for k in range(size):
            use = k < width
            word = np.zeros(len(at), np.uint64)
            word[use] = hashes[at[use] + k]
            total = mix(total * _BASE + word)
    order = np.lexsort((total, doc))
    total, doc = total[order], doc[order]
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (doc[1:] != doc[:-1])
    return total[new], np.searchsorted(doc[new], np.arange(len(n) + 1))
