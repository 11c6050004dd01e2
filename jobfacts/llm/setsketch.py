"""SetSketch registers: mergeable, locality-sensitive summaries of sets of 64-bit hashes.

Register i holds floor(1 - log_b h_i), cut to 0..Q+1, where h_i is the least of exponentially distributed numbers of
rate A, one for each element of the set. The register of a union is the larger of both.
"""

from __future__ import annotations

import numpy as np

from jobfacts.llm.words import mix

M, B, A, TOP = 160, 1.12, 20.0, 255
BANDS, ROWS = 32, 5


def sketch(elements: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of `M` registers for each set; an empty set has zeros.

    An element's points are those of a Poisson process of rate A * M in rising order, each at a register drawn at
    random, so every register sees a process of rate A. An element leaves when its next point lies above all minima
    of its set: most leave after their first.
    """
    n = len(bounds) - 1
    least = np.full(n * M, np.inf)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    seed, at = elements.copy(), np.zeros(len(elements))
    last = np.full(n, np.inf)
    turn = 0
    with np.errstate(over="ignore"):
        while len(seed):
            turn += 1
            bits = mix(seed + np.uint64(turn) * np.uint64(0xD1342543DE82EF95))
            uniform = ((bits >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52
            at = at - np.log(uniform) / (A * M)
            near = at < last[doc]
            if not near.all():
                seed, at, doc, bits = seed[near], at[near], doc[near], bits[near]
            register = (mix(bits) % np.uint64(M)).astype(np.int64)
            np.minimum.at(least, doc * M + register, at)
            if turn < 6 or turn % 8 == 0:
                here = np.unique(doc) if turn > 8 else slice(None)
                last[here] = least.reshape(n, M)[here].max(axis=1)
    with np.errstate(divide="ignore"):
        value = np.floor(1 - np.log(least) / np.log(B))
    return np.clip(np.where(np.isinf(least), 0, value), 0, TOP).astype(np.uint8).reshape(n, M)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each of the `BANDS` bands of `ROWS` registers; a pair at 0.85 misses all in under 1 of 10^8."""
    parts = registers[:, : BANDS * ROWS].reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    key = np.zeros(parts.shape[:2], np.uint64)
    for k in range(ROWS):
        key = (key << np.uint64(8)) | parts[:, :, k]
    return mix(key * np.uint64(64) + np.arange(BANDS, dtype=np.uint64))


def _step(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (B - 1) / B) / np.log(B)


def likelihood(above: np.ndarray, below: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, similarity: np.ndarray) -> np.ndarray:
    """Log-likelihood of a Jaccard similarity, jointly of registers above, below and equal, given both sizes."""
    u = size_a / (size_a + size_b)
    v = 1 - u
    j = np.minimum(similarity, np.minimum(u / v, v / u))
    p = np.clip(_step(np.maximum(u - v * j, 0)), 1e-12, 1)
    q = np.clip(_step(np.maximum(v - u * j, 0)), 1e-12, 1)
    return above * np.log(p) + below * np.log(q) + (M - above - below) * np.log(np.clip(1 - p - q, 1e-12, 1))


def at_least(above: np.ndarray, below: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the similarity of greatest likelihood is at least `similarity`: the function is concave, so its slope there says so."""
    near = [likelihood(above, below, size_a, size_b, np.full(len(above), similarity + d)) for d in (-1e-4, 1e-4)]
    return near[1] >= near[0]


def estimate(above: np.ndarray, below: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The similarity of greatest likelihood, by halving the interval in which it must lie (the function is concave)."""
    low, high = np.zeros(len(above)), np.minimum(size_a / size_b, size_b / size_a)
    for _ in range(20):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        up = likelihood(above, below, size_a, size_b, a) < likelihood(above, below, size_a, size_b, b)
        low, high = np.where(up, a, low), np.where(up, high, b)
    return (low + high) / 2
