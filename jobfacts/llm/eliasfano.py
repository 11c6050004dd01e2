"""Monotone integer sequences in Elias-Fano form, and an n-gram trie whose levels are such sequences.

Everything is plain little-endian arrays, so a level can be a view of a memory-mapped file or of an Arrow buffer.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class EliasFano:
    """A rising sequence of `n` numbers below `universe`: low bits packed, high parts as gaps in a bit string."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        # Ones before each 64 bits: made when a level is opened, not stored, and a small part of the level.
        self.ranks = np.cumsum(np.bitwise_count(high), dtype=np.uint32 if n < 1 << 32 else np.int64)
        self.ranks = np.concatenate([np.zeros(1, self.ranks.dtype), self.ranks[:-1]])

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        universe = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (universe // max(1, n)).bit_length() - 1)
        low = np.zeros(n * low_bits // 64 + 2, np.uint64)
        if low_bits:
            part = values & np.uint64((1 << low_bits) - 1)
            at = np.arange(n, dtype=np.int64) * low_bits
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, part << shift)
            over = shift.astype(np.int64) + low_bits > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n, dtype=np.int64)
        high = np.zeros((int(ones[-1]) if n else 0) // 64 + 1, np.uint64)
        np.bitwise_or.at(high, ones >> 6, _ONE << (ones & 63).astype(np.uint64))
        return cls(n, low_bits, low, high)

    @staticmethod
    def _select(index: np.ndarray, high: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Where the ones of these numbers are in a bit string: the word by the directory, then halves of it."""
        word = np.searchsorted(ranks, index.astype(ranks.dtype), "right") - 1
        left = (index - ranks[word]).astype(np.uint64)
        bits, place = high[word].astype(np.uint64), np.zeros(len(index), np.uint64)
        for half in (32, 16, 8, 4, 2, 1):
            below = np.bitwise_count(bits & np.uint64((1 << half) - 1)).astype(np.uint64)
            above = left >= below
            left -= np.where(above, below, np.uint64(0))
            step = np.where(above, np.uint64(half), np.uint64(0))
            bits >>= step
            place += step
        return (word << 6) + place.astype(np.int64)

    def _below(self, high: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """How many numbers have a high part below these: the zeros of the bit string divide the high parts."""
        out = np.full(len(high), self.n, np.int64)
        out[high <= 0] = 0
        use = np.flatnonzero((high > 0) & (high <= 64 * len(self.high) - self.n))
        out[use] = self._select(high[use] - 1, ~self.high, ranks) - (high[use] - 1)
        return out

    def __getitem__(self, index: np.ndarray) -> np.ndarray:
        """The numbers at many places at once."""
        index = np.asarray(index, np.int64)
        high = (self._select(index, self.high, self.ranks) - index).astype(np.uint64)
        if not self.low_bits:
            return high
        place = index * self.low_bits
        word, shift = place >> 6, (place & 63).astype(np.uint64)
        part = self.low[word] >> shift
        over = shift.astype(np.int64) + self.low_bits > 64
        part[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return (high << np.uint64(self.low_bits)) | (part & np.uint64((1 << self.low_bits) - 1))

    def successor(self, target: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The first place in [begin, end) whose number is at least the target, `end` where there is none."""
        part = (target.astype(np.uint64) >> np.uint64(self.low_bits)).astype(np.int64)
        zeros = np.arange(len(self.high), dtype=np.int64) * 64 - self.ranks
        low, high = (np.clip(self._below(x, zeros), begin, end).astype(np.int64) for x in (part, part + 1))
        active = np.flatnonzero(low < high)
        while len(active):
            mid = (low[active] + high[active]) // 2
            less = self[mid] < target[active]
            low[active] = np.where(less, mid + 1, low[active])
            high[active] = np.where(less, high[active], mid)
            active = active[low[active] < high[active]]
        return low

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high)], "<u8")
        return head.tobytes() + self.low.astype("<u8").tobytes() + self.high.astype("<u8").tobytes()

    @classmethod
    def from_buffer(cls, buffer) -> tuple[EliasFano, int]:
        """A view of what `to_bytes` wrote, and how many bytes it takes."""
        n, low_bits, a, b = np.frombuffer(buffer, "<u8", 4).tolist()
        low, high = np.frombuffer(buffer, "<u8", a, 32), np.frombuffer(buffer, "<u8", b, 32 + 8 * a)
        return cls(n, low_bits, low, high), 32 + 8 * (a + b)


class Level:
    """The successors of numbered contexts: where each context's range begins, words, a quantised probability each.

    Pointers rise by themselves. Words rise only within a context, so each range goes on where the one before ended: a
    stored number is the word plus the last stored number of the range before, plus one. A search for a word is
    therefore a search for a number relative to its context.
    """

    def __init__(self, pointers: EliasFano, words: EliasFano, codes: np.ndarray) -> None:
        self.pointers, self.words, self.codes = pointers, words, codes

    @classmethod
    def of(cls, widths: np.ndarray, word: np.ndarray, codes: np.ndarray) -> Level:
        """From how many successors each context has, and these in order of context, then word."""
        ends = np.cumsum(widths)
        last = np.zeros(len(widths), np.int64)
        some = np.flatnonzero(widths)
        last[some] = word[ends[some] - 1] + 1
        offset = np.cumsum(last) - last
        return cls(EliasFano.of(np.append(0, ends)), EliasFano.of(word.astype(np.int64) + np.repeat(offset, widths)), codes.astype("<u2"))

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The place of each word among its context's successors, -1 where it is none; a context of -1 has none."""
        out = np.full(len(context), -1, np.int64)
        use = np.flatnonzero(context >= 0)
        asked, back = np.unique(context[use], return_inverse=True)
        begin, end = self.pointers[asked].astype(np.int64), self.pointers[asked + 1].astype(np.int64)
        offset = np.zeros(len(asked), np.uint64)
        later = begin > 0
        offset[later] = self.words[begin[later] - 1] + _ONE
        target = word[use].astype(np.uint64) + offset[back]
        place = self.words.successor(target, begin[back], end[back])
        hit = place < end[back]
        hit[hit] = self.words[place[hit]] == target[hit]
        out[use[hit]] = place[hit]
        return out

    def to_bytes(self) -> bytes:
        return b"".join([self.pointers.to_bytes(), self.words.to_bytes(), self.codes.tobytes(), b"\0" * (-2 * len(self.codes) % 8)])

    @classmethod
    def from_buffer(cls, view: memoryview) -> tuple[Level, memoryview]:
        """A view of what `to_bytes` wrote, and what follows it."""
        parts = []
        for _ in range(2):
            part, size = EliasFano.from_buffer(view)
            parts.append(part)
            view = view[size:]
        n = parts[1].n
        return cls(*parts, np.frombuffer(view, "<u2", n)), view[-(-n // 4) * 8 :]


class Trie:
    """First words in a rising sequence, then a level for each further order; a place in one is a context of the next."""

    def __init__(self, contexts: EliasFano, levels: list[Level]) -> None:
        self.contexts, self.levels = contexts, levels

    @classmethod
    def of(cls, context: np.ndarray, word: np.ndarray, codes: np.ndarray, *further: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Trie:
        """From bigrams sorted by context, then word; `further` has what `Level.of` takes, order by order."""
        new = np.ones(len(context), bool)
        new[1:] = context[1:] != context[:-1]
        begins = np.flatnonzero(new)
        widths = np.diff(np.append(begins, len(context)))
        return cls(EliasFano.of(context[begins]), [Level.of(widths, word, codes), *(Level.of(*x) for x in further)])

    def roots(self, context: np.ndarray) -> np.ndarray:
        """The place of each first word, -1 where the trie has none."""
        n = self.contexts.n
        asked, back = np.unique(context, return_inverse=True)
        at = self.contexts.successor(asked.astype(np.uint64), np.zeros(len(asked), np.int64), np.full(len(asked), n, np.int64))
        known = at < n
        known[known] = self.contexts[at[known]] == asked[known].astype(np.uint64)
        return np.where(known, at, -1)[back]

    def codes(self, order: int, place: np.ndarray, absent: int) -> np.ndarray:
        """The codes at these places of the level of `order`, `absent` for a place of -1."""
        out = np.full(len(place), absent, np.uint16)
        out[place >= 0] = self.levels[order - 2].codes[place[place >= 0]]
        return out

    def lookup(self, context: np.ndarray, word: np.ndarray, absent: int) -> np.ndarray:
        """The code of each bigram, `absent` where the trie has none."""
        return self.codes(2, self.levels[0].find(self.roots(context), word), absent)

    def to_bytes(self) -> bytes:
        return b"".join([np.array([len(self.levels)], "<u8").tobytes(), self.contexts.to_bytes(), *(x.to_bytes() for x in self.levels)])

    @classmethod
    def from_buffer(cls, buffer) -> Trie:
        """A view: bytes, an Arrow buffer or a `numpy.memmap` of a file."""
        view, levels = memoryview(buffer), []
        count = int(np.frombuffer(view, "<u8", 1)[0])
        contexts, size = EliasFano.from_buffer(view[8:])
        view = view[8 + size :]
        for _ in range(count):
            level, view = Level.from_buffer(view)
            levels.append(level)
        return cls(contexts, levels)
