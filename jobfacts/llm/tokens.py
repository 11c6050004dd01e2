"""Token ids of a byte-level BPE vocabulary file, for batches of texts inside a task."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

PIECE = 1 << 20
#: One space between a letter or digit and a letter always begins a token of its own, so ids of the parts join up.
SAFE_CUT = re.compile(r"(?<=[0-9A-Za-z]) (?=[A-Za-z])")
#: The pattern that byte-level BPE of this family splits texts by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary file: printable ones for themselves, the others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """The ids that the `tokenizers` library gives with add_special_tokens=False.

    Strings of the file's added tokens are found in the text first, the longest at each place, and have their own ids;
    what stands between them is encoded for itself. The vocabulary is read from the same file. Ids are looked up
    through `tiktoken`, which splits and merges alike and takes a quarter of the time; a test holds both against
    each other.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of, special = _byte_of(), {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self._encode = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._special = special
        longest = sorted(special, key=len, reverse=True)
        self._added = re.compile("|".join(map(re.escape, longest))) if special else None
        self.n_bytes = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for token, i in ranks.items():
            self.n_bytes[i] = len(token)
        for string, i in special.items():
            self.n_bytes[i] = len(string.encode())

    def pieces(self, text: str) -> Iterator[np.ndarray]:
        """Ids of a text, a part at a time: a very long text never becomes one list."""
        begin = 0
        for found in self._added.finditer(text) if self._added else ():
            if found.start() > begin:
                yield from self._ordinary(text[begin : found.start()])
            yield np.array([self._special[found[0]]], np.uint32)
            begin = found.end()
        if begin < len(text) or not begin:
            yield from self._ordinary(text[begin:] if begin else text)

    def _ordinary(self, text: str) -> Iterator[np.ndarray]:
        begin = 0
        while len(text) - begin > PIECE:
            cut = SAFE_CUT.search(text, begin + PIECE)
            if cut is None:
                break
            yield np.array(self._encode(text[begin : cut.start()]), np.uint32)
            begin = cut.start()
        yield np.array(self._encode(text[begin:] if begin else text), np.uint32)

    def ids(self, text: str) -> np.ndarray:
        parts = list(self.pieces(text))
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)
