"""A Patricia trie over byte strings whose terminal nodes hold the owner and the number of copies."""

from __future__ import annotations

from collections.abc import Iterator


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving: slices are compared in C."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Patricia:
    """Edges carry byte strings, children hang by the first byte of theirs.

    A node is a list of its edge, its children and its terminal: None, or a list of owner and copies.
    `better(a, b)` names the owner that stays. `spill` removes whole subtrees below the root, the largest first.
    """

    def __init__(self, better) -> None:
        self.better = better
        self.root: dict[int, list] = {}
        self.empty: list | None = None
        self.sizes: dict[int, int] = {}

    def __len__(self) -> int:
        return sum(self.sizes.values())

    def add(self, key: bytes, owner: int | None, copies: int) -> None:
        if not key:
            self.empty = self._joined(self.empty, owner, copies)
            return
        first, at, children = key[0], 0, self.root
        while True:
            node = children.get(key[at])
            if node is None:
                children[key[at]] = [key[at:], {}, [owner, copies]]
                self.sizes[first] = self.sizes.get(first, 0) + len(key) - at + 200
                return
            edge = node[0]
            if key.startswith(edge, at):
                at += len(edge)
                if at == len(key):
                    node[2] = self._joined(node[2], owner, copies)
                    return
                children = node[1]
                continue
            n = shared_prefix(edge, key[at : at + len(edge)])
            below = [edge[n:], node[1], node[2]]
            node[0], node[1], node[2] = edge[:n], {edge[n]: below}, None
            self.sizes[first] += 200
            if at + n == len(key):
                node[2] = [owner, copies]
                return
            at, children = at + n, node[1]

    def _joined(self, old: list | None, owner: int | None, copies: int) -> list:
        return [owner, copies] if old is None else [self.better(old[0], owner), old[1] + copies]

    def spill(self, down_to: int = 0) -> Iterator[tuple[bytes, int | None, int]]:
        """Yield and forget subtrees, the largest first, until at most `down_to` bytes are held."""
        left = len(self)
        if self.empty is not None and down_to == 0:
            yield b"", *self.empty
            self.empty = None
        for first in sorted(self.sizes, key=self.sizes.get, reverse=True):
            if left <= down_to and down_to:
                return
            left -= self.sizes.pop(first)
            stack = [(b"", self.root.pop(first))]
            while stack:
                prefix, (edge, children, terminal) = stack.pop()
                path = prefix + edge
                if terminal is not None:
                    yield path, *terminal
                stack += [(path, child) for child in children.values()]
