"""A z-fast trie over sequences of equally long units, for one batch of sequences at a time."""

from __future__ import annotations

from hashlib import blake2b

ROOT = b""


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that is divisible by the largest power of two."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class Key:
    """A sequence of units with a 128-bit name for each of its prefixes."""

    __slots__ = ("names", "units")

    def __init__(self, units: list[bytes]):
        self.units = units
        names, last = [ROOT], ROOT
        for unit in units:
            last = blake2b(last + unit, digest_size=16).digest()
            names.append(last)
        self.names = names

    def __len__(self) -> int:
        return len(self.units)


class Node:
    """A compacted node: the prefixes of `key` longer than `low`, up to `high`."""

    __slots__ = ("children", "ends", "high", "key", "low")

    def __init__(self, key: Key, low: int, high: int):
        self.key, self.low, self.high = key, low, high
        self.children: dict[bytes, Node] = {}
        self.ends = None  # what was inserted here

    def handle(self) -> bytes:
        return self.key.names[two_fattest(self.low, self.high)] if self.high else ROOT


class ZFast:
    """Compacted nodes, found by the name of the prefix at their handle: the 2-fattest length that they span."""

    def __init__(self):
        self.root = Node(Key([]), 0, 0)
        self.table: dict[bytes, Node] = {}
        self.probes = 0

    def parent(self, key: Key) -> Node:
        """The deepest node that is wholly a prefix of `key`, by fat binary search over lengths."""
        node, low, high = self.root, 0, len(key)
        while low < high:
            at = two_fattest(low, high)
            self.probes += 1
            found = self.table.get(key.names[at])
            if found is None:
                high = at - 1
            elif found.high <= len(key) and found.key.names[found.high] == key.names[found.high]:
                node, low = found, found.high
            else:
                high = found.low  # the key leaves the trie inside this node
        return node

    def insert(self, key: Key, what) -> None:
        """Put `what` at the end of `key`; of one key the last counts."""
        above = self.parent(key)
        if above.high == len(key):
            above.ends = what
            return
        branch = key.units[above.high]
        exit_ = above.children.get(branch)
        if exit_ is None:
            self._hang(above, branch, Node(key, above.high, len(key))).ends = what
            return
        low, high = above.high + 1, min(exit_.high, len(key))
        while low < high:  # how far key and node agree
            mid = (low + high + 1) // 2
            if key.names[mid] == exit_.key.names[mid]:
                low = mid
            else:
                high = mid - 1
        del self.table[exit_.handle()]
        upper = self._hang(above, branch, Node(key, above.high, low))
        exit_.low = low
        self._hang(upper, exit_.key.units[low], exit_)
        if low == len(key):
            upper.ends = what
        else:
            self._hang(upper, key.units[low], Node(key, low, len(key))).ends = what

    def _hang(self, above: Node, branch: bytes, node: Node) -> Node:
        above.children[branch] = node
        self.table[node.handle()] = node
        return node

    def bottom_up(self) -> list[Node]:
        """All nodes, each after its children."""
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            out.append(node)
            todo.extend(node.children.values())
        return out[::-1]
