import random
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from jobfacts.llm import sharding


def check(docs, got, shards):
    rows = docs.select("doc_id", "text").collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    of = defaultdict(set)
    slots = defaultdict(list)
    for r in got:
        of[r.text_sha256].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(x) == 1 for x in of.values()) and set(slots) <= set(range(shards))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_whole_groups_and_gapless_slots(docs, monkeypatch):
    for groups, fan_in in ((20_000, 64), (5, 4)):  # small ones make several levels
        monkeypatch.setattr(sharding, "GROUPS", groups)
        monkeypatch.setattr(sharding, "FAN_IN", fan_in)
        check(docs, sharding.shard_by_bytes(docs, 7).collect(), 7)


def test_near_equal_bytes(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sharding.shard_by_bytes(docs, 10).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in got]
    assert len(sizes) == 10 and max(sizes) - min(sizes) < 0.002 * sum(sizes) / 10


def test_nothing(nothing):
    assert sharding.shard_by_bytes(nothing, 40).collect() == []


@settings(max_examples=60)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=40), st.integers(1, 6))
def test_difference_places_every_row(sizes, bins):
    rng = random.Random(len(sizes))
    sums = np.array([[s] + [rng.randrange(3) for _ in range(bins - 1)] for s in sizes])
    places, total = sharding.difference(sums)
    again = np.zeros(bins, np.int64)
    for row, place in zip(sums, places):
        assert sorted(place) == list(range(bins))
        again[place] += row
    assert (again == total).all()


def test_differencing_balances_better_than_in_turn():
    rng = random.Random(6)
    sizes = [min(6000, int(rng.paretovariate(1.2) * 100)) for _ in range(400)]
    sums = np.zeros((len(sizes), 8), np.int64)
    sums[:, 0] = sizes
    total = sharding.difference(sums)[1]
    assert total.max() - total.min() <= 0.002 * sum(sizes) / 8


def differenced(sizes, bins):
    """Karmarkar-Karp as described: plain lists, the two partitions of largest spread first."""
    parts = [sorted([n] + [0] * (bins - 1)) for n in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[-1] - p[0])
        a, b = parts.pop(), parts.pop()
        parts.append(sorted(x + y for x, y in zip(a, reversed(b), strict=True)))
    return parts[0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=9, unique=True), st.integers(2, 4))
def test_spread_of_small_inputs(sizes, bins):
    """Bins add up as placed; differencing is never worse than twice the best and no worse than the plain method by more than its ties."""
    sums = np.zeros((len(sizes), bins), np.int64)
    sums[:, 0] = sizes
    places, total = sharding.difference(sums)
    held = [0] * bins
    for n, place in zip(sizes, places[:, 0].tolist(), strict=True):
        held[place] += n
    assert sorted(held) == sorted(total.tolist())
    best = min(
        max(sum(n for n, b in zip(sizes, way, strict=True) if b == k) for k in range(bins)) for way in product(range(bins), repeat=len(sizes))
    ) if len(sizes) <= 7 else max(sizes)
    assert best <= max(held) <= 2 * max(best, -(-sum(sizes) // bins))
    if bins == 2:
        assert sorted(held) == differenced(sizes, 2) or max(held) <= max(differenced(sizes, 2)) + min(sizes)
