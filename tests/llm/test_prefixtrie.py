import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobfacts.llm import prefixtrie
from jobfacts.llm.zfast import Key, ZFast, two_fattest

FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(convs):
    """convs: id -> list of (role, text)."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, at in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(at) - 1) * (len(node[-1][1]) if node else 0)
            leaves[node[:d]] += not children[node]
    return sorted(
        (
            min(at), len(node), min(members[node[:-1]]) if node else -1, len(at), children[node], leaves[node], saved[node],
            hashlib.sha256(",".join(str(c) for c in sorted(c for c in at if len(convs[c]) == len(node))).encode()).hexdigest(),
        )
        for node, at in members.items()
    )


def got(df):
    return sorted(tuple(-1 if r[f] is None else r[f] for f in FIELDS) for r in df.collect())


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [t[3] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(int(c - (c % 100)), [])[:h] + turns[h:]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for c in [*range(0, 260), 1000, 5000, 5001, 70_007]:
        for t in range(rng.randrange(1, 9)):
            out.append((c, t, rng.choice(("user", "assistant")), rng.choice(("a", "bé", "ccc", "𝄞 d", "", "x" * 300))))
    out += [(c, t, "system", "same") for c in range(300, 380) for t in range(6)]  # copies
    out += [(400, t, "user", f"long {t // 2}") for t in range(700)]
    out += [(401, None, None, None), (401, None, "user", "z"), (401, 3, "user", None), (401, 3, "user", None), (None, 1, "user", "lost")]
    return out


@pytest.fixture
def convs(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    found = prefixtrie.sequences(df.withColumns({c: F.lit("clash") for c in ("units", "key", "n", "part", "name", "base")}))
    head = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    return prefixtrie.rebuilt(found, head, F.col("conv_id") - F.col("conv_id") % 100, 5)


@pytest.mark.parametrize("batch", [4 << 20, 400])
def test_against_brute_force(convs, rows, batch, monkeypatch):
    monkeypatch.setattr(prefixtrie, "BATCH", batch)  # small batches leave many open nodes
    monkeypatch.setattr(prefixtrie, "PIECE", 7)
    assert got(prefixtrie.prefix_trie(convs)) == brute(rebuilt(rows))


def test_nothing_and_turnless(spark, convs):
    assert prefixtrie.prefix_trie(convs.filter("1 = 0")).collect() == []
    empty = convs.filter("conv_id < 3").withColumn("units", F.array().cast("array<string>"))
    assert got(prefixtrie.prefix_trie(empty)) == brute({0: [], 1: [], 2: []})


words = st.lists(st.lists(st.sampled_from("abc"), max_size=12), max_size=40)


@settings(max_examples=150, deadline=None)
@given(words)
def test_trie_finds_the_deepest_prefix(lists):
    trie, held = ZFast(), set()
    for units in lists:
        key = Key([u.encode() for u in units])
        node = trie.parent(key)
        depths = {n.high for n in trie.bottom_up() if n.key.names[n.high] in set(key.names)}
        assert node.high == max(depths)
        trie.insert(key, tuple(units))
        held.add(tuple(units))
    ends = {n.ends for n in trie.bottom_up() if n.ends is not None}
    assert ends == held and all(trie.table[n.handle()] is n for n in trie.bottom_up() if n.high)
    assert len(trie.table) == len(trie.bottom_up()) - 1 <= 2 * len(held)


def test_probes_grow_with_the_logarithm_of_the_length():
    trie = ZFast()
    for n in range(1, 200):
        trie.insert(Key([b"x"] * n), n)
    trie.probes = 0
    assert trie.parent(Key([b"x"] * 4000)).high == 199 and trie.probes <= 13


def test_two_fattest():
    for low in range(40):
        for high in range(low + 1, 70):
            best = max(range(low + 1, high + 1), key=lambda x: x & -x)
            assert two_fattest(low, high) == best


@settings(max_examples=60, deadline=None)
@given(words, st.integers(1, 5))
def test_batches_add_up(lists, size):
    """Any cut of the sorted sequences into batches gives the same sums."""
    keys = sorted({b"".join(u.encode() * 16 + len(u).to_bytes(4, "big") for u in x) for x in lists})
    rows = [(k, i % 3 + 1, i, prefixtrie._EMPTY) for i, k in enumerate(keys)]

    def sums(step):
        out = defaultdict(lambda: [0] * 4)
        for i in range(0, len(rows), step):
            before, after = (rows[i - 1][0] if i else None), (rows[i + step][0] if i + step < len(rows) else None)
            for name, *_, n, children, leaves, saved, _, open_ in prefixtrie.batch_nodes(before, rows[i : i + step], after):
                assert open_ or name not in out
                out[name] = [a + b for a, b in zip(out[name], (n, children, leaves, saved), strict=True)]
        return dict(out)

    assert sums(size) == sums(max(1, len(rows)))
