import hashlib

import numpy as np
import pyarrow as pa
import pytest

from brute import brute_words, link_components
from jobfacts.llm import graph, neardup, setsketch, words


def test_against_brute_force(docs):
    want = link_components(docs.select("doc_id", "text").collect())
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == want
    assert sum(r.kept for r in got) < 0.8 * len(got)  # there is something to find
    nameless = next(r for r in got if r.doc_id is None)
    assert nameless.component_id is None and nameless.kept


def test_blocks_change_nothing(docs, monkeypatch):
    monkeypatch.setattr(neardup, "BUCKET_BLOCK", 7)
    monkeypatch.setattr(neardup, "FAMILY_BLOCK", 900)
    want = link_components(docs.select("doc_id", "text").collect())
    got = neardup.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == want


def test_rows_that_share_an_id_or_have_none(spark):
    words = [f"w{i}" for i in range(40)]

    def text(*more):
        return " ".join([*more, *words])

    # 1 - 2 - 3 - 4 hold together by two texts of id 2; a text without an id joins 5 and 6
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, text()), (2, text("x")), (2, other), (3, other + " y"), (4, text("z"))]
    a = " ".join(f"u{i}" for i in range(60))
    bridge = a + " e1 e2 e3 e4 e5"
    rows += [(5, a), (None, bridge), (6, bridge + " f1 f2 f3 f4 f5"), (None, "some words that no other text has at all")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    of = {bytes(r.mark): r for r in got}
    assert len(of) == len(rows)
    at = [of[hashlib.md5(t.encode()).digest()] for _, t in rows]
    assert [r.component_id for r in at] == [1, 1, 2, 2, 1, 5, 5, 5, None]
    assert [r.kept for r in at] == [True, False, True, False, False, True, False, False, True]
    assert len({r.component for r in at}) == 4


def test_nothing(nothing):
    assert neardup.near_duplicates(nothing).collect() == []


def test_words_are_those_of_the_pattern(texts, monkeypatch):
    for window in (1 << 20, 37):
        monkeypatch.setattr(words, "WINDOW", window)
        hashes, at = words.word_hashes(pa.array(texts))
        seen = {}
        for i, t in enumerate(texts):
            mine = [w for w in brute_words(t) if w]
            assert at[i + 1] - at[i] == len(mine)
            for w, h in zip(mine, hashes[at[i] : at[i + 1]].tolist()):
                assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[500:3000]
    both = np.unique(np.concatenate([a, b]))
    one = [setsketch.sketch(np.unique(x), np.array([0, len(np.unique(x))]))[0] for x in (a, b, both)]
    assert (np.maximum(one[0], one[1]) == one[2]).all()
    above, below = np.array([(one[0] > one[1]).sum()]), np.array([(one[0] < one[1]).sum()])
    estimate = setsketch.estimate(above, below, np.array([2000.0]), np.array([2500.0]))[0]
    assert estimate == pytest.approx(0.5, abs=0.15)
    for s in (0.2, 0.7):
        assert setsketch.at_least(above, below, np.array([2000.0]), np.array([2500.0]), s)[0] == (estimate >= s)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 160)] + [(160, 130), (7, 7), (300, 299), (299, 300)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {k: 100 for k in range(101, 161)} | {300: 299}
