import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import brute_words
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobfacts.llm import ngram, queries
from jobfacts.llm.eliasfano import EliasFano, Trie


def model(rows, held):
    """Scores by dictionaries: (tokens, known, N, base, score) for each row in order."""
    tokens = [brute_words(r.text) + [None] for r in rows]
    c, pairs, triples = Counter(), Counter(), Counter()
    for r, ws in zip(rows, tokens):
        if not held(r):
            c.update(ws)
            pairs.update(zip([None, *ws], ws))
            triples.update(zip([None, *ws], ws, ws[1:]))
    n, v = sum(c.values()), len(c)
    once, twice = (sum(x == k for x in c.values()) for k in (1, 2))
    d = once / (once + 2 * twice) if once + twice else 0.5
    out = []
    for ws in tokens:
        base = score = 0.0
        for t, u, w in zip([0, None, *ws], [None, *ws], ws):
            base += math.log10((c[w] + 1) / (n + v + 1))
            chance = ((c[w] - d) / n if c[w] else d * v / n) if n else 1.0
            for seen, total in ((pairs[u, w], c[u]), (triples[t, u, w], pairs[t, u] if t != 0 else 0)):
                weight = ngram.WEIGHT * total / (total + 1)
                chance = (weight * seen / total if total else 0) + (1 - weight) * chance
            score += math.log10(chance)
        out.append((len(ws), sum(c[w] > 0 for w in ws), n, base, score))
    return out


def held(r):
    return r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2


def test_buckets_are_limited_and_no_table_stays(spark, docs, monkeypatch):
    monkeypatch.setattr(ngram, "CHUNK_BYTES", 5_000)
    want = {tuple(r) for r in ngram.score(docs, queries.held_out(7)).collect()}
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "9")
    try:
        got = {tuple(r) for r in ngram.score(docs, queries.held_out(7)).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.maxBuckets")
    assert got == want and not [t for t in spark.catalog.listTables() if t.name.startswith("chunks_")]


def test_a_directory_is_small():
    values = np.arange(0, 10**6, 7, dtype=np.uint64)
    level = EliasFano.of(values)
    assert level.ranks.nbytes < 0.5 * len(values) and len(level.to_bytes()) < 0.8 * len(values)


@pytest.mark.parametrize("small", [False, True])
def test_against_dictionaries(docs, monkeypatch, small):
    if small:  # several chunks in a task, several shards, contexts split over shards
        for name, value in (("CHUNK_BYTES", 20_000), ("WORD_SHARD", 700), ("PAIR_SHARD", 9000), ("SPLIT", 20)):
            monkeypatch.setattr(ngram, name, value)
    rows = docs.select("doc_id", "text").collect()
    got = ngram.score(docs, queries.held_out(7)).collect()
    key = lambda x: (x[0] is None, x[0] or 0)
    want = sorted(((r.doc_id, held(r), *x) for r, x in zip(rows, model(rows, held))), key=key)
    for g, w in zip(sorted(got, key=key), want, strict=True):
        assert tuple(g)[:5] == w[:5]
        assert g.base_score == pytest.approx(w[5], rel=1e-9)
        assert abs(g.score - w[6]) <= w[2] * 0.6 / ngram.STEPS + 1e-9


def test_nothing_to_learn_from(docs, nothing):
    got = ngram.score(docs, F.lit(True)).collect()
    assert {(r.train_tokens, r.n_known, r.score) for r in got} == {(0, 0, 0.0)}
    assert ngram.score(nothing, F.lit(False)).collect() == []


@given(st.lists(st.integers(0, 2**45), max_size=300))
def test_sequence(values):
    values = np.array(sorted(values), np.uint64)
    level, size = EliasFano.from_buffer(EliasFano.of(values).to_bytes() + b"rest")
    assert size + 4 == len(EliasFano.of(values).to_bytes() + b"rest")
    assert (level[np.arange(len(values))] == values).all()
    if len(values):
        targets = np.array([0, *values.tolist(), int(values[-1]) + 1], np.uint64)
        n = len(targets)
        got = level.successor(targets, np.zeros(n, np.int64), np.full(n, len(values)))
        assert (got == np.searchsorted(values, targets)).all()


def test_trie_from_a_mapped_file(tmp_path):
    rng = random.Random(4)
    grams = sorted({(rng.randrange(1, 300), rng.randrange(1, 5000)) for _ in range(4000)})
    context, word = (np.array(x, np.int64) for x in zip(*grams))
    codes = np.array([rng.randrange(60000) for _ in grams])
    (tmp_path / "level").write_bytes(Trie.of(context, word, codes).to_bytes())
    trie = Trie.from_buffer(np.memmap(tmp_path / "level", np.uint8, "r"))
    known = dict(zip(grams, codes.tolist()))
    asked = [(rng.randrange(0, 310), rng.randrange(0, 5001)) for _ in range(3000)] + grams
    got = trie.lookup(*(np.array(x, np.int64) for x in zip(*asked)), ngram.ABSENT)
    assert got.tolist() == [known.get(g, ngram.ABSENT) for g in asked]


@given(st.dictionaries(st.tuples(st.integers(1, 9), st.integers(1, 9)), st.lists(st.integers(1, 40), unique=True, max_size=6), max_size=30))
def test_third_words(following):
    """Every trigram is found from its bigram's place, also where bigrams have none; others are not."""
    grams = sorted(following)
    context, word = (np.array([g[k] for g in grams], np.int64) for k in (0, 1))
    third = np.array([w for g in grams for w in sorted(following[g])], np.int64)
    widths = np.array([len(following[g]) for g in grams], np.int64)
    trie = Trie.of(context, word, np.arange(len(grams)), (widths, third, np.arange(len(third))))
    trie = Trie.from_buffer(trie.to_bytes())
    numbers = {(*g, w): i for i, (g, w) in enumerate((g, w) for g in grams for w in sorted(following[g]))}
    asked = [*numbers, *((u, v, w) for u in (0, 1, 5, 10) for v in (1, 5, 9) for w in (0, 1, 20, 41))]
    u, v, w = (np.array([x[k] for x in asked], np.int64) for k in range(3))
    place = trie.levels[0].find(trie.roots(u), v)
    got = trie.codes(3, trie.levels[1].find(place, w), ngram.ABSENT)
    assert got.tolist() == [numbers.get(x, ngram.ABSENT) for x in asked]


def test_packed_numbers():
    for values in ([], [0], [1, 255], [256, 3, 65535], [1 << 20, 0, 7], [1 << 40, 1 << 63 - 1 - 8, 5]):
        assert ngram.unpack_ints(ngram.pack_ints(np.array(values, np.int64))).tolist() == values


def test_a_longer_context_helps(docs):
    """Held-out texts are likelier than under single words, and a text that training knows likelier than a new one of its words."""
    known = "one two three four five six seven eight nine ten"
    rows = [(i, known if i < 9 else f"{i} other words here", i == 20) for i in range(20)]
    rows += [(20, known, True), (21, " ".join(reversed(known.split())), True)]
    spark = docs.sparkSession
    made = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    got = {r.doc_id: r for r in ngram.score(made, F.col("held")).collect()}
    assert got[20].score > got[20].base_score / 2 and got[20].score > got[21].score + 3
