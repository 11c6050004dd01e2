import random
from itertools import pairwise

import numpy as np
import pytest
from tokenizers import Tokenizer

from jobfacts.llm import lengths, packing, queries, tokens


@pytest.fixture(scope="module")
def library():
    out = Tokenizer.from_file(queries.vocabulary())
    return lambda t: out.encode(t, add_special_tokens=False).ids


def test_ids_are_those_of_the_library(texts, library, monkeypatch):
    encode = tokens.encoder(queries.vocabulary())
    for t in texts:
        assert encode.ids(t or "").tolist() == library(t or "")
    monkeypatch.setattr(tokens, "PIECE", 50)
    for t in texts[:60]:
        assert encode.ids(t or "").tolist() == library(t or "")


def test_strings_of_added_tokens_are_tokens(library):
    encode = tokens.encoder(queries.vocabulary())
    end = "<|endoftext|>"
    for t in (end, end + end, f"hello {end} world", f"{end}a", f"a{end}", f" {end} ", f"x{end}\n{end}  y", "<|endoftext", f"<{end}>", f"é{end}é."):
        assert encode.ids(t).tolist() == library(t)
        ids = encode.ids(t)
        assert encode.n_bytes[ids].sum() == len(t.encode())
    assert encode.ids(f"hello {end} world").tolist() == [31373, 220, 50256, 995]


def whole(docs, pieces, library, limit):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for r in docs.select("doc_id", "text").distinct().collect():
        want = [*library(r.text or ""), 1]
        parts = sorted(by_doc.pop(r.doc_id), key=lambda p: (p.start, p.sequence_id))
        copies = len(parts) if len(want) == 1 else sum(p.start == 0 for p in parts)
        assert sum(p.length for p in parts) == copies * len(want) and all(p.doc_tokens == len(want) for p in parts)
        for p in parts:
            assert np.frombuffer(p.ids, "<u4").tolist() == want[p.start : p.start + p.length]
    assert not by_doc
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p.offset)
        assert parts[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in pairwise(parts))
        assert parts[-1].offset + parts[-1].length <= limit


@pytest.mark.parametrize("limit, block", [(2048, 1 << 20), (256, 1000)])
def test_every_id_in_one_piece(docs, library, monkeypatch, limit, block):
    monkeypatch.setattr(packing, "BLOCK", block)
    pieces = packing.pack(docs, queries.vocabulary(), limit, 1).collect()
    whole(docs, pieces, library, limit)


def test_little_padding(spark):
    rng = random.Random(3)
    rows = [(i, "".join("word " * rng.randrange(3, 20) + ".\n" for _ in range(rng.randrange(1, 40)))) for i in range(800)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), queries.vocabulary()).groupBy("sequence_id").agg({"length": "sum"}).collect()
    sizes = [r[1] for r in pieces]
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes)
    assert padding < 0.01 * sum(sizes)


def test_cuts_cost_the_least():
    rng = random.Random(1)
    for _ in range(40):
        limit = 64
        places = np.cumsum([0, *(rng.randrange(1, 40) for _ in range(rng.randrange(1, 40)))])
        cost = np.array([0, *(rng.choice([0, 1, 32]) for _ in places[1:])])
        best, came = packing.best_cuts(places, cost, limit)
        want = [0.0] * len(places)
        for j in range(1, len(places)):
            options = []
            for i in range(j):
                n = int(places[j] - places[i])
                if n <= limit:
                    exact = n >= limit // 8 and n & (n - 1) == 0
                    options.append(want[i] + (0 if exact else limit - n))
            want[j] = min(options) + int(cost[j]) + packing.PER_SEQUENCE
        assert best == want and all(places[j] - places[came[j]] <= limit for j in range(1, len(places)))


def test_nothing(nothing):
    assert packing.pack(nothing, queries.vocabulary()).collect() == []
    assert lengths.limits(lengths.histogram(nothing, queries.vocabulary())).collect() == []


def test_histogram_and_limits(docs, library, monkeypatch):
    monkeypatch.setattr(lengths, "BUCKET", 16)
    all_lengths = [len(library(r.text or "")) for r in docs.select("text").collect()]
    got = lengths.limits(lengths.histogram(docs, queries.vocabulary())).collect()
    assert sorted(r.length for r in got) == sorted(set(all_lengths))
    for r in got:
        at_least = [n for n in all_lengths if n >= r.length]
        cut = sum(min(n, r.length) for n in all_lengths)
        assert (r.n_docs, r.n_tokens) == (all_lengths.count(r.length), all_lengths.count(r.length) * r.length)
        assert (r.docs_at_least, r.tokens_at_least) == (len(at_least), sum(at_least))
        assert (r.truncated_tokens, r.lost_tokens) == (cut, sum(all_lengths) - cut)
        assert r.share_shorter == pytest.approx(1 - len(at_least) / len(all_lengths))


def test_quantiles(docs, library):
    ordered = sorted(len(library(r.text or "")) for r in docs.select("text").collect())
    report = lengths.limits(lengths.histogram(docs, queries.vocabulary()))
    shares = [0.1, 0.5, 0.9, 1.0]
    want = {s: next(n for n in sorted(set(ordered)) if sum(x <= n for x in ordered) / len(ordered) >= s - 1e-12) for s in shares}
    assert {r.share: r.length for r in lengths.quantiles(report, shares).collect()} == want
