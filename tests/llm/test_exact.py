import hashlib
from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st

from jobfacts.llm import exact
from jobfacts.llm.patricia import Patricia


def owners(rows, pick):
    ids, size = defaultdict(list), defaultdict(int)
    for r in rows:
        ids[r.text or ""].append(r.doc_id)
        size[r.text or ""] += 1
    keep = {t: pick([i for i in v if i is not None], default=None) for t, v in ids.items()}
    return sorted(
        (r.doc_id is None, r.doc_id or 0, keep[r.text or ""], size[r.text or ""], r.doc_id == keep[r.text or ""], hashlib.sha256((r.text or "").encode()).hexdigest())
        for r in rows
    )


def test_against_brute_force(docs, monkeypatch):
    rows = docs.select("doc_id", "text").collect()
    for largest, trie in ((True, 48 << 20), (False, 2000)):
        monkeypatch.setattr(exact, "TRIE_BYTES", trie)  # a small trie spills subtrees again and again
        got = exact.exact_owners(docs, largest=largest).collect()
        assert sorted((r[0] is None, r[0] or 0, *r[1:]) for r in got) == owners(rows, max if largest else min)


def test_nothing(nothing):
    assert exact.exact_owners(nothing).collect() == []


@given(st.lists(st.tuples(st.binary(max_size=6), st.integers(0, 50)), max_size=60), st.integers(0, 3000))
def test_trie_counts_what_a_dict_counts(rows, down_to):
    trie, out, want = Patricia(min), [], {}
    for key, owner in rows:
        trie.add(key, owner, 1)
        old = want.get(key, (owner, 0))
        want[key] = min(old[0], owner), old[1] + 1
    if down_to:
        out += trie.spill(down_to)
        assert len(trie) <= down_to
    out += trie.spill()
    assert {k: (o, n) for k, o, n in out} == want and len(out) == len(want) and not len(trie)
