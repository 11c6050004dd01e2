import random
from collections import defaultdict
from difflib import SequenceMatcher

from hypothesis import given
from hypothesis import strategies as st

from jobfacts.llm import linededup

LONG = [f"this is the long line number {i}" for i in range(30)]
TEXTS = [
    "\n".join([*LONG[:6], "end"]),
    "\n".join(["start", *LONG[2:5], "mid", LONG[10]]),
    "\n".join([LONG[10], LONG[2], "  " + LONG[3] + " ", "end"]),
    None,
    "",
    "\n\n\n",
    "end",
    "\n".join(LONG[20:23] * 3),
    "\n".join([LONG[21], "end", LONG[20], LONG[22], ""]),
    "\n".join(LONG),
    "\n".join(reversed(LONG)),
    "\n".join([LONG[0], "end"] * 400),
]


def brute(rows):
    lines = {i: [x.strip(" ") for x in (t or "").split("\n")] for i, t in rows}
    first = {}
    for i in sorted(lines):
        for x in lines[i]:
            first.setdefault(x, i)
    out = {}
    for i in sorted(lines):
        shared = defaultdict(set)
        for x in lines[i]:
            if len(x.split()) >= 5 and first[x] < i:
                shared[first[x]].add(x)
        gone, owners = set(), set()
        for o, rare in shared.items():
            places = linededup.common_blocks(lines[o], lines[i], rare)
            gone |= set(places)
            owners |= {o} if places else set()
        out[i] = sorted(gone), sorted(owners)
    return out


def test_against_brute_force(spark):
    rows = list(enumerate(TEXTS))
    df = spark.createDataFrame([*rows, (None, TEXTS[0])], "doc_id long, text string").selectExpr("*", "1 AS line", "2 AS owner", "3 AS removed").repartition(4)
    want = brute(rows)
    got = linededup.without_repeated_lines(df).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r.doc_id is None:
            assert r.text == TEXTS[0] and r.n_removed == 0
            continue
        text = TEXTS[r.doc_id]
        gone, owners = want[r.doc_id]
        assert (r.removed, r.owners, r.n_removed) == (gone, owners, len(gone))
        assert r.n_lines == (0 if text is None else len(text.split("\n")))
        left = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in set(gone))
        assert r.text == left
    assert want[1][0] == [1, 2, 3] and want[9][0]


def test_every_long_line_stays_somewhere(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    left = {x.strip(" ") for r in linededup.without_repeated_lines(df).collect() for x in (r.text or "").split("\n")}
    assert {x.strip(" ") for t in TEXTS for x in (t or "").split("\n") if len(x.split()) >= 5} <= left


def test_rows_that_share_an_id(spark):
    """Only what an earlier text has goes, whichever id it stands under."""
    a = "\n".join([LONG[1], LONG[2], "only in a", LONG[9]])
    b = "\n".join(["first of b", LONG[1], LONG[2], LONG[7], LONG[9]])
    rows = [(5, a), (5, b), (-3, "\n".join([LONG[9], "x"])), (5, a)]
    for find in (linededup.repeated_lines, linededup.lines_repeated_anywhere):
        got = linededup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), find=find).collect()
        left = {x for r in got for x in r.text.split("\n")}
        assert left == {x for _, t in rows for x in t.split("\n")} and len(got) == 4
        assert {r.doc_id: r.n_removed for r in got}[-3] == 0
        by_size = sorted((r.n_removed, r.n_lines) for r in got if r.doc_id == 5)
        assert by_size in ([(1, 4), (1, 4), (3, 5)], [(1, 5), (3, 4), (3, 4)])


def test_nothing(spark):
    assert linededup.without_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@given(st.lists(st.integers(0, 9), max_size=25), st.lists(st.integers(0, 9), max_size=25))
def test_alignment_rises_and_is_equal(a, b):
    got = linededup.patience(a, b)
    assert all(a[i] == b[j] for i, j in got)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
    if len(set(a)) == len(a) and a == b:
        assert len(got) == len(a) == sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())


def test_repeated_passages_align():
    a, b, x, y = 101, 102, 1, 2
    rare = {a, b}
    assert linededup.common_blocks([x, a, b, y], [7, a, b, 8, a, b, 9], rare) == [1, 2, 4, 5]
    assert linededup.common_blocks([7, a, b, 8, a, b, 9], [x, a, b, y], rare) == [1, 2]
    assert linededup.common_blocks([7, a, b, 8, a, b, 9], [5, a, b, 6, a, b, 4, a, b, 3], rare) == [1, 2, 4, 5, 7, 8]
    assert linededup.common_blocks([7, a, 3, b, 8], [5, a, 3, b, 6, a, 3, 9, 3, 3, b], rare) == [1, 2, 3, 5, 6, 9, 10]
    assert linededup.common_blocks([7, 3, 8], [3, 9, 3], rare) == []


@given(st.lists(st.integers(0, 4), max_size=25), st.lists(st.integers(0, 4), max_size=25))
def test_no_common_line_is_left_between_aligned_ones(a, b):
    got = [(-1, -1), *linededup.patience(a, b), (len(a), len(b))]
    assert all(not set(a[i + 1 : m]) & set(b[j + 1 : n]) for (i, j), (m, n) in zip(got, got[1:]))


def test_anywhere_is_all_pairs(spark):
    rng = random.Random(3)
    texts = [*TEXTS, *("\n".join(rng.choice([*LONG[:8], "end", "mid", ""]) for _ in range(rng.randrange(1, 12))) for _ in range(90))]
    lines = [[x.strip(" ") for x in (t or "").split("\n")] for t in texts]
    long = [{x for x in held if len(x.split()) >= 5} for held in lines]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in linededup.without_repeated_lines(df, find=linededup.lines_repeated_anywhere).collect()}
    by_owner = {r.doc_id: r.removed for r in linededup.without_repeated_lines(df).collect()}
    for i in range(len(texts)):
        want = set()
        for o in range(i):
            if long[i] & long[o]:
                want |= set(linededup.common_blocks(lines[o], lines[i], long[i] & long[o]))
        assert got[i].removed == sorted(want)
    assert sum(len(x) for x in by_owner.values()) < sum(r.n_removed for r in got.values())
