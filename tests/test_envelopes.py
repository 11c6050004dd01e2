import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from jobfacts.plans import files, views
from jobfacts.sources import envelopes
from jobfacts.sources.envelopes import Splitter, measure

ODD = ['plain', 'a "quoted" one', "back\\slash", 'end\\"', "}{][", '"}', "\\", "ünï 𝄞", "tab\tnew\nline", ""]


def answer(rng, n):
    def value(depth):
        kind = rng.randrange(6 if depth < 3 else 3)
        if kind < 3:
            return rng.choice([*ODD, 5, None, True])
        if kind == 3:
            return [value(depth + 1) for _ in range(rng.randrange(3))]
        return {rng.choice(ODD) + str(k): value(depth + 1) for k in range(rng.randrange(3))}

    jobs = [{"job_id": i, **{rng.choice(ODD): value(0) for _ in range(rng.randrange(5))}} for i in range(n)]
    others = {"meta": value(0), "lists": [["}", {"jobs": [{}]}], [], [[{}]], {"job_id": "}"}], "errors": [{"jobs": [{"x": "}"}]}, {}], "odd } name": ["}", "{"]}
    names = [*others, "jobs", "zz", "warnings"]
    body = {**others, "jobs": jobs, "zz": [{"job_id": "no"}], "warnings": []}
    rng.shuffle(names)
    return {k: body[k] for k in names}


@pytest.mark.parametrize("block", [300, 5000, 1 << 20])
def test_records_of_files_cut_anywhere(spark, tmp_path, block):
    rng = random.Random(block)
    want = []
    for k in range(4):
        body = answer(rng, rng.choice((0, 1, 60, 200)))
        want += body["jobs"]
        (tmp_path / f"{k}.json").write_text(json.dumps(body, indent=k % 2 or None, ensure_ascii=k < 2) + "\n" * (k % 3))
    long = {"jobs": [{"job_id": "long", "x": "}" * 4000}, {"job_id": "after"}]}
    want += long["jobs"]
    (tmp_path / "9.json").write_text(json.dumps(long))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "50")
    try:
        got = [json.loads(r.text) for r in envelopes.read_records(spark, str(tmp_path), "jobs").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    key = lambda x: json.dumps(x, sort_keys=True)
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) > 50


def test_no_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"jobs": []}')
    (tmp_path / "b.json").write_text('{"other": [{"job_id": 1}], "jobs": null}\n')
    assert envelopes.read_records(spark, str(tmp_path), "jobs").collect() == []


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12))
def test_blocks_join_up(seed, size):
    """Any cut of the pieces into blocks gives the same records."""
    rng = random.Random(seed)
    body = answer(rng, 6)
    pieces = json.dumps(body).split("}")[:-1]
    found, held, opened, depth, key = [], "", False, 0, None
    for at in range(0, len(pieces), size):
        splitter, part = Splitter(opened, depth), pieces[at : at + size]
        for piece in part:
            done = splitter.feed(piece)
            name = splitter.key if splitter.seen else key
            if done is not None:
                found.append((name, held + done[0] if not done[1] else done[0]))
                held = "" if not done[1] else held
            opened, deeper = measure(piece, opened)
            depth += deeper - (not opened)
        key = splitter.key if splitter.seen else key
        held = (held if splitter.held == "cut" else "") + "".join(splitter.text)
        assert (splitter.inside, splitter.depth) == (opened, depth)
    assert [json.loads(t) for k, t in found if k == "jobs"] == body["jobs"]


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40))
def test_records_cut_at_once_are_those_of_single_pieces(seed, size):
    rng = random.Random(seed)
    pieces = json.dumps(answer(rng, 25), ensure_ascii=False, indent=seed % 2 or None).split("}")[:-1]
    begin = rng.randrange(len(pieces))
    opened, depth = False, 0
    for piece in pieces[:begin]:
        opened, deeper = measure(piece, opened)
        depth += deeper - (not opened)
    one, many = Splitter(opened, depth), Splitter(opened, depth)
    for at in range(begin, len(pieces), size):
        part = pieces[at : at + size]
        want = [(*done, one.key, one.seen) for piece in part if (done := one.feed(piece)) is not None]
        assert list(many.feed_all(part)) == want
        assert (many.inside, many.depth, many.held, "".join(many.text)) == (one.inside, one.depth, one.held, "".join(one.text))


def test_many_records_are_cut_at_once(monkeypatch):
    calls, feed = [], Splitter.feed
    monkeypatch.setattr(Splitter, "feed", lambda self, piece: calls.append(piece) or feed(self, piece))
    pieces = json.dumps({"jobs": [{"job_id": i, "x": {"y": 'a "}" \\ b'}} for i in range(1000)]}).split("}")[:-1]
    splitter, found = Splitter(False, 0), []
    for at in range(0, len(pieces), 100):
        found += [json.loads(text)["job_id"] for text, *_ in splitter.feed_all(pieces[at : at + 100])]
    assert found == list(range(1000)) and len(calls) <= 300


def test_all_jobs_are_in_answers_of_the_tasks_that_write(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "shared_folder", lambda spark, purpose: str(tmp_path / "answers"))
    dump = views.slurm_dump(spark, sf)
    monkeypatch.setattr(views, "slurm_dump", lambda spark, sf: dump.repartition(3))
    got = sorted(r[0] or "" for r in files.slurm_jobs(spark, sf, "ranges").select("job_id").collect())
    assert got == sorted(r[0] or "" for r in dump.select("job_id").collect())
    sizes = [len(json.loads(f.read_text())["jobs"]) for f in (tmp_path / "answers").glob("part-*")]
    assert len(sizes) == 3 and sum(sizes) == len(got) and min(sizes) > 0
