import gzip
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobfacts.llm import queries, warc
from jobfacts.session import shared_folder

HTMLS = ["<p>a</p>", "", None, "x\r\n\r\nWARC/1.1\r\n\r\n", "ä" * 70_000, "<p>a</p>", "", "same", "same", "same", "\x00 \r\n"]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"https://www.Site{i % 3}.example:443/p{i % 2}?q={i}", h) for i, h in enumerate(HTMLS)]
    rows += [(None, None, "same"), (None, "http://u@h.org", "alone"), (3, "bad\r\nurl\x01", HTMLS[3]), rows[7], (20, "", "b")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("owner", "value", "run", "offset")})


def owners(rows):
    best = defaultdict(list)
    for r in rows:
        best[r.html or ""].append(r.page_id)
    return {h: max((i for i in ids if i is not None), default=None) for h, ids in best.items()}


@pytest.mark.parametrize("records", [2000, 3])
def test_round_trip(spark, pages, monkeypatch, records):
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", records)
    monkeypatch.setattr(warc, "MERGE_ENTRIES", records)
    rows = pages.collect()
    best = owners(rows)
    want = []
    for r in rows:
        body, own = (r.html or "").encode(), best[r.html or ""]
        response = r.page_id == own
        want.append((str(r.page_id), len(body), warc.payload_digest(body), "response" if response else "revisit", None if response else own))
    date = F.timestamp_seconds(F.lit(1704067200) + F.coalesce("page_id", F.lit(0)) % 2)
    got = warc.capture_index(pages, 0, date).collect()
    assert sorted(map(repr, ((str(g.page_id), g.payload_bytes, g.payload_digest, g.record_type, g.refers_to) for g in got))) == sorted(map(repr, want))
    keys = [(g.urlkey, g.timestamp, g.page_id is not None, g.page_id or 0) for g in got]
    assert keys == sorted(keys)
    assert {g.urlkey for g in got} >= {"-", "example,site0)/p0?q=0", "org,h)/"}


def test_small_payloads_are_all_responses(spark, pages):
    got = warc.capture_index(pages, 5).collect()
    assert {g.record_type for g in got if g.payload_bytes < 5} == {"response"}
    assert "revisit" in {g.record_type for g in got}


def archives(spark, folder):
    rows = spark.read.format("binaryFile").load(folder).filter("path NOT LIKE '%SUCCESS'").collect()
    return {r.path.rpartition("/")[2]: bytes(r.content) for r in rows}


@pytest.mark.parametrize("member", [warc.MEMBER_BYTES, 700])
def test_archives_are_warc(spark, pages, monkeypatch, member):
    """A record is what stands at its place, read alone; an archive is also one gzip file as a whole."""
    monkeypatch.setattr(warc, "MEMBER_BYTES", member)
    folder = shared_folder(spark, "archive-test")
    warc.write_archives(pages, folder)
    index = warc.runs(spark, folder).collect()
    assert len(index) == pages.count()
    for name, content in archives(spark, folder).items():
        mine = sorted((x.offset, x.length) for x in index if x.archive == name)
        assert [at for at, _ in mine] == [0, *(at + n for at, n in mine)][:-1] and sum(n for _, n in mine) == len(content)
        parts = [gzip.decompress(content[at : at + n]) for at, n in mine]
        assert b"".join(parts) == gzip.decompress(content)
        for part in parts:
            assert part.startswith(b"WARC/1.1\r\nWARC-Type: ") and part.endswith(b"\r\n\r\n")
        for at, n in mine:
            assert len(zlib.decompressobj(31).decompress(content[at : at + n])) <= member


def test_archives_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    rng = random.Random(3)
    htmls = [rng.randbytes(n).hex() for n in [100] * 40 + [5000] + [100] * 5]
    pages = spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string").withColumn("url", F.lit("http://a.org/")).coalesce(1)
    folder = shared_folder(spark, "archive-test")
    warc.write_archives(pages, folder)
    files = archives(spark, folder)
    assert len(files) > 5 and sorted(map(len, files.values()))[-2] <= 3000
    assert warc.runs(spark, folder).count() == 46


def test_payloads_by_place_and_length(spark, pages):
    folder = shared_folder(spark, "archive-test")
    warc.write_archives(pages, folder, 0)
    index = warc.merged(warc.runs(spark, folder))
    got = {(r.page_id, r.payload_digest): r for r in warc.payloads(spark, folder, index).collect()}
    for r in pages.collect():
        body = (r.html or "").encode()
        g = got[r.page_id, warc.payload_digest(body)]
        assert g.payload == (body if g.record_type == "response" else None)
        if g.refers_to is not None:
            assert got[g.refers_to, g.payload_digest].payload == body
    assert warc.payloads(spark, folder, index.filter("page_id = 4")).count() == 1


def test_damage_is_noticed():
    import io

    text = warc.record(1, "http://a/", "2024-01-01T00:00:00Z", "body", warc.payload_digest(b"body"), None, False) + warc.END_OF_RECORD
    assert len(list(warc.read_records(io.BytesIO(text.encode()), "x"))) == 1
    for broken in (text.replace("body", "bodx"), text[:-6], "y" + text):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(broken.encode()), "x"))
    whole = warc.packed(text.encode())
    assert [e[-2:] for e in warc.read_records(warc.Members(whole * 2), "x")] == [(0, len(whole)), (len(whole), len(whole))]
    for broken in (whole[:-3], warc.packed((text * 2).encode()), warc.packed(text[:-6].encode())):
        with pytest.raises(ValueError):
            list(warc.read_records(warc.Members(broken), "x"))


def test_nothing(pages):
    assert warc.capture_index(pages.filter("1 = 0")).collect() == []


@given(st.lists(st.lists(st.integers(0, 30), max_size=8), max_size=9))
def test_loser_tree_merges(lists):
    got = list(warc.LoserTree([iter(sorted(x)) for x in lists], lambda x: x))
    assert got == sorted(x for part in lists for x in part)


def test_query_with_equal_payloads(spark, tmp_path):
    """The query and its SQL twin where most pages have one payload, some an empty or null one."""
    rows = [(i, f"http://h{i % 3}.org/{i}", "same" if i % 3 else (None if i % 2 else "")) for i in range(60)]
    rows += [(100 + i, None, f"own {i}") for i in range(5)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in queries.op5_warc(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    names = "page_id, payload_bytes, payload_digest, record_type, refers_to"
    want = sorted(con.execute(f"SELECT {names} FROM ({queries.ORACLE['op5_warc']})").fetchall())
    assert got == want and sum(r[3] == "revisit" for r in got) == 39 + 19
