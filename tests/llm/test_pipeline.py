"""The pipeline over a small folder of its own, and the SQL twins of the operators' queries."""

import random

import pytest
from brute import contaminated, link_components
from compare import compare, duck
from conftest import prose
from tokenizers import Tokenizer

import corpus_pipeline
from jobfacts.llm import queries


@pytest.fixture(scope="module")
def folder(spark, docs, texts, tmp_path_factory):
    rng = random.Random(2)
    out = str(tmp_path_factory.mktemp("tables"))
    items = [(k, prose(rng, 25)) for k in range(5)] + [(9, None)]
    planted = [(1000 + k, prose(rng, 30) + " " + items[k][1] + " " + prose(rng, 9), "en", "s") for k in range(5)]
    more = spark.createDataFrame(planted, "doc_id long, text string, lang string, source string")
    docs.unionByName(more, allowMissingColumns=True).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, items


def test_against_brute_force(spark, folder):
    out, items = folder
    rows = spark.read.parquet(f"{out}/documents.parquet").select("doc_id", "text").collect()
    rows = [r for r in rows if any(c.isalpha() for c in r.text or "")]
    last = {}
    for r in rows:
        if r.text not in last or (r.doc_id or -1) > (last[r.text].doc_id or -1):
            last[r.text] = r
    rows = list(last.values())
    near = link_components(rows)
    rows = [r for r in rows if r.doc_id is None or near[r.doc_id][2]]
    rows = [r for r in rows if not contaminated(r.text, items)[1]]
    library = Tokenizer.from_file(queries.vocabulary())
    want = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in rows}
    got = {}
    for p in corpus_pipeline.run(spark, out).collect():
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == want and 20 < len(want) < 150


def test_rows_of_one_id_are_decided_on_one_by_one(spark, tmp_path):
    rng = random.Random(4)
    clean, leak, body, more = prose(rng, 60), prose(rng, 30), prose(rng, 80), prose(rng, 80)
    rows = [(1, clean), (1, leak), (2, leak + " too"), (None, body), (None, "123 !"), (None, body + " end"), (3, more), (3, more + " end"), (4, more + "  end.")]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert (1, clean) in left and len(left) == 3
    assert sum(i is None and t.startswith(body) for i, t in left) == 1 and sum(i == 3 for i, t in left) == 1


def test_stages_keep_the_columns(spark, folder):
    out, _ = folder
    docs = spark.read.parquet(f"{out}/documents.parquet")
    nothing = docs.filter("1 = 0")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, out).columns == docs.columns
        assert stage(spark, nothing, out).collect() == []
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf, name):
    assert compare(spark, duck(sf), name, sf) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_runs(spark, sf, name):
    table = "pages" if "warc" in name else "documents"
    n = spark.read.parquet(f"{sf}/{table}.parquet").count()
    got = queries.QUERIES[name](spark, sf).count()
    assert got == n or name in ("op1_packing", "op9_token_counts") and got > 0


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
