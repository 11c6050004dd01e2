import hashlib
import random

from brute import contaminated, window_words
from pyspark.sql import functions as F

from jobfacts.llm import decontam


def cases(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(60)] + ["the", "of", "Ä1", "É", "é", "x9"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, say(rng.randrange(10, 40))) for k in range(12)]
    items += [(20, "one Only"), (21, None), (22, "..."), (23, "the the the the the the the the the the the the"), (24, "É É"), (None, items[0][1][5:]), items[2], (2, say(15)), (25, "never-Seen word here")]
    docs = []
    for i in range(60):
        body = say(rng.randrange(0, 60)).split(" ")
        for _ in range(rng.randrange(0, 3)):
            item = (items[rng.randrange(12)][1] or "").split(" ")
            a = rng.randrange(len(item))
            at = rng.randrange(len(body) + 1)
            body[at:at] = item[a : a + rng.randrange(4, 30)]
        docs.append((i, rng.choice([", ", " ", "\n"]).join(body)))
    docs += [(100, None), (101, ""), (102, "ONE only"), (103, "the " * 30), (104, "é é"), (105, "É,É"), (None, items[3][1].upper()), (106, items[1][1] + " " + "q " * 50_000 + items[1][1])]
    docs += [docs[5], (100, items[5][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("row_key", "w", "spans", "item", "term")})
    return df.repartition(4), spark.createDataFrame(items, "item_id long, text string").withColumn("terms", F.lit(1)), docs, items


def test_against_brute_force(spark):
    df, bench, docs, items = cases(spark)
    want = []
    for i, text in docs:
        n, hit, found = contaminated(text, items)
        want.append((str(i), n, len(hit), sorted(str(x) for x in found if x is not None), bool(hit)))
    got = decontam.contamination(df, bench).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, sorted(map(str, r["items"])), r.contaminated) for r in got) == sorted(want)
    assert sum(r.contaminated for r in got) > 20
    for r in got:
        assert sum(e - s for s, e in (r.spans or [])) >= r.n_hit


def test_nothing(spark):
    df, bench, docs, _ = cases(spark)
    assert decontam.contamination(df.filter("1 = 0"), bench).collect() == []
    clean = decontam.contamination(df, bench.filter("1 = 0")).collect()
    assert len(clean) == len(docs) and not any(r.contaminated for r in clean)


def test_end_of_an_item_is_no_window(spark):
    words = [f"v{k}" for k in range(14)]
    items = [(1, " ".join(words)), (2, "one two")]
    texts = [" ".join(words[-7:]), " ".join(words[:7]), " ".join(words[-10:]), "x " + " ".join(words[-7:]), " ".join(words[-7:]) + " x", "two", *(" ".join(words[-k:]) for k in range(1, 13))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontam.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {i: (n, len(hit)) for i, t in enumerate(texts) for n, hit, _ in [contaminated(t, items)]}
    assert {r.doc_id: (r.n_words, r.n_hit) for r in got} == want
    assert want[0] == (7, 0) and want[2] == (10, 10)


def test_filter_never_stops_a_right_key(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("h"))
    bits = decontam.fixed_filter(keys, "h")
    assert keys.filter(decontam.passes(bits, F.col("h"))).count() == 3000
    others = spark.range(10_000, 20_000).select(F.xxhash64("id").alias("h"))
    assert others.filter(decontam.passes(bits, F.col("h"))).count() < 200


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x x b x x x x a"), (2, "b a"), (3, "a " + "x " * 9 + "b")], "doc_id long, text string")
    places = decontam.positions(docs)
    names = {r[0]: r[1] for r in docs.select(decontam.row_key("doc_id", "text"), "doc_id").collect()}
    pairs = spark.createDataFrame([("p", "a", "b")], "pair string, a string, b string")
    got = {(names[r.row_key], r.pos_a, r.pos_b) for r in decontam.proximity_matches(places, pairs, 3).collect()}
    assert got == {(1, 0, 3), (2, 1, 0)}


def test_no_python_runs(spark, sf, plan):
    from jobfacts.llm import queries

    assert not any(x in plan(queries.op7_decontamination(spark, sf)) for x in ("Python", "Pandas", "Arrow"))
    assert hashlib.sha256(b"").hexdigest() in {r.items_sha256 for r in queries.op7_decontamination(spark, sf).collect()}


def nodes(text, word):
    """The operators of a formatted plan that name `word`."""
    return [x for x in text.split("\n\n") if x.startswith("(") and word in x]


def test_a_word_costs_no_work_on_its_whole_text(spark, sf, plan):
    text = plan(decontam.positions(spark.read.parquet(f"{sf}/documents.parquet")))
    assert len(nodes(text, "xxhash64(")) == 1
    assert not any("pos#" in x for x in nodes(text, "xxhash64("))  # the document's key is made before its words are


def test_places_are_confirmed_once(spark, sf, plan):
    docs, items = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "benchmark"))
    text = plan(decontam.contamination(docs, items))
    assert len(nodes(text, "slice(")) == 1
    assert not nodes(text, "regexp")  # words are counted as they are split everywhere else


def test_number_of_words(spark):
    texts = [None, "", " ", "...", "a", " a", "a ", ", a--b9 .", "\x00a\x7fb\x80c", "É😀 Z{z}~", "x" * 5000, "\n".join("ab" * 700)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontam.contamination(docs, spark.createDataFrame([(1, "q r s")], "item_id long, text string")).collect()
    assert {r.doc_id: r.n_words for r in got} == {i: len(window_words(t)) for i, t in enumerate(texts)}
    assert not any(r.contaminated for r in got) and all(r.spans is None for r in got)
