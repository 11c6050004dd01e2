import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jobfacts.llm import langid, queries
from jobfacts.llm.common import table

SYLLABLES = {"en": "th er on an re he in ed nd ha".split(), "de": "ch ei sch er en ge ie be au ung".split(), "fr": "ou ai que eau en ent le es on re".split(), "xx": "zu ki mo ra ti pu no ke la wi".split()}


def speech(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(8)
    rows = [(i, speech(rng, lang, rng.randrange(8, 60)), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), [70, 20, 9, 1], k=900))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spoken):
    model = langid.fit(spoken.filter(~queries.held_out(4)), 400)
    assert model.families.classes == ["germanic", "romance", "xx"]
    got = langid.identify(spoken, model).join(spoken.select("doc_id", "lang"), "doc_id").filter(queries.held_out(4)).collect()
    assert len(got) > 150 and sum(r.lang == r.lang_pred for r in got) > 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_accuracy_of_the_query(spark, sf):
    got = queries.op3_language_id(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    rows = got.filter("held_out AND lang_pred <> 'und'").collect()
    assert rows and sum(r.lang == r.lang_pred for r in rows) > 0.95 * len(rows)


def test_held_out_accuracy_at_two_sample_sizes(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    right = []
    for size in (200, 800):
        model = langid.fit(docs.filter(~queries.held_out(4)), size)
        known = langid.identify(docs, model).filter(queries.held_out(4)).filter("lang_pred <> 'und'")
        got = known.join(docs.select("doc_id", "lang"), "doc_id").collect()
        right.append(sum(r.lang == r.lang_pred for r in got) / len(got))
    assert right[0] > 0.95 and right[1] > 0.98, right


def test_no_letter_is_unknown(docs, texts, spoken, nothing):
    model = langid.fit(spoken)
    rows = langid.identify(docs, model).join(docs.select("doc_id", F.col("text").alias("t")), "doc_id").collect()
    for r in rows:
        assert (r.lang_pred == langid.UNKNOWN) == (not any(c.isalpha() for c in r.t or "")), r.t
        assert r.lang_pred != langid.UNKNOWN or r.score == 0
    assert len(langid.identify(docs, model).collect()) == docs.count()
    assert langid.identify(nothing, model).collect() == []


def test_without_labels(docs, nothing):
    assert langid.fit(nothing) is None and langid.fit(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {langid.UNKNOWN}


def test_one_language_only(spoken):
    model = langid.fit(spoken.filter("lang = 'en'"))
    assert {(r.lang_pred, r.score) for r in langid.identify(spoken, model).collect()} == {("en", 1.0)}


def test_only_the_whole_text_counts():
    long = "the of " * 5000
    a, b = langid.features(pa.array([long + "x", long + "zq" * 9000])), langid.features(pa.array([long + "x"]))
    assert np.allclose(a[0], b[0]) and not np.allclose(a[0], a[1])
