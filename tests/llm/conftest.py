import random

import pytest
from pyspark.sql import functions as F

VOCABULARY = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which".split()


def prose(rng, n):
    words = [rng.choice(VOCABULARY) if rng.random() < 0.4 else f"w{rng.randrange(4000)}é" for _ in range(n)]
    return "".join(w + (".\n" if i % 9 == 8 else " ") for i, w in enumerate(words))


def edited(rng, text, share):
    return " ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies at every distance, empty, tiny, wordless, very long and odd ones."""
    rng = random.Random(5)
    out = [prose(rng, rng.randrange(3, 200)) for _ in range(60)]
    base = prose(rng, 150)
    out += [edited(rng, base, rng.random() * 0.06) for _ in range(70)]
    out += [base, base, out[0], out[0], out[3].upper(), None, None, "", "", " \n\t", "!?", "123 456", "one", "one", "One two", "ß Ä ä"]
    out += [prose(rng, 40_000), "z" * 300_000, "<|endoftext|> don't stop  now\r\n\r\n  ", "a b   c", "\x00\x01 x"]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents: one without an id, one repeated row, and columns whose names operators use inside."""
    rows = [(i if i != 7 else None, t, ("en", "fr", None)[i % 3], f"s{i % 4}") for i, t in enumerate(texts)]
    rows.append(rows[11])
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    clash = "key shard size row_key term pos body owner copies side i j held chunk length n_bytes node root component lines html same".split()
    return df.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture
def nothing(docs):
    return docs.filter("1 = 0")
