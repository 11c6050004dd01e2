"""Benchmark decontamination through a distributed positional inverted index, on built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobfacts.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, which are runs of digits, letters and everything beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A filter has this many longs of 64 bits, however many keys go in.
FILTER_LONGS = 1 << 15


def words(text: Column) -> Column:
    """The words of a text in order, case as written."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def lowered(word: Column) -> Column:
    """A-Z lower-cased and nothing else; words of ASCII alone take the quick way."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def _slot(key: Column) -> tuple[Column, Column]:
    return F.pmod(key, F.lit(FILTER_LONGS)).cast("int"), F.pmod(F.shiftrightunsigned(key, 20), F.lit(64)).cast("int")


def fixed_filter(keys: DataFrame, key: str) -> Column:
    """All values of a long column as bits of one array of fixed size, a scalar that any plan may use.

    It lets a few wrong keys pass (many, once millions are in) and never stops a right one, so a join behind it
    decides; what is sent to the tasks stays at 256 KB at any size of `keys`.
    """
    long, bit = _slot(F.col(key))
    set_bits = (
        keys.select(long.alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bits"))
        .groupBy("at")
        .agg(F.bit_or("bits").alias("bits"))
    )
    every = keys.sparkSession.range(FILTER_LONGS, numPartitions=1).select(F.col("id").cast("int").alias("at"))
    entries = every.join(set_bits, "at", "left").select(F.struct("at", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("e"))
    return entries.agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["bits"]).alias("f")).scalar()


def passes(bits: Column, key: Column) -> Column:
    long, bit = _slot(key)
    return F.getbit(bits[long], bit) == 1


def row_key(id_col: str, text_col: str) -> Column:
    """Names a document by id and text; a clash only adds candidates, which are confirmed on the text."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def positions(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """row_key, pos, term: every word of every whole text."""
    # The key hashes the whole text: it is worked out below the generator, once a document and not once a word.
    keyed = docs.select(row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    exploded = keyed.select("row_key", F.posexplode(words(F.col("text"))).alias("pos", "word"))
    return exploded.select("row_key", "pos", lowered(F.col("word")).alias("term"))


def items_with_words(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item_key, item, terms of each distinct item that has words."""
    each = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).distinct()
    terms = F.transform(words(F.col("text")), lowered)
    return each.select(F.xxhash64("item", "text").alias("item_key"), "item", terms.alias("terms")).filter(F.size("terms") > 0)


def stretches(items: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """The windows of all items, each with its two rarest terms, neighbours of like terms in one row.

    item_key, item, terms, n (words of a window), t1, q1, t2, q2 (rarest terms and where they stand in the item), low
    and high (first words of the windows). A window with a term that no document has is left out.
    """
    placed = items.select("item_key", F.posexplode("terms").alias("q", "term"))
    known = (
        placed.join(counts, "term", "left")
        .groupBy("item_key")
        .agg(F.array_sort(F.collect_list(F.struct("q", "term", F.coalesce("n_docs", F.lit(0).cast("long")).alias("n_docs")))).alias("w"))
    )
    n = F.least(F.size("w"), F.lit(size))

    def rarest(s: Column) -> Column:
        ranked = F.array_sort(
            F.transform(F.slice("w", s + 1, n), lambda x: F.struct(x["n_docs"].alias("c"), x["q"].alias("q"), x["term"].alias("t")))
        )
        return F.struct(s.alias("s"), ranked[0].alias("a"), F.coalesce(F.try_element_at(ranked, F.lit(2)), ranked[0]).alias("b"))

    each = known.select(
        "item_key", n.alias("n"), F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - n), rarest)).alias("x")
    ).filter(F.col("x.a.c") > 0)
    joined = each.groupBy(
        "item_key", "n", F.col("x.a.t").alias("t1"), F.col("x.a.q").alias("q1"), F.col("x.b.t").alias("t2"), F.col("x.b.q").alias("q2")
    ).agg(F.min("x.s").alias("low"), F.max("x.s").alias("high"))
    return joined.join(items, "item_key").withColumn("stretch", F.xxhash64("item_key", "q1", "q2"))


def phrase_candidates(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """row_key, stretch, d: where both rarest terms of a stretch stand at the right distance (item word 0 would be word d)."""

    def adjusted(term: str, at: str) -> DataFrame:
        lists = wanted.select("stretch", F.col(term).alias("term"), F.col(at).alias("q"))
        return postings.join(lists, "term").select("row_key", "stretch", (F.col("pos") - F.col("q")).alias("d"))

    return adjusted("t1", "q1").join(adjusted("t2", "q2").distinct(), ["row_key", "stretch", "d"], "left_semi").distinct()


def proximity_matches(postings: DataFrame, pairs: DataFrame, within: int) -> DataFrame:
    """pair, row_key, pos_a, pos_b: where terms a and b of `pairs` (pair, a, b) stand at most `within` words apart.

    Positions fall into cells as wide as `within`; a position meets its own cell and both next to it.
    """
    cell = F.floor(F.col("pos") / within)
    left = postings.join(pairs.select("pair", F.col("a").alias("term")), "term").select(
        "pair", "row_key", F.col("pos").alias("pos_a"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell")
    )
    right = postings.join(pairs.select("pair", F.col("b").alias("term")), "term").select(
        "pair", "row_key", F.col("pos").alias("pos_b"), cell.alias("cell")
    )
    near = left.join(right, ["pair", "row_key", "cell"]).filter(F.abs(F.col("pos_a") - F.col("pos_b")) <= within)
    return near.select("pair", "row_key", "pos_a", "pos_b").distinct()


def find_phrases(
    docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """row_key, spans, found: for each document with a window of an item in it, where (start, end in words) and which items.

    A window is `size` consecutive words of an item, or all of a shorter one. Words are counted over all documents,
    the two rarest words of each window are looked up in a positional index of just these words, their lists are
    intersected with the offset between them, and what is left is confirmed word by word on the documents' texts.
    """
    all_items = written(items_with_words(items, item_col, "text"), "items")
    vocabulary = all_items.select(F.explode(F.transform("terms", lambda t: F.xxhash64(t))).alias("h")).distinct()
    seen = positions(docs, text_col, id_col)
    counts = seen.filter(passes(fixed_filter(vocabulary, "h"), F.xxhash64("term"))).groupBy("term").agg(F.count("*").alias("n_docs"))
    wanted = written(stretches(all_items, counts, size), "stretches")
    rare = wanted.select(F.explode(F.array(F.xxhash64("t1"), F.xxhash64("t2"))).alias("h")).distinct()
    postings = written(seen.filter(passes(fixed_filter(rare, "h"), F.xxhash64("term"))), "postings")
    candidates = written(phrase_candidates(postings, wanted), "candidates")
    places = candidates.join(wanted.select("stretch", "item", "terms", "n", "low", "high"), "stretch")
    to_check = places.groupBy("row_key").agg(F.collect_list(F.struct("d", "item", "terms", "n", "low", "high")).alias("places"))
    texts = docs.select(row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    texts = texts.filter(passes(fixed_filter(candidates.select("row_key"), "row_key"), F.col("row_key")))
    checked = texts.join(to_check, "row_key").withColumn("w", F.transform(words(F.col("text")), lowered))

    def confirmed(p: Column) -> Column:
        # A window must lie within the item and within the document: slice() cuts short at either end.
        first, last = F.greatest(p["low"], -p["d"]), F.least(p["high"], F.size("w") - p["d"] - p["n"])
        right = F.filter(
            F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>")),
            lambda s: F.slice("w", p["d"] + s + 1, p["n"]) == F.slice(p["terms"], s + 1, p["n"]),
        )
        return F.transform(right, lambda s: F.struct((p["d"] + s).alias("start"), (p["d"] + s + p["n"]).alias("end"), p["item"].alias("item")))

    hits = checked.select("row_key", F.array_distinct(F.flatten(F.transform("places", confirmed))).alias("hits"))
    found = hits.select(
        "row_key",
        F.array_sort(F.array_distinct(F.transform("hits", lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"))))).alias("spans"),
        F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item"]))).alias("found"),
    )
    # Filtered last: below the aggregate the condition would confirm every place a second time.
    return found.dropDuplicates(["row_key"]).filter(F.size("spans") > 0)


def covered(spans: Column) -> Column:
    """How many words sorted spans cover."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))

    def add(held: Column, s: Column) -> Column:
        return F.struct(
            F.greatest(held["upto"], s["end"]).alias("upto"),
            (held["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(held["upto"], s["start"]))).alias("n"),
        )

    return F.aggregate(spans, start, add, lambda held: held["n"])


def contamination(
    docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_hit, spans, items (those that occur), contaminated.

    Words are what `BETWEEN` leaves, with A-Z lower-cased. A word inside any occurrence of an item's window is hit.
    A null text has no words and no hits, a null or wordless item no windows; an item with a null id hits words
    but is not listed. Repeated rows each give the same result, repeated items count once, other columns are ignored.
    """
    found = find_phrases(docs, items, size, id_col, text_col, item_col)
    counted = docs.select(
        F.col(id_col).alias("doc_id"),
        row_key(id_col, text_col).alias("row_key"),
        F.size(words(F.col(text_col))).cast("long").alias("n_words"),
    )
    n_hit = F.coalesce(covered(F.col("spans")), F.lit(0).cast("long"))
    return counted.join(found, "row_key", "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        "spans",
        F.filter(F.coalesce("found", F.array().cast(found.schema["found"].dataType)), F.isnotnull).alias("items"),
        (n_hit > 0).alias("contaminated"),
    )
