"""From raw documents to packed training sequences: the stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobfacts.llm import decontam, exact, langid, neardup, packing, queries
from jobfacts.llm.common import apart, table, written


def _named(docs: DataFrame, name: str) -> DataFrame:
    """`docs` with the MD5 of each text."""
    return docs.withColumn(name, F.unhex(F.md5(F.coalesce("text", F.lit("")))))


def _without(docs: DataFrame, marked: DataFrame, dropped: DataFrame, name: str) -> DataFrame:
    """The rows of `marked` whose `name` is not in `dropped`, with the columns of `docs`.

    What goes is written first, so Spark knows its size and sends it to the rows where it is small.
    """
    return marked.join(written(dropped.select(name).distinct(), "dropped"), name, "left_anti").select(docs.columns)


def _free(docs: DataFrame) -> str:
    """A column name that the documents don't have."""
    return "row_" + "_".join(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told: a null text and one without a letter go."""
    name = _free(docs)
    marked = _named(docs, name)
    known = langid.identify(marked, langid.fit(docs.filter(~queries.held_out(4))), id_col=name)
    return _without(docs, marked, known.filter(F.col("lang_pred") == langid.UNKNOWN).withColumnRenamed("doc_id", name), name)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays, once."""
    name = _free(docs)

    def row(digest: Column) -> Column:
        return F.concat(digest, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))

    kept = exact.exact_owners(docs, largest=True).filter("kept").select(row(F.col("text_sha256")).alias(name))
    marked = docs.withColumn(name, row(F.sha2(F.coalesce("text", F.lit("")), 256)))
    return marked.join(kept, name, "left_semi").dropDuplicates([name]).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.85 or more join, the one with the smallest doc_id stays.

    Of several with that id the text of the smallest digest stays, and ids count before none.
    """
    name = _free(docs)

    def row(mark: Column) -> Column:
        return F.concat(F.hex(mark), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))

    found = neardup.near_duplicates(docs, 85, 5).filter("n_shingles > 0").withColumn("row", row(F.col("mark")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row"))
    stays = found.groupBy("component").agg(first["row"].alias("first"))
    copies = found.join(apart(stays, "component"), "component").filter("row <> first").withColumnRenamed("row", name)
    marked = _named(docs, name)
    return _without(docs, marked.withColumn(name, row(F.col(name))), copies, name)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a run of ten words of any benchmark item."""
    name = _free(docs)
    marked = _named(docs, name)
    found = decontam.contamination(marked, table(spark, sf_dir, "benchmark"), 10, id_col=name).filter("contaminated")
    return _without(docs, marked, found.withColumnRenamed("doc_id", name), name)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left: where they stand in which sequence, with their token ids."""
    return packing.pack(docs, queries.vocabulary(), queries.LIMIT, queries.END_ID)


STAGES = [
    ("language ID", language),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]

#: A learnt language model and token ids have no SQL form; a test holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every one but the last is written as Parquet and read again.

    A row is its id and its text: rows that share an id, or have none, are decided on one by one, and of equal rows one
    stays. Nulls, empty texts, ties and other columns are treated as each stage's operator says.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
