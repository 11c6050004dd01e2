"""Token counts from an exact histogram of document lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobfacts.llm.common import mapped, small, written
from jobfacts.llm.tokens import encoder

#: Lengths that share a bucket; suffix sums run over bucket totals first, then inside each bucket.
BUCKET = 256


def histogram(docs: DataFrame, vocabulary: str, end_tokens: int = 0, text_col: str = "text") -> DataFrame:
    """length, n_docs: how many documents of `docs` encode to so many tokens.

    Every whole text is encoded with the vocabulary file; a null text counts as empty and has `end_tokens` tokens, and
    rows that repeat count each. Tasks add up their own lengths first, so a length that many documents share is no hot
    key. No rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, counts = encoder(vocabulary), {}
        for batch in small(batches, "text"):
            for text in batch.column("text").to_pylist():
                n = sum(len(ids) for ids in encode.pieces(text)) + end_tokens
                counts[n] = counts.get(n, 0) + 1
        yield pa.record_batch(
            [pa.array(np.array(list(x), np.int64)) for x in (counts.keys(), counts.values())], names=["length", "n_docs"]
        )

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return mapped(texts, run, "length long, n_docs long").groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def _suffix(rows: DataFrame, column: str, key: str, bucket: Column | None = None) -> Column:
    over = Window.partitionBy("bucket") if bucket is not None else Window.partitionBy(F.lit(0))
    return F.sum(column).over(over.orderBy(F.desc(key)).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def limits(hist: DataFrame) -> DataFrame:
    """What a context limit equal to each length of `hist` means for the whole corpus, one row per length.

    length, n_docs, n_tokens (in documents of just this length), docs_at_least and tokens_at_least (in documents this
    long or longer), truncated_tokens (all that is left when every document is cut to this length), lost_tokens, and
    share_shorter (of the documents, those strictly shorter: the quantile at which this length begins).

    Sums from the longest length down give all of them exactly. They run in two levels, over buckets of `BUCKET`
    lengths and then inside each bucket, so no task takes more than the number of buckets or `BUCKET` rows. The
    histogram is computed once; one without rows gives none.
    """
    rows = written(hist, "lengths").select(  # once: both levels read it
        "length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.floor(F.col("length") / BUCKET).alias("bucket")
    )
    totals = rows.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    everything = Window.partitionBy(F.lit(0))
    above = totals.select(
        "bucket",
        (_suffix(totals, "d", "bucket") - F.col("d")).alias("docs_above"),
        (_suffix(totals, "t", "bucket") - F.col("t")).alias("tokens_above"),
        F.sum("d").over(everything).alias("all_docs"),
        F.sum("t").over(everything).alias("all_tokens"),
    )
    inside = rows.withColumns(
        {"d": _suffix(rows, "n_docs", "length", F.col("bucket")), "t": _suffix(rows, "n_tokens", "length", F.col("bucket"))}
    )
    docs_at_least = F.col("d") + F.col("docs_above")
    tokens_at_least = F.col("t") + F.col("tokens_above")
    truncated = F.col("all_tokens") - tokens_at_least + F.col("length") * docs_at_least
    return inside.join(above, "bucket").select(
        "length",
        "n_docs",
        "n_tokens",
        docs_at_least.alias("docs_at_least"),
        tokens_at_least.alias("tokens_at_least"),
        truncated.alias("truncated_tokens"),
        (F.col("all_tokens") - truncated).alias("lost_tokens"),
        ((F.col("all_docs") - docs_at_least) / F.col("all_docs")).alias("share_shorter"),
    )


def quantiles(report: DataFrame, shares: list[float]) -> DataFrame:
    """share, length: the least length that at least this share of the documents does not exceed."""
    held = report.select("length", (F.col("share_shorter") + F.col("n_docs") / F.col("docs_at_least") * (1 - F.col("share_shorter"))).alias("up_to"))
    return held.select("length", "up_to", F.explode(F.array(*map(F.lit, shares))).alias("share")).filter(
        F.col("up_to") >= F.col("share") - 1e-12
    ).groupBy("share").agg(F.min("length").alias("length"))
