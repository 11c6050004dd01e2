"""Job output: last lines, and which jobs have any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tail_text(text: Column, n: int) -> Column:
    """Last ``n`` lines of one text; a final newline makes an empty last line."""
    lines = F.split(text, "\n")
    kept = F.when(F.size(lines) > n, F.slice(lines, -n, n)).otherwise(lines)
    return F.array_join(kept, "\n")


def is_truncated(text: Column, n: int) -> Column:
    return F.size(F.split(text, "\n")) > n


def tail_lines(lines: DataFrame, n: int, key: list[str], order: list[str]) -> DataFrame:
    """Last ``n`` lines per group with ``truncated``, for output stored line by line.

    Each task keeps only its own last ``n + 1`` lines of a group before the
    exchange, so a job that wrote most of the output is no heavier than others.
    """
    latest = W.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    kept = lines.withColumn("from_end", F.row_number().over(latest)).filter(
        F.col("from_end") <= n + 1
    )
    whole = W.partitionBy(*key)
    return kept.withColumn("truncated", F.max("from_end").over(whole) > n).filter(
        F.col("from_end") <= n
    )


def tail_output(lines: DataFrame, n: int, key: list[str], order: list[str]) -> DataFrame:
    """The last ``n`` lines of each group as one text."""
    numbered = F.sort_array(F.collect_list(F.struct((-F.col("from_end")).alias("p"), "line")))
    return (
        tail_lines(lines, n, key, order)
        .groupBy(*key)
        .agg(
            F.array_join(F.transform(numbered, lambda x: x["line"]), "\n").alias("tail"),
            F.count(F.lit(1)).alias("lines_shown"),
            F.bool_or("truncated").alias("truncated"),
        )
    )


def jobs_with_output(jobs: DataFrame, output: DataFrame, key: str = "job_id") -> DataFrame:
    """Jobs that wrote anything. Each task reduces a job's rows to one first."""
    return jobs.join(output.select(key).distinct(), key, "left_semi")


def jobs_without_output(jobs: DataFrame, output: DataFrame, key: str = "job_id") -> DataFrame:
    """Jobs of which only the output paths are known."""
    return jobs.join(output.select(key).distinct(), key, "left_anti")


def with_output(jobs: DataFrame, tails: DataFrame, key: str = "job_id") -> DataFrame:
    """Jobs with the tail of each stream; missing output is empty text.

    ``tails`` is one row per job and stream, as :func:`tail_output` gives.
    """

    def stream(name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("stream") == name, F.col("tail"))), F.lit(""))

    per_job = tails.groupBy(key).agg(
        stream("stdout").alias("stdout"), stream("stderr").alias("stderr")
    )
    return (
        jobs.join(per_job, key, "left")
        .withColumn("stdout", F.coalesce("stdout", F.lit("")))
        .withColumn("stderr", F.coalesce("stderr", F.lit("")))
    )
