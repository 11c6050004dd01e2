"""Exact line numbers of text files that many tasks read.

Files are read twice. The first pass counts the lines of each block of a file, a few numbers a block; sums over the
blocks before say where a block's lines begin. In the second pass a line's place in its block is the distance of its row
from the block's first row in the task, so no line is moved to be numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """file, block (its first byte), row (rises in a block), line: a final newline is no line of its own."""
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("line"),
    )


def _begins(counts: DataFrame) -> Column:
    """The sum of n over the blocks of the file before."""
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum("n").over(earlier), F.lit(0))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, line_no, line: lines numbered from 0 in each file."""
    lines = _blocks(spark, path)
    counts = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    starts = counts.select("file", "block", (_begins(counts) - F.col("first")).alias("shift"))
    return lines.join(starts, ["file", "block"]).select("file", "block", (F.col("row") + F.col("shift")).alias("line_no"), "line")


def numbered_among(spark: SparkSession, path: str, counts_if: Column) -> DataFrame:
    """file, number, line: the lines for which `counts_if` (a condition on line) holds, numbered from 0 in each file.

    Lines are ordered inside their block, so a task holds at most a block; a file of any length is many blocks.
    """
    lines = _blocks(spark, path).filter(counts_if)
    counts = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    starts = counts.select("file", "block", _begins(counts).alias("shift"))
    inside = F.row_number().over(W.partitionBy("file", "block").orderBy("row")) - 1
    return lines.withColumn("place", inside).join(starts, ["file", "block"]).select(
        "file", (F.col("place") + F.col("shift")).alias("number"), "line"
    )
