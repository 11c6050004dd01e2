"""The accounting store as files: a folder for each day of submission, rows in order of submission inside.

A time range reads the folders of its days only, and of their files the row groups whose submission times it meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TIME = "submitted"
UNITS = ("day", "month")


def _unit(unit: str) -> str:
    """The column of the folders."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}, got {unit!r}")
    return f"submit_{unit}"


def _start(ts: Column, unit: str) -> Column:
    return F.to_date(F.date_trunc(unit, ts))


def write_accounting(jobs: DataFrame, path: str, mode: str = "errorifexists", unit: str = "day") -> None:
    """Write ``jobs`` by day (or month) of ``submitted``; one of many jobs is written by many tasks, small ones share one.

    Jobs that were never submitted stand in a folder of their own.
    """
    folder = _unit(unit)
    dated = jobs.withColumn(folder, _start(F.col(TIME), unit)).hint("rebalance", folder)
    dated.sortWithinPartitions(folder, TIME).write.mode(mode).partitionBy(folder).parquet(path)


def read_accounting(
    spark: SparkSession, path: str, schema: str, start: Column | None = None, end: Column | None = None, unit: str = "day"
) -> DataFrame:
    """The store with the column of its folders, of a time range if one is given (both ends in): only its days are read."""
    folder = _unit(unit)
    store = spark.read.schema(f"{schema}, {folder} date").parquet(path)
    for bound, holds in ((start, lambda c, b: c >= b), (end, lambda c, b: c <= b)):
        if bound is not None:
            store = store.filter(holds(F.col(folder), _start(bound, unit)) & holds(F.col(TIME), bound))
    return store


def in_ranges(store: DataFrame, ranges: DataFrame, unit: str = "day") -> DataFrame:
    """Jobs of the store once for each of ``ranges`` (range_id, start, end; both ends in) that they were submitted in.

    Ranges become days (months) and meet the store by those, so Spark prunes the folders by what the ranges have. Ranges
    with a null or crossed ends hold nothing.
    """
    folder = _unit(unit)
    first, last = (_start(F.col(c), unit) for c in ("start", "end"))
    steps = F.explode(F.sequence(first, last, F.expr(f"interval 1 {unit}")))
    dated = ranges.filter("start <= end").select("range_id", "start", "end", steps.alias(folder))
    return store.join(dated, folder).filter(F.col(TIME).between(F.col("start"), F.col("end"))).drop("start", "end")
