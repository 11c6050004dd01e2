"""Joins of rows with figures of their keys, when one key may have most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apart(figures: DataFrame, *key: str) -> DataFrame:
    """``figures`` dealt out by another function of the key than a join on it uses.

    A join next to an aggregate reuses the aggregate's partitions, and adaptive execution can't split a frequent key
    there. Between two exchanges of its own it can. Figures small enough to be sent to all tasks still are.
    """
    return figures.repartition(F.xxhash64(*key))
