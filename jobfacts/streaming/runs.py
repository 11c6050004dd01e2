"""A log of what each trigger wrote, merged as it grows, so that readers open few files however many triggers there were.

Triggers are counted. A trigger's rows are a run of level 0; as soon as a level has `fan` new runs they are written
together as one run of the next level. After n triggers the valid runs of a level are as many as n has there as a digit in base
`fan`, so the count alone says what to read. It is written last, as the trigger's commit: a trigger that is
repeated writes the same runs again and readers never see half of one. Folders are used in turn, so what is merged is
written over later and nothing needs to be deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COUNTS = 4


class RunLog:
    def __init__(self, path: str, fan: int = 8, merge: Callable[[DataFrame], DataFrame] | None = None):
        """`merge` reduces the rows of runs that are merged, where later rows can stand for earlier ones."""
        self.path, self.fan, self.merge = path, fan, merge or (lambda rows: rows)

    def _folder(self, level: int, run: int) -> str:
        return f"{self.path}/level-{level}/run-{run % (2 * self.fan)}"

    def folders(self, triggers: int) -> list[str]:
        """What holds the rows of the first `triggers` triggers."""
        out, level, runs = [], 0, triggers
        while runs:
            out += [self._folder(level, r) for r in range(runs - runs % self.fan, runs)]
            level, runs = level + 1, runs // self.fan
        return out

    def append(self, rows: DataFrame, epoch: int) -> None:
        """Add the rows of trigger `epoch` (0, 1, ...), which are computed once."""
        spark, runs, level = rows.sparkSession, epoch + 1, 0
        rows.write.mode("overwrite").parquet(self._folder(0, epoch))
        while runs % self.fan == 0:
            full = [self._folder(level, r) for r in range(runs - self.fan, runs)]
            level, runs = level + 1, runs // self.fan
            merged = self.merge(spark.read.schema(rows.schema).parquet(*full)).select(rows.columns)
            merged.hint("rebalance").write.mode("overwrite").parquet(self._folder(level, runs - 1))
        count = spark.range(1).select(F.lit(epoch + 1).cast("long").alias("triggers"))
        count.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/count-{(epoch + 1) % _COUNTS}")

    def triggers(self, spark: SparkSession) -> int:
        """How many triggers are complete."""
        counts = spark.read.schema("triggers long").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
        return counts.parquet(f"{self.path}/count-*").agg(F.max("triggers")).first()[0] or 0

    def read(self, spark: SparkSession) -> DataFrame:
        """The rows of all complete triggers."""
        return spark.read.parquet(*self.folders(self.triggers(spark)))
