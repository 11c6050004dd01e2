"""Live answers: the earliest match so far of each key, and the queue status.

State of a first match is one small aggregate per key, combined in each task before the exchange. In update mode a
trigger writes only keys whose answer changed; the sink is a log of versions whose old runs are merged, and its reader
takes the earliest time per key, which also covers statuses that arrive late. Keys stay for as long as the stream
lives; ``timeouts`` has the streams that write each answer once and then forget it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobfacts import fixed_values as fv
from jobfacts.functions import states
from jobfacts.operators import status
from jobfacts.streaming.keyed import MINUTE, rocksdb, state_changes
from jobfacts.streaming.runs import RunLog

#: Counts are written in turn to so many folders, so the one before stays whole.
_SLOTS = 4


def write_versions(
    changes: DataFrame, path: str, checkpoint: str, merge: Callable[[DataFrame], DataFrame] | None = None
) -> StreamingQuery:
    """Append each trigger's changed rows as a run of its own; a repeated trigger replaces it, ``merge`` reduces old runs."""
    return (
        changes.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(RunLog(path, merge=merge).append)
        .start()
    )


def stream_first_match(
    stream: DataFrame, key: list[str], matches: Column, kept: str, path: str, checkpoint: str
) -> StreamingQuery:
    first = status.first_match(stream, key, matches, kept)
    return write_versions(first, path, checkpoint, lambda rows: status.first_match(rows, key, F.lit(True), kept))


def read_first_match(spark: SparkSession, path: str, key: list[str], kept: str) -> DataFrame:
    """Current answer per key: the earliest of its versions."""
    return status.first_match(RunLog(path).read(spark), key, F.lit(True), kept)


def stream_first_terminal(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    ended = states.is_terminal(F.col("state"))
    return stream_first_match(stream, ["job_id"], ended, "state", path, checkpoint)


def read_first_terminal(spark: SparkSession, path: str) -> DataFrame:
    return read_first_match(spark, path, ["job_id"], "state")


def stream_first_ready(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Readiness of MiniClusters; rows not (yet) ready are versions without a time."""
    return write_versions(status.first_ready(stream), path, checkpoint, _earliest_ready)


def _earliest_ready(versions: DataFrame) -> DataFrame:
    found = versions.groupBy("namespace", "name").agg(
        F.min("ts").alias("ts"), status.earliest(F.col("phase"), F.col("ts")).alias("ready_phase")
    )
    never = F.col("ts").isNull()
    return found.select(
        "namespace",
        "name",
        F.when(never, F.lit("Unknown")).otherwise(F.col("ready_phase")).alias("phase"),
        F.when(never, F.lit("Timeout")).alias("reason"),
        "ts",
    )


def read_first_ready(spark: SparkSession, path: str) -> DataFrame:
    """Earliest readiness per MiniCluster, else Unknown for Timeout."""
    return _earliest_ready(RunLog(path).read(spark))


def stream_queue_status(stream: DataFrame, path: str, checkpoint: str, keep_days: int = 30) -> StreamingQuery:
    """Live queue status: jobs per cluster by their newest state, kept up by what each trigger changes.

    ``stream`` has cluster, job_id, state and ts. Counting the events themselves would count a job once per status. A
    trigger adds its differences to the counts of the trigger before, a few rows a cluster. Jobs that are
    over are forgotten after ``keep_days``; statuses older than that which meet no job are counted in late.
    """
    changed = state_changes(stream, list(fv.TERMINAL_STATES), keep_days * 1440 * MINUTE)

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if epoch:
            batch = batch.unionByName(spark.read.schema(batch.schema).parquet(_counts(path, epoch - 1)))
        sums = batch.groupBy("cluster", "state").agg(F.sum("n").alias("n"), F.sum("late").alias("late"))
        sums.filter("n <> 0 OR late <> 0").write.mode("overwrite").parquet(_counts(path, epoch))
        done = spark.range(1).select(F.lit(epoch).cast("long").alias("epoch"))
        done.coalesce(1).write.mode("overwrite").parquet(f"{path}/done-{epoch % _SLOTS}")

    with rocksdb(stream.sparkSession):
        return (
            changed.writeStream.outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )


def _counts(path: str, epoch: int) -> str:
    return f"{path}/counts-{epoch % _SLOTS}"


def _newest_counts(spark: SparkSession, path: str) -> DataFrame:
    epoch = spark.read.schema("epoch long").parquet(f"{path}/done-*").agg(F.max("epoch")).first()[0]
    return spark.read.parquet(_counts(path, epoch))


def read_queue_status(spark: SparkSession, path: str) -> DataFrame:
    """The status after the newest trigger, in the columns of ``queue.queue_status``."""

    def jobs(state: str | None = None) -> Column:
        hit = F.lit(True) if state is None else F.col("state") == state
        return F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0))

    shown = {"total_jobs": None, **{s.lower(): s for s in ("RUNNING", "PENDING", "COMPLETED", "FAILED", "CANCELLED")}}
    counts = _newest_counts(spark, path).filter("n <> 0")
    return counts.groupBy("cluster").agg(*[jobs(state).alias(name) for name, state in shown.items()])


def read_late_statuses(spark: SparkSession, path: str) -> DataFrame:
    """cluster, late: statuses that came too late to be counted."""
    return _newest_counts(spark, path).groupBy("cluster").agg(F.sum("late").alias("late"))
