"""Streams that wait: how each job ends, with or without a time limit, and when each MiniCluster is ready.

The batch twins are in ``operators.status``. Each answer is written exactly once, as soon as nothing that is at most
the allowed delay late can still change it, by a timer of its key. What comes later and would have changed it is a
row of its own, so nothing is lost: the ``all_`` readers give what all statuses together say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobfacts import fixed_values as fv
from jobfacts.functions import states
from jobfacts.operators.status import earliest
from jobfacts.streaming.keyed import MINUTE, first_matches, rocksdb
from jobfacts.streaming.runs import RunLog

_DAY = 1440 * MINUTE
_MC = ["namespace", "name"]


def _start(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    log = RunLog(path)
    with rocksdb(rows.sparkSession):
        return (
            rows.writeStream.outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(log.append)
            .start()
        )


def _kind(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return RunLog(path).read(spark).filter(F.col("kind") == kind).drop("kind")


def _all(spark: SparkSession, path: str, key: list[str], wait: int | None) -> DataFrame:
    """Outcomes and late facts of each key as one row."""
    facts = RunLog(path).read(spark).groupBy(*key).agg(
        F.min("first").alias("first"), earliest(F.col("kept"), F.col("end")).alias("kept"), F.min("end").alias("end")
    )
    limit = F.lit(None).cast("long") if wait is None else F.col("first") + wait
    due = F.least("end", limit)  # least skips a missing end
    return facts.withColumns({"due": due, "matched": F.coalesce(F.col("end") == due, F.lit(False))})


def _ends(rows: DataFrame) -> DataFrame:
    return rows.select(
        "job_id",
        F.when(F.col("matched"), F.col("kept")).otherwise(F.lit("TIMEOUT")).alias("state"),
        F.timestamp_micros("due").alias("ts"),
        (F.col("matched") & (F.col("kept") == "COMPLETED")).alias("success"),
    )


def stream_outcomes(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    timeout_minutes: int = fv.WAIT_TIMEOUT_MINUTES,
    delay_minutes: int = 10,
    keep_days: int = 30,
) -> StreamingQuery:
    """Write the outcome of every job in a status stream ``(job_id, state, ts)``: its first terminal state, else TIMEOUT.

    ``delay_minutes`` bounds how late a status may arrive and still change an outcome; ``keep_days`` after it a job
    is forgotten, and a newer status of that name is a new job's.
    """
    state = F.col("state")
    rows = first_matches(
        stream, ["job_id"], states.is_terminal(state), state, timeout_minutes * MINUTE, delay_minutes * MINUTE, keep_days * _DAY
    )
    return _start(rows, path, checkpoint)


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    return _ends(_kind(spark, path, "outcome"))


def read_late(spark: SparkSession, path: str) -> DataFrame:
    """What came too late: key, first, end, kept, due, matched with the late facts."""
    return _kind(spark, path, "late")


def all_outcomes(spark: SparkSession, path: str, timeout_minutes: int = fv.WAIT_TIMEOUT_MINUTES) -> DataFrame:
    """The outcomes as they are with what came too late."""
    return _ends(_all(spark, path, ["job_id"], timeout_minutes * MINUTE))


def stream_ends(stream: DataFrame, path: str, checkpoint: str, delay_minutes: int = 10, keep_days: int = 30) -> StreamingQuery:
    """Write the first terminal state of every job once, ``delay_minutes`` after it at the latest event time.

    Only jobs that have ended have state, until ``keep_days`` after their end.
    """
    state = F.col("state")
    rows = first_matches(stream, ["job_id"], states.is_terminal(state), state, None, delay_minutes * MINUTE, keep_days * _DAY)
    return _start(rows, path, checkpoint)


def _first(rows: DataFrame) -> DataFrame:
    return rows.filter("matched").select("job_id", F.col("kept").alias("state"), F.timestamp_micros("due").alias("ts"))


def read_ends(spark: SparkSession, path: str) -> DataFrame:
    return _first(_kind(spark, path, "outcome"))


def all_ends(spark: SparkSession, path: str) -> DataFrame:
    return _first(_all(spark, path, ["job_id"], None))


def stream_readiness(
    stream: DataFrame, path: str, checkpoint: str, timeout_minutes: int, delay_minutes: int = 10, keep_days: int = 30
) -> StreamingQuery:
    """Write when each MiniCluster of a stream ``(namespace, name, ts, status)`` was ready, or that its time ran out.

    The time runs from its first status. Of readiness after a Timeout there is a late row only if it says that the
    MiniCluster had been ready in time.
    """
    s = F.col("status")
    desired = states.desired_size(s["maximumSize"], s["desiredSize"], s["specSize"])
    ready = states.is_ready(s["phase"], s["size"], desired, s["conditions"])
    rows = first_matches(stream, _MC, ready, s["phase"], timeout_minutes * MINUTE, delay_minutes * MINUTE, keep_days * _DAY)
    return _start(rows, path, checkpoint)


def _readiness(rows: DataFrame) -> DataFrame:
    when = F.timestamp_micros("due")
    return rows.select(
        *_MC,
        F.when(F.col("matched"), F.col("kept")).otherwise(F.lit("Unknown")).alias("phase"),
        F.when(~F.col("matched"), F.lit("Timeout")).alias("reason"),
        F.when(F.col("matched"), when).alias("ts"),
        when.alias("decided"),
    )


def read_readiness(spark: SparkSession, path: str) -> DataFrame:
    """namespace, name, phase, reason, ts (of readiness) and decided (that, or when the time ran out)."""
    return _readiness(_kind(spark, path, "outcome"))


def all_readiness(spark: SparkSession, path: str, timeout_minutes: int) -> DataFrame:
    return _readiness(_all(spark, path, _MC, timeout_minutes * MINUTE))
