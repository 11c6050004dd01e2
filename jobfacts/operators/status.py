"""Status histories and cancel requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobfacts import fixed_values as fv
from jobfacts.functions import states


def newest_state() -> Column:
    """The latest state; of states at one time a terminal one, then the last by name."""
    return F.max_by("state", F.struct("ts", states.is_terminal(F.col("state")).alias("over"), "state"))


def earliest(kept: Column, ts: Column) -> Column:
    """What stands at the earliest time, the first by name of several; rows without a time don't count."""
    return F.min_by(kept, F.when(ts.isNotNull(), F.struct(ts.alias("ts"), kept.alias("kept"))))


def latest_status(status: DataFrame) -> DataFrame:
    """Newest state of each job: one aggregate, combined in each task before the exchange."""
    newest = newest_state()
    return status.groupBy("job_id").agg(newest.alias("state"), F.max("ts").alias("ts"))


def first_match(status: DataFrame, key: list[str], matches: Column, kept: str) -> DataFrame:
    """Earliest row of each key that matches: its ``kept`` column and its time."""
    return (
        status.filter(matches)
        .groupBy(*key)
        .agg(earliest(F.col(kept), F.col("ts")).alias(kept), F.min("ts").alias("ts"))
    )


def first_terminal(status: DataFrame) -> DataFrame:
    return first_match(status, ["job_id"], states.is_terminal(F.col("state")), "state")


def outcomes(status: DataFrame, timeout_minutes: int = fv.WAIT_TIMEOUT_MINUTES) -> DataFrame:
    """How waiting for each job ends, counted from its first status.

    The first terminal state within the timeout decides; otherwise the outcome
    is TIMEOUT at the deadline. Only COMPLETED is a success.
    """
    ended = states.is_terminal(F.col("state"))
    first = status.groupBy("job_id").agg(
        F.min("ts").alias("first_ts"),
        F.min(F.when(ended, F.col("ts"))).alias("end_ts"),
        earliest(F.col("state"), F.when(ended, F.col("ts"))).alias("end_state"),
    )
    deadline = F.col("first_ts") + F.expr(f"interval {int(timeout_minutes)} minutes")
    in_time = F.coalesce(F.col("end_ts") <= deadline, F.lit(False))
    return first.select(
        "job_id",
        F.when(in_time, F.col("end_state")).otherwise(F.lit("TIMEOUT")).alias("state"),
        F.when(in_time, F.col("end_ts")).otherwise(deadline).alias("ts"),
    ).withColumn("success", F.col("state") == "COMPLETED")


def first_ready(status: DataFrame) -> DataFrame:
    """First readiness event of each MiniCluster; one never ready is Unknown for Timeout."""
    s = F.col("status")
    desired = states.desired_size(s["maximumSize"], s["desiredSize"], s["specSize"])
    ready = states.is_ready(s["phase"], s["size"], desired, s["conditions"])
    when_ready = F.when(ready, F.col("ts"))
    found = status.groupBy("namespace", "name").agg(
        F.min(when_ready).alias("ready_ts"),
        earliest(s["phase"], when_ready).alias("ready_phase"),
    )
    never = F.col("ready_ts").isNull()
    return found.select(
        "namespace",
        "name",
        F.when(never, F.lit("Unknown")).otherwise(F.col("ready_phase")).alias("phase"),
        F.when(never, F.lit("Timeout")).alias("reason"),
        F.col("ready_ts").alias("ts"),
    )


def apply_cancels(jobs: DataFrame, cancels: DataFrame, key: str = "job_id") -> DataFrame:
    """Jobs after cancel requests. Repeats change nothing, unknown ids are ignored.

    A pending or running job becomes CANCELLED; one already over keeps its state
    and gets an error.
    """
    asked = cancels.select(key).distinct().withColumn("__asked", F.lit(True))
    hit = F.coalesce("__asked", F.lit(False))
    live = F.col("state").isin("PENDING", "RUNNING")
    error = F.concat(F.lit("job is already "), F.col("state"))
    joined = jobs.join(asked, key, "left")
    columns = [F.col(c) for c in jobs.columns if c != "state"]
    return joined.select(
        *columns,
        F.when(hit & live, F.lit("CANCELLED")).otherwise(F.col("state")).alias("state"),
        F.when(hit & states.is_terminal(F.col("state")), error).alias("cancel_error"),
    )
