"""Comparison with finished jobs of the same name, and of requested with used memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobfacts import fixed_values as fv
from jobfacts.functions import clocks, fields, states
from jobfacts.operators.keys import apart

_MIB = 1 << 20


def _memory_mib():
    return F.call_function("div", F.col("memory_used_bytes"), F.lit(_MIB))


def _sums(jobs: DataFrame) -> DataFrame:
    """Exact whole-number sums per (cluster, name) over finished jobs."""
    return (
        jobs.filter(states.is_terminal(F.col("state")))
        .groupBy("cluster", "name")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("runtime_seconds").alias("runtime_sum"),
            F.count("memory_used_bytes").alias("memory_n"),
            F.sum(_memory_mib()).alias("memory_sum"),
            F.count_if(F.col("state") == "COMPLETED").alias("completed"),
        )
    )


def history(jobs: DataFrame) -> DataFrame:
    """Per (cluster, name): similar jobs, average runtime and memory, success rate."""
    return _sums(jobs).select(
        "cluster",
        "name",
        F.col("n").alias("similar_jobs"),
        (F.col("runtime_sum") / F.col("n")).alias("avg_runtime_seconds"),
        F.when(F.col("memory_n") > 0, F.col("memory_sum") / F.col("memory_n")).alias(
            "avg_memory_mib"
        ),
        (F.col("completed") / F.col("n")).alias("success_rate"),
    )


def compare_with_similar(jobs: DataFrame) -> DataFrame:
    """Each job against the *other* finished jobs of its cluster and name.

    The history is aggregated first and the job's own share taken out by
    arithmetic, so no pair of jobs is ever formed.
    """
    mine = states.is_terminal(F.col("state")).cast("bigint")
    n = F.col("n") - mine
    runtime = F.col("runtime_sum") - mine * F.col("runtime_seconds")
    done = F.col("completed") - (F.col("state") == "COMPLETED").cast("bigint")
    joined = jobs.select("job_id", "cluster", "name", "state", "runtime_seconds").join(
        apart(_sums(jobs), "cluster", "name"), ["cluster", "name"], "left"
    )
    return joined.select(
        "job_id",
        "cluster",
        "name",
        F.coalesce(n, F.lit(0)).cast("bigint").alias("similar_jobs"),
        F.when(n > 0, runtime / n).alias("avg_runtime_seconds"),
        F.when(n > 0, done / n).alias("success_rate"),
    )


def suggested_minutes() -> Column:
    """Whole minutes of the average runtime plus a quarter."""
    return F.ceil(F.col("avg_runtime_seconds") * fv.HISTORY_BUFFER / 60).cast("bigint")


def suggested_memory() -> Column:
    """The average memory plus a quarter, in whole MB."""
    mib = F.ceil(F.col("avg_memory_mib") * fv.HISTORY_BUFFER).cast("bigint")
    return F.concat(mib.cast("string"), F.lit("MB"))


def time_limit_from_history(jobs: DataFrame) -> DataFrame:
    """Suggested limit per (cluster, name): average runtime plus a quarter, in whole minutes."""
    minutes = suggested_minutes()
    return history(jobs).select(
        "cluster",
        "name",
        "similar_jobs",
        minutes.alias("suggested_minutes"),
        clocks.to_clock(minutes * 60).alias("suggested_time_limit"),
    )


def requested_vs_used(jobs: DataFrame) -> DataFrame:
    """Memory used as percent of requested, per (cluster, user), with a recommendation.

    Jobs are first counted per whole percent, which each task does before the
    exchange; the exact percentile then runs over those few counts.
    """
    requested = fields.memory_bytes(F.col("resources.memory"))
    percent = F.call_function("div", F.col("memory_used_bytes") * 100, requested)
    counts = (
        jobs.filter(requested.isNotNull() & F.col("memory_used_bytes").isNotNull())
        .groupBy("cluster", "user", percent.alias("percent"))
        .agg(F.count(F.lit(1)).alias("n"), F.max(_memory_mib()).alias("max_mib"))
    )
    summed = F.sum(F.col("percent") * F.col("n")) / F.sum("n")
    return counts.groupBy("cluster", "user").agg(
        F.sum("n").alias("jobs"),
        summed.alias("avg_percent_used"),
        F.max("percent").alias("max_percent_used"),
        F.percentile("percent", F.lit(0.9), F.col("n")).alias("p90_percent_used"),
        F.ceil(F.max("max_mib") * fv.HISTORY_BUFFER).cast("bigint").alias("recommended_mib"),
    )
