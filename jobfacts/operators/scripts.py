"""Workload classes, resource estimates and recommendations for script corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobfacts import fixed_values as fv
from jobfacts.functions import clocks
from jobfacts.functions import scripts as text
from jobfacts.operators import history as past
from jobfacts.operators.queue import with_backend

_CLASSES = ("cpu", "memory", "io", "generic")


def classify(requests: DataFrame) -> DataFrame:
    """Add the three class flags and the MPI rank hint; the script text is dropped.

    Everything that needs the text is computed here, so later joins and
    exchanges move only a few narrow columns per script.
    """
    kept = [c for c in requests.columns if c != "script"]
    lowered, found = F.col("__lowered"), F.col("__words")
    return (
        requests.select(*kept, F.lower("script").alias("__lowered"))
        .withColumn("__words", text.words(lowered))
        .select(
            *kept,
            text.intensive(lowered, found, fv.CPU_WORDS, fv.CPU_PHRASES).alias("cpu_intensive"),
            text.intensive(lowered, found, fv.MEMORY_WORDS, fv.MEMORY_PHRASES).alias(
                "memory_intensive"
            ),
            text.intensive(lowered, found, fv.IO_WORDS, fv.IO_PHRASES).alias("io_intensive"),
            F.when(lowered.contains("mpirun"), text.mpi_ranks(lowered)).alias("mpi_ranks"),
        )
    )


def _workload() -> Column:
    return (
        F.when(F.col("cpu_intensive"), F.lit("cpu"))
        .when(F.col("memory_intensive"), F.lit("memory"))
        .when(F.col("io_intensive"), F.lit("io"))
        .otherwise(F.lit("generic"))
    )


def _estimate(position: int) -> Column:
    chosen = F.lit(None)
    for name in reversed(_CLASSES):
        value = F.lit(fv.ESTIMATES[name][position])
        chosen = F.when(F.col("workload") == name, value).otherwise(chosen)
    return chosen


def estimate(classified: DataFrame) -> DataFrame:
    """Add memory, runtime, nodes and tasks by the first class that matches."""
    ranks = F.when(F.col("workload") == "cpu", F.col("mpi_ranks"))
    by_ranks = F.greatest(F.lit(1), F.call_function("div", ranks, F.lit(fv.RANKS_PER_NODE)))
    return classified.withColumn("workload", _workload()).select(
        "*",
        _estimate(0).alias("estimated_memory"),
        _estimate(1).alias("estimated_runtime"),
        F.when(ranks.isNotNull(), by_ranks.cast("int")).otherwise(_estimate(2)).alias(
            "recommended_nodes"
        ),
        F.coalesce(ranks, _estimate(3)).alias("recommended_tasks"),
    )


def _advice(parameter: str, value: Column, confidence: Column, reason: Column) -> Column:
    return F.struct(
        F.lit(parameter).alias("parameter"),
        value.cast("string").alias("value"),
        confidence.alias("confidence"),
        reason.alias("reason"),
    )


def recommend(estimated: DataFrame) -> DataFrame:
    """Add ``recommendations``: four per script, a fifth for I/O-heavy ones."""
    cpu, memory, io = (F.col(f"{c}_intensive") for c in ("cpu", "memory", "io"))

    def pick(flag: Column, yes: str, no: str) -> Column:
        return F.when(flag, F.lit(yes)).otherwise(F.lit(no))

    nodes = F.col("recommended_nodes")
    why_nodes = F.format_string(fv.NODES_REASON, pick(cpu, *fv.NODES_BASIS), nodes)
    why_tasks = F.format_string(fv.TASKS_REASON, pick(cpu, *fv.TASKS_BASIS))
    why_memory = F.format_string(fv.MEMORY_REASON, pick(memory, *fv.MEMORY_BASIS))
    why_time, why_partition = F.lit(fv.TIME_REASON), F.lit(fv.PARTITION_REASON)
    medium, low = F.lit("medium"), F.lit("low")
    advice = F.array(
        _advice("nodes", nodes, pick(cpu, "high", "medium"), why_nodes),
        _advice("tasks", F.col("recommended_tasks"), medium, why_tasks),
        _advice("memory", F.col("estimated_memory"), pick(memory, "medium", "low"), why_memory),
        _advice("time_limit", F.col("estimated_runtime"), low, why_time),
        F.when(io, _advice("partition", F.lit(fv.IO_PARTITION), medium, why_partition)),
    )
    return estimated.withColumn("recommendations", F.filter(advice, lambda a: a.isNotNull()))


def recommendation_rows(recommended: DataFrame, key: str = "request_id") -> DataFrame:
    """One row per recommendation; every script has some, so the outer form loses nothing."""
    return recommended.select(key, F.explode_outer("recommendations").alias("r")).select(key, "r.*")


def analyze(requests: DataFrame, clusters: DataFrame, jobs: DataFrame) -> DataFrame:
    """Classes, estimates, recommendations, backend and history of every script.

    A script's history are the finished jobs of its job name on its cluster. Where there
    are some, their averages give the time limit and the memory instead of the class.
    """
    analyzed = recommend(estimate(classify(requests)))
    known = past.history(jobs).withColumnRenamed("name", "job_name")
    return (
        with_backend(analyzed, clusters)
        .join(known, ["cluster", "job_name"], "left")
        .withColumn("similar_jobs", F.coalesce("similar_jobs", F.lit(0).cast("bigint")))
        .withColumn("success_rate", F.coalesce("success_rate", F.lit(0.0)))
        .withColumn("recommendations", F.transform("recommendations", _with_history))
    )


def _with_history(advice: Column) -> Column:
    reason = F.format_string(fv.HISTORY_REASON, F.col("similar_jobs"))

    def known(parameter: str, value: Column) -> Column:
        return _advice(parameter, value, F.lit("medium"), reason)

    limit = clocks.to_clock(past.suggested_minutes() * 60)
    return (
        F.when(
            (advice["parameter"] == "time_limit") & F.col("avg_runtime_seconds").isNotNull(), known("time_limit", limit)
        )
        .when(
            (advice["parameter"] == "memory") & F.col("avg_memory_mib").isNotNull(), known("memory", past.suggested_memory())
        )
        .otherwise(advice)
    )


def workload_mix(classified: DataFrame) -> DataFrame:
    return classified.groupBy("cpu_intensive", "memory_intensive", "io_intensive").agg(
        F.count(F.lit(1)).alias("scripts")
    )
