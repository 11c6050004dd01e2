"""Queue status and utilisation per cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _in_state(state: str) -> Column:
    return F.count_if(F.col("state") == state)


def queue_status(jobs: DataFrame, detailed: bool = False) -> DataFrame:
    """Job counts per cluster in one pass; the total includes states not shown."""
    counts = [
        F.count(F.lit(1)).alias("total_jobs"),
        _in_state("RUNNING").alias("running"),
        _in_state("PENDING").alias("pending"),
        _in_state("COMPLETED").alias("completed"),
    ]
    if detailed:
        counts += [_in_state("FAILED").alias("failed"), _in_state("CANCELLED").alias("cancelled")]
    return jobs.groupBy("cluster").agg(*counts)


def utilization(jobs: DataFrame, node_summary: DataFrame) -> DataFrame:
    """Nodes and cores held by running jobs against what the cluster has, capped at it."""
    cores = F.col("resources.tasks").cast("bigint") * F.col("resources.cpus_per_task")
    held = (
        jobs.filter(F.col("state") == "RUNNING")
        .groupBy("cluster")
        .agg(
            F.sum(F.col("resources.nodes").cast("bigint")).alias("nodes_held"),
            F.sum(cores).alias("cores_held"),
        )
    )
    zero = F.lit(0).cast("bigint")
    return node_summary.join(held, "cluster", "left").select(
        "cluster",
        F.least(F.coalesce("nodes_held", zero), "nodes_total").alias("nodes_allocated"),
        "nodes_total",
        F.least(F.coalesce("cores_held", zero), "cores_total").alias("cores_allocated"),
        "cores_total",
    )


def with_backend(table: DataFrame, clusters: DataFrame) -> DataFrame:
    """Add the backend type of each row's cluster; an unlisted cluster is ``unknown``."""
    types = clusters.select(
        F.col("name").alias("cluster"), F.coalesce("type", F.lit("unknown")).alias("backend")
    )
    return table.join(types, "cluster", "left").withColumn(
        "backend", F.coalesce("backend", F.lit("unknown"))
    )
