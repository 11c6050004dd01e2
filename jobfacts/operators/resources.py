"""Node and partition rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobfacts.functions import clocks, fields


def node_summary(nodes: DataFrame) -> DataFrame:
    """Nodes and cores per cluster. MIXED counts as allocated, so the parts add up;
    available cores are those of idle nodes."""
    idle = F.col("state") == "IDLE"
    cpus = F.col("cpus").cast("bigint")
    return nodes.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("nodes_total"),
        F.count_if(idle).alias("nodes_idle"),
        F.count_if(F.col("state").isin("ALLOCATED", "MIXED")).alias("nodes_allocated"),
        F.count_if(F.col("state") == "DOWN").alias("nodes_down"),
        F.sum(cpus).alias("cores_total"),
        F.coalesce(F.sum(F.when(idle, cpus)), F.lit(0).cast("bigint")).alias("cores_available"),
    )


def node_partitions(nodes: DataFrame) -> DataFrame:
    """One row per node and partition it belongs to."""
    return nodes.select(
        "cluster",
        F.col("name").alias("node"),
        F.col("state").alias("node_state"),
        "cpus",
        F.explode("partitions").alias("name"),
    )


def partition_summary(nodes: DataFrame, partitions: DataFrame) -> DataFrame:
    """Every partition with its nodes, cpus and nodes that are up, counted from the nodes."""
    counted = (
        node_partitions(nodes)
        .groupBy("cluster", "name")
        .agg(
            F.count(F.lit(1)).alias("n_nodes"),
            F.sum(F.col("cpus").cast("bigint")).alias("n_cpus"),
            F.count_if(F.col("node_state") != "DOWN").alias("n_up"),
        )
    )
    zero = F.lit(0).cast("bigint")
    return partitions.join(counted, ["cluster", "name"], "left").select(
        "cluster",
        "name",
        "state",
        "max_time_limit",
        F.coalesce("n_nodes", zero).alias("nodes"),
        F.coalesce("n_cpus", zero).alias("cpus"),
        F.coalesce("n_up", zero).alias("nodes_up"),
    )


def partition_names(partitions: DataFrame) -> DataFrame:
    """The partition names of each cluster as one sorted, comma-joined text."""
    return partitions.groupBy("cluster").agg(
        F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("partition_names")
    )


def cluster_profile(clusters: DataFrame, nodes: DataFrame, partitions: DataFrame) -> DataFrame:
    """One row per registered cluster: backend, total and idle nodes, largest node memory, partition names."""
    capacity = nodes.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("nodes_total"),
        F.count_if(F.col("state") == "IDLE").alias("nodes_idle"),
        F.max(fields.memory_bytes(F.col("memory"))).alias("node_memory_bytes"),
    )
    types = clusters.groupBy(F.col("name").alias("cluster")).agg(
        F.coalesce(F.max("type"), F.lit("unknown")).alias("backend")
    )
    return types.join(capacity, "cluster", "left").join(partition_names(partitions), "cluster", "left")


def one_per_partition(partitions: DataFrame) -> DataFrame:
    """cluster, partition, state and max_time_limit, one row per partition.

    Of rows that repeat a partition one that is UP wins, then the longest limit, then the order of texts.
    """
    rank = F.struct(
        (F.col("state") == "UP").alias("up"), clocks.time_limit_minutes(F.col("max_time_limit")).alias("minutes"), "state", "max_time_limit"
    )
    best = partitions.groupBy("cluster", F.col("name").alias("partition")).agg(F.max(rank).alias("best"))
    return best.select("cluster", "partition", "best.state", "best.max_time_limit")
