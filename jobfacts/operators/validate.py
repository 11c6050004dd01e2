"""Pre-flight checks of job requests against their cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobfacts import fixed_values as fv
from jobfacts.functions import clocks, fields
from jobfacts.functions import scripts as text
from jobfacts.operators import resources


def _issue(severity: str, category: str, message: Column, line: int | None = None) -> Column:
    return F.struct(
        F.lit(severity).alias("severity"),
        F.lit(category).alias("category"),
        message.alias("message"),
        F.lit(line).cast("int").alias("line"),
    )


def _facts(
    requests: DataFrame, clusters: DataFrame, nodes: DataFrame, partitions: DataFrame
) -> DataFrame:
    """What the rules need to know about each request. The script text ends here.

    Every request has its row. Clusters and partitions are joined to the narrow facts; Spark
    sends them to the tasks when they are small and splits a frequent cluster when not.
    """
    script = F.coalesce("script", F.lit(""))
    lowered = F.lower(script)
    narrow = requests.select(
        "request_id",
        "cluster",
        F.col("nodes"),
        clocks.strip(F.col("time_limit")).alias("time_limit"),
        clocks.strip(F.col("partition")).alias("partition"),
        clocks.strip(F.col("memory")).alias("memory"),
        text.has_shebang(script).alias("has_shebang"),
        text.only_comments(script).alias("only_comments"),
        text.loads_modules(lowered).alias("loads_modules"),
    )
    profile = resources.cluster_profile(clusters, nodes, partitions)
    listed = resources.one_per_partition(partitions).withColumnsRenamed({"state": "partition_state"})
    return narrow.join(profile, "cluster", "left").join(listed, ["cluster", "partition"], "left")


def _issues() -> list[Column]:
    nodes, total, idle = F.col("nodes"), F.col("nodes_total"), F.col("nodes_idle")
    limit, partition, memory = F.col("time_limit"), F.col("partition"), F.col("memory")
    over_total = (nodes >= 1) & (total > 0) & (nodes > total)
    over_idle = (nodes >= 1) & ~over_total & (idle > 0) & (nodes > idle)
    limit_ok = text.matches_any(limit, fv.SCRIPT_TIME_FORMATS)
    on_slurm = (F.col("backend") == "slurm") & partition.isNotNull()
    listed = F.col("partition_names").isNotNull()
    state = F.col("partition_state")
    too_long = clocks.time_limit_minutes(limit) > clocks.time_limit_minutes(F.col("max_time_limit"))
    return [
        F.when(
            F.col("backend").isNull(),
            _issue("error", "resources", F.concat(F.lit("Unknown cluster: "), F.coalesce("cluster", F.lit("none")))),
        ),
        F.when(~F.col("has_shebang"), _issue("error", "syntax", F.lit(fv.NO_SHEBANG), 1)),
        F.when(
            nodes < 1, _issue("error", "resources", F.format_string(fv.NODES_TOO_FEW, nodes))
        ),
        F.when(
            over_total,
            _issue("error", "resources", F.format_string(fv.NODES_OVER_TOTAL, nodes, total)),
        ),
        F.when(
            over_idle,
            _issue("warning", "resources", F.format_string(fv.NODES_OVER_IDLE, nodes, idle, total)),
        ),
        F.when(limit == "", _issue("error", "syntax", F.lit(fv.TIME_LIMIT_EMPTY))),
        F.when(
            (limit != "") & ~limit_ok,
            _issue("error", "syntax", F.format_string(fv.TIME_LIMIT_FORMAT, limit)),
        ),
        F.when(
            on_slurm & listed & state.isNull(),
            _issue(
                "error",
                "resources",
                F.format_string(fv.PARTITION_MISSING, partition, F.col("partition_names")),
            ),
        ),
        F.when(
            on_slurm & (state != "UP"),
            _issue("warning", "resources", F.format_string(fv.PARTITION_NOT_UP, partition, state)),
        ),
        F.when(
            on_slurm & limit_ok & too_long,
            _issue(
                "error",
                "limits",
                F.format_string(
                    fv.TIME_LIMIT_OVER_MAX, limit, F.col("max_time_limit"), partition
                ),
            ),
        ),
        F.when(
            fields.memory_bytes(memory) > F.col("node_memory_bytes"),
            _issue("error", "resources", F.format_string(fv.MEMORY_NOT_FEASIBLE, memory)),
        ),
        F.when(F.col("only_comments"), _issue("warning", "syntax", F.lit(fv.ONLY_COMMENTS))),
        F.when(F.col("loads_modules"), _issue("info", "compatibility", F.lit(fv.MODULE_LOAD))),
    ]


def _recommendations() -> Column:
    nodes, total = F.col("nodes"), F.col("nodes_total")
    lower_nodes = F.struct(
        F.lit("nodes").alias("field"),
        nodes.cast("string").alias("current"),
        total.cast("string").alias("suggested"),
        F.lit(fv.CLUSTER_MAXIMUM).alias("reason"),
    )
    found = F.array(F.when((nodes >= 1) & (total > 0) & (nodes > total), lower_nodes))
    return F.filter(found, lambda r: r.isNotNull())


def validate(
    requests: DataFrame, clusters: DataFrame, nodes: DataFrame, partitions: DataFrame
) -> DataFrame:
    """One row per request: ``valid``, ``issues`` and ``recommendations``."""
    issues = F.filter(F.array(*_issues()), lambda i: i.isNotNull())
    return (
        _facts(requests, clusters, nodes, partitions)
        .select(
            "request_id",
            "cluster",
            issues.alias("issues"),
            _recommendations().alias("recommendations"),
        )
        .withColumn("valid", ~F.exists("issues", lambda i: i["severity"] == "error"))
    )


def issue_rows(validated: DataFrame) -> DataFrame:
    """One row per issue, numbered within its request.

    The outer form keeps the optimizer from testing the list for emptiness below
    the projection, which would run every check on the script text twice.
    """
    return (
        validated.select(
            "request_id", "cluster", F.posexplode_outer("issues").alias("position", "issue")
        )
        .filter(F.col("issue").isNotNull())
        .select("request_id", "cluster", "position", "issue.*")
    )


def recommendation_rows(validated: DataFrame) -> DataFrame:
    return (
        validated.select("request_id", "cluster", F.explode_outer("recommendations").alias("r"))
        .filter(F.col("r").isNotNull())
        .select("request_id", "cluster", "r.*")
    )


def rollup_by_request(validated: DataFrame) -> DataFrame:
    """Per request: whether it is valid, and how many issues of each severity it has."""

    def count(severity: str) -> Column:
        return F.size(F.filter("issues", lambda i: i["severity"] == severity)).cast("bigint")

    return validated.select(
        "request_id",
        "valid",
        count("error").alias("errors"),
        count("warning").alias("warnings"),
        count("info").alias("infos"),
    )


def rollup_by_kind(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity", "category").agg(F.count(F.lit(1)).alias("issues"))


def missing_partitions(requests: DataFrame, clusters: DataFrame, partitions: DataFrame) -> DataFrame:
    """The (cluster, partition) pairs asked for on Slurm clusters that do not exist."""
    slurm = clusters.filter(F.col("type") == "slurm").select(F.col("name").alias("cluster"))
    existing = partitions.select("cluster", F.col("name").alias("partition"))
    asked = (
        requests.select("cluster", clocks.strip(F.col("partition")).alias("partition"))
        .filter(F.col("partition").isNotNull())
        .distinct()
    )
    return asked.join(slurm, "cluster", "left_semi").join(
        existing, ["cluster", "partition"], "left_anti"
    )
