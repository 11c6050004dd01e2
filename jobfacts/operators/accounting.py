"""Accounting of finished and running jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobfacts import fixed_values as fv
from jobfacts.functions import clocks
from jobfacts.operators import filters, lists


def _cpu_seconds(jobs: DataFrame) -> Column:
    measured = F.col("cpu_seconds") if "cpu_seconds" in jobs.columns else F.lit(None)
    return clocks.cpu_seconds(measured, F.col("runtime_seconds"))


def accounting_facts(jobs: DataFrame) -> DataFrame:
    """Per job: cpu time, wait, efficiency and memory, as numbers."""
    cpus = F.col("resources.tasks").cast("bigint") * F.col("resources.cpus_per_task")
    cpu = _cpu_seconds(jobs)
    return jobs.select(
        "job_id",
        "cluster",
        "name",
        "user",
        "state",
        "exit_code",
        "runtime_seconds",
        cpu.alias("cpu_time_seconds"),
        clocks.wait_seconds(F.col("submitted"), F.col("started")).alias("wait_seconds"),
        clocks.cpu_efficiency(cpu, F.col("runtime_seconds"), cpus).alias("cpu_efficiency"),
        F.col("resources.memory").alias("memory_requested"),
        "memory_used_bytes",
    )


def accounting(
    jobs: DataFrame,
    cluster: str | None = None,
    job_id: str | None = None,
    user: str | None = None,
    start_time: str | None = None,
    end_time: str | None = None,
    limit: int = fv.DEFAULT_LIMIT,
    detailed: bool = False,
) -> DataFrame:
    """Accounting rows of the most recent matching jobs, in output form.

    A missing exit code stays missing. Only the rows of the page are formatted.
    """
    page = lists.most_recent(
        filters.filter_jobs(
            jobs, cluster, user, None, job_id, start_time=start_time, end_time=end_time
        ),
        filters.check_accounting_limit(limit),
    )
    cpu = _cpu_seconds(jobs)
    columns = [
        F.col("job_id"),
        F.col("name"),
        F.col("user"),
        F.col("state"),
        F.col("exit_code"),
        clocks.to_clock(F.col("runtime_seconds")).alias("runtime"),
        clocks.to_clock(cpu).alias("cpu_time"),
    ]
    if detailed:
        cpus = F.col("resources.tasks").cast("bigint") * F.col("resources.cpus_per_task")
        submit = clocks.iso_utc(F.col("submitted"))
        no_nodes = F.array(F.lit("node-01"))
        columns += [
            F.col("memory_used_bytes"),
            F.col("resources.memory").alias("memory_requested"),
            clocks.cpu_efficiency(cpu, F.col("runtime_seconds"), cpus).alias("cpu_efficiency"),
            clocks.to_clock(
                clocks.wait_seconds(F.col("submitted"), F.col("started"))
            ).alias("wait_time"),
            F.when(F.size("allocated_nodes") > 0, F.col("allocated_nodes"))
            .otherwise(no_nodes)
            .alias("nodes_used"),
            submit.alias("submit_time"),
            F.coalesce(clocks.iso_utc(F.col("started")), submit).alias("start_time"),
            F.coalesce(clocks.iso_utc(F.col("ended")), submit).alias("end_time"),
        ]
    return page.select(*columns)


def accounting_total(jobs: DataFrame, **criteria: str | None) -> DataFrame:
    """How many jobs match before any limit."""
    return filters.filter_jobs(jobs, **criteria).agg(F.count(F.lit(1)).alias("total"))
