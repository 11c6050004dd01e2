"""Job lists: filtered, most recent first, limited, with the count before the limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobfacts import fixed_values as fv
from jobfacts.operators import filters


def most_recent(jobs: DataFrame, limit: int = fv.DEFAULT_LIMIT) -> DataFrame:
    """The first ``limit`` jobs by id as text, highest first: a bounded top-k, no full sort."""
    return jobs.orderBy(F.col("job_id").desc()).limit(filters.check_list_limit(limit))


def list_jobs(
    jobs: DataFrame,
    cluster: str | None = None,
    user: str | None = None,
    state: str | None = None,
    limit: int = fv.DEFAULT_LIMIT,
) -> DataFrame:
    return most_recent(filters.filter_jobs(jobs, cluster, user, state), limit)


def list_total(
    jobs: DataFrame, cluster: str | None = None, user: str | None = None, state: str | None = None
) -> DataFrame:
    """Count before the limit, and whether a filter was given, as one row."""
    return filters.filter_jobs(jobs, cluster, user, state).agg(
        F.count(F.lit(1)).alias("total"),
        F.lit(filters.is_filtered(user, state)).alias("filtered"),
    )


def sample(jobs: DataFrame) -> DataFrame:
    return most_recent(jobs, fv.RECENT_JOBS)


def recent_per_cluster(jobs: DataFrame, n: int = fv.RECENT_JOBS) -> DataFrame:
    """The ``n`` most recent jobs of each cluster.

    Each task keeps its own best ``n`` per cluster before the exchange, so a
    cluster with most of the jobs costs no more than any other.
    """
    w = W.partitionBy("cluster").orderBy(F.col("job_id").desc())
    return jobs.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)
