"""Response envelopes, dataset exports, run metadata, reports and sweep records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobfacts import fixed_values as fv
from jobfacts.operators import prep
from jobfacts.sources import job_files, script_files


def list_envelope(page: DataFrame, total: DataFrame) -> DataFrame:
    """One JSON text ``{success, jobs, total, filtered}``.

    Only the rows of a limited page are gathered; ``total`` is the one-row count
    taken before the limit.
    """
    row = F.struct(*page.columns)
    newest_first = F.reverse(F.sort_array(F.collect_list(row)))
    jobs = page.agg(newest_first.alias("jobs"))
    once = total.select(F.struct("*")).scalar()
    counted = [once[c].alias(c) for c in total.columns]
    return jobs.select(
        F.to_json(
            F.struct(F.lit(True).alias("success"), "jobs", *counted),
            {"ignoreNullFields": "false"},
        ).alias("response")
    )


def write_job_output(lines: DataFrame, path: str, order: list[str]) -> None:
    """``<job>.out`` and ``<job>.err`` files of ``lines`` (job_id, stream, line and the columns of ``order``).

    A file is written by one task, line by line, and appears whole or not at all.
    """
    job_files.registered(lines.sparkSession)
    dealt = lines.repartition("job_id", "stream").sortWithinPartitions("job_id", "stream", *order)
    dealt.select("job_id", "stream", "line").write.format("job_output").mode("append").save(path)


def write_scripts(scripts: DataFrame, path: str) -> None:
    """A file for each row of ``scripts`` (script), in folders that tasks fill; null is written as empty."""
    script_files.registered(scripts.sparkSession)
    scripts.select("script").write.format("script_files").mode("append").save(path)


def write_splits(table: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Train, validation and test as one parquet folder each."""
    table.write.mode(mode).partitionBy("split").parquet(path)


def run_metadata(
    pipeline_id: str, counters: DataFrame, splits: DataFrame, features: int
) -> DataFrame:
    """One row with counts, split sizes and quality metrics."""
    names = [name for name, _ in fv.SPLIT_SHARES]
    zero = F.lit(0).cast("bigint")
    sizes = splits.agg(
        F.struct(
            *[
                F.coalesce(F.max(F.when(F.col("split") == n, F.col("records"))), zero).alias(n)
                for n in names
            ]
        )
    )
    return counters.select(
        F.lit(pipeline_id).alias("pipeline_id"),
        "input_records",
        "output_records",
        sizes.scalar().alias("splits"),
        F.lit(features).alias("features"),
        F.struct(
            "rejected_records", "missing_values_imputed", "outliers_detected", "duplicates_removed"
        ).alias("quality_metrics"),
    )


def write_metadata(metadata: DataFrame, path: str, mode: str = "errorifexists") -> None:
    metadata.write.mode(mode).json(path)


def write_quality_report(counters: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The counters as ``metric: value`` text lines."""
    lines = prep.quality_report(counters).select(F.format_string("%s: %d", "metric", "value"))
    lines.write.mode(mode).text(path)


def write_sweep_results(
    results: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists"
) -> None:
    """One record per sweep task."""
    if format not in ("json", "parquet"):
        raise ValueError(f"format must be json or parquet, got {format!r}")
    results.write.mode(mode).format(format).save(path)
