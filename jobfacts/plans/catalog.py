"""The registered queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobfacts.functions import clocks, fields, states
from jobfacts.operators import (
    accounting,
    batch,
    filters,
    history,
    lists,
    normalize,
    output,
    prep,
    queue,
    resources,
    scripts,
    status,
    validate,
)
from jobfacts.plans import files, streams, views
from jobfacts.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _iso_ts(df: DataFrame, column: str = "ts") -> DataFrame:
    """Times as epoch microseconds, the same number in every engine."""
    return df.withColumn(column, F.unix_micros(column))


# ------------------------------------------------------------------------ queue
@query
def queue_status(spark, sf):
    return queue.queue_status(views.jobs(spark, sf))


@query
def queue_status_detailed(spark, sf):
    return queue.queue_status(views.jobs(spark, sf), detailed=True)


@query
def node_summary(spark, sf):
    return resources.node_summary(views.nodes(spark, sf))


@query
def utilization(spark, sf):
    summary = resources.node_summary(views.nodes(spark, sf))
    return queue.utilization(views.jobs(spark, sf), summary)


@query
def partition_summary(spark, sf):
    return resources.partition_summary(views.nodes(spark, sf), views.partitions(spark, sf))


@query
def partition_names(spark, sf):
    return resources.partition_names(views.partitions(spark, sf))


@query
def node_partitions(spark, sf):
    return resources.node_partitions(views.nodes(spark, sf))


@query
def cluster_types(spark, sf):
    return normalize.cluster_types(views.clusters(spark, sf))


@query
def clusters_redacted(spark, sf):
    shown = normalize.redacted_clusters(views.cluster_auth(spark, sf))
    return shown.select("name", F.explode("auth").alias("setting", "value"))


@query
def jobs_by_backend(spark, sf):
    jobs = views.jobs(spark, sf).drop("backend")
    typed = queue.with_backend(jobs, views.clusters(spark, sf))
    return typed.groupBy("backend", "state").agg(F.count(F.lit(1)).alias("jobs"))


# ------------------------------------------------------------------------ lists
@query
def list_jobs_recent(spark, sf):
    return normalize.concise(lists.list_jobs(views.jobs(spark, sf)))


@query
def list_jobs_filtered(spark, sf):
    jobs = views.jobs(spark, sf)
    return normalize.concise(lists.list_jobs(jobs, cluster="asia", state=" running ", limit=50))


@query
def list_total(spark, sf):
    return lists.list_total(views.jobs(spark, sf), state="FAILED")


@query
def list_envelope(spark, sf):
    """A page and its count before the limit as one JSON answer."""
    jobs = views.jobs(spark, sf)
    page = normalize.concise(lists.list_jobs(jobs, cluster="europe", state="FAILED", limit=25))
    return sinks.list_envelope(page, lists.list_total(jobs, "europe", state="FAILED"))


@query
def list_sample(spark, sf):
    return normalize.recent_projection(lists.sample(views.jobs(spark, sf)))


@query
def recent_per_cluster(spark, sf):
    recent = lists.recent_per_cluster(views.jobs(spark, sf))
    return recent.select(
        "cluster", "position", "job_id", "name", "state",
        clocks.to_clock(F.col("runtime_seconds")).alias("runtime"),
    )


@query
def job_lookup(spark, sf):
    found = filters.filter_jobs(views.jobs(spark, sf), job_id=" 100 ")
    return normalize.concise(found)


@query
def native_state_pushdown(spark, sf):
    """FAILED jobs by comparisons on stored columns only."""
    wanted = states.native_state_filter(
        "FAILED", F.col("backend"), F.col("native_state"), F.col("result")
    )
    found = views.unified_jobs(views.jobs_native(spark, sf).filter(wanted))
    return found.groupBy("cluster", "state").agg(F.count(F.lit(1)).alias("jobs"))


@query
def job_concise(spark, sf):
    return normalize.concise(views.jobs(spark, sf))


@query
def job_detailed(spark, sf):
    detailed = normalize.detailed(views.jobs(spark, sf))
    return detailed.select(
        *[c for c in detailed.columns if c not in ("resources", "allocated_nodes")],
        "resources.nodes",
        "resources.tasks",
        "resources.cpus_per_task",
        "resources.memory",
        F.array_join("allocated_nodes", ",").alias("allocated_nodes"),
    )


# ---------------------------------------------------------------- normalisation
_FLAT = [
    "job_id", "name", "state", "runtime_seconds", "exit_code", "user", "partition",
    "time_limit_seconds", "working_directory", "stdout_path", "stderr_path",
]


def _flat(jobs: DataFrame) -> DataFrame:
    return jobs.select(
        *_FLAT,
        *[F.unix_seconds(c).alias(c) for c in ("submitted", "started", "ended")],
        "resources.nodes",
        "resources.tasks",
        "resources.cpus_per_task",
        "resources.memory",
        F.size("allocated_nodes").alias("n_allocated"),
    )


def _as_of():
    return F.timestamp_seconds(F.lit(views.AS_OF))


@query
def slurm_normalized(spark, sf):
    return _flat(normalize.normalize_slurm(views.slurm_dump(spark, sf), _as_of()))


@query
def slurm_roundtrip(spark, sf):
    """Every Slurm job written as JSON text, parsed back and normalised."""
    lines = views.slurm_dump(spark, sf).select(F.to_json(F.struct("*")).alias("value"))
    return _flat(normalize.normalize_slurm(normalize.parse_slurm_lines(lines), _as_of()))


@query
def slurm_rejects(spark, sf):
    return normalize.slurm_rejects(views.slurm_dump(spark, sf)).groupBy("reject").agg(F.count(F.lit(1)).alias("jobs"))


@query
def flux_normalized(spark, sf):
    return _flat(normalize.normalize_flux(views.flux_split(spark, sf)))


@query
def flux_rejects(spark, sf):
    return normalize.flux_rejects(views.flux_split(spark, sf))


@query
def flux_short_listing(spark, sf):
    """The five-field listing; what it lacks is NULL in the union with full records."""
    short = normalize.normalize_flux(views.flux_short_split(spark, sf))
    return short.select(
        "job_id", "name", "state", F.unix_seconds("submitted").alias("submitted"), "runtime_seconds"
    )


@query
def slurm_files(spark, sf):
    return _flat(normalize.normalize_slurm(files.slurm_jobs(spark, sf, "lines"), _as_of()))


@query
def slurm_answers(spark, sf):
    return _flat(normalize.normalize_slurm(files.slurm_jobs(spark, sf, "envelope"), _as_of()))


@query
def slurm_ranges(spark, sf):
    """All jobs in one large answer of each task that writes, read by the blocks of their files."""
    return _flat(normalize.normalize_slurm(files.slurm_jobs(spark, sf, "ranges"), _as_of()))


@query
def flux_roundtrip(spark, sf):
    return _flat(normalize.normalize_flux(files.flux_jobs(spark, sf)))


@query
def flux_short_files(spark, sf):
    return normalize.normalize_flux(files.flux_short_jobs(spark, sf)).select(
        "job_id", "name", "state", F.unix_seconds("submitted").alias("submitted"), "runtime_seconds"
    )


QUERIES["clusters_file"] = files.cluster_types
QUERIES["nodes_file"] = files.node_summary
QUERIES["partitions_file"] = files.partition_names
QUERIES["commands_file"] = files.commands
QUERIES["scripts_files"] = files.script_classes
QUERIES["sensor_csv"] = files.sensor_summary
QUERIES["user_events_csv"] = files.user_events
QUERIES["split_export"] = files.split_counts


@query
def miniclusters_file(spark, sf):
    allowed = filters.in_namespaces(files.minicluster_checks(spark, sf), "ns-1, ns-2,ns-5 ,")
    return allowed.select("name", "namespace", "valid", F.array_join("reasons", "; ").alias("reasons"))


@query
def all_jobs(spark, sf):
    """Both schedulers' records in one table, counted by partition and state."""
    slurm = normalize.normalize_slurm(views.slurm_dump(spark, sf), _as_of())
    flux = normalize.normalize_flux(views.flux_split(spark, sf))
    both = normalize.union_jobs(slurm, flux)
    return both.groupBy("partition", "state").agg(
        F.count(F.lit(1)).alias("jobs"), F.sum("runtime_seconds").alias("runtime_seconds")
    )


@query
def job_summary(spark, sf):
    return normalize.job_summary(views.slurm_dump(spark, sf))


@query
def job_summary_text(spark, sf):
    return normalize.status_text(normalize.job_summary(views.slurm_dump(spark, sf)))


@query
def state_normalization(spark, sf):
    native = views.jobs_native(spark, sf)
    unified = states.unified_state(F.col("backend"), F.col("native_state"), F.col("result"))
    return native.groupBy("backend", "native_state", "result", unified.alias("state")).agg(
        F.count(F.lit(1)).alias("jobs")
    )


@query
def slurm_time_limits(spark, sf):
    native = views.jobs_native(spark, sf)
    minutes = clocks.time_limit_minutes(F.col("time_limit"))
    return native.groupBy("time_limit", minutes.alias("minutes")).agg(F.count(F.lit(1)).alias("jobs"))


@query
def flux_durations(spark, sf):
    native = views.jobs_native(spark, sf)
    seconds = clocks.flux_duration_seconds(F.col("flux_duration"))
    return native.groupBy("flux_duration", seconds.alias("seconds")).agg(
        F.count(F.lit(1)).alias("jobs")
    )


@query
def runtime_clock(spark, sf):
    jobs = views.jobs(spark, sf)
    clock = clocks.to_clock(F.col("runtime_seconds"))
    return jobs.select(
        "job_id",
        "runtime_seconds",
        clock.alias("clock"),
        clocks.from_clock(clock).alias("seconds_back"),
        clocks.duration_human(F.col("runtime_seconds")).alias("human"),
    )


@query
def memory_bytes(spark, sf):
    native = views.jobs_native(spark, sf)
    return native.groupBy("memory", fields.memory_bytes(F.col("memory")).alias("bytes")).agg(
        F.count(F.lit(1)).alias("jobs")
    )


# ------------------------------------------------------------------- accounting
@query
def accounting_page(spark, sf):
    page = accounting.accounting(views.jobs(spark, sf), cluster="africa", limit=200, detailed=True)
    return page.withColumn("nodes_used", F.array_join("nodes_used", ","))


@query
def accounting_range(spark, sf):
    jobs = views.jobs(spark, sf)
    return accounting.accounting(
        jobs, start_time="1997-01-01", end_time="1998-06-30T12:00:00Z", limit=1000
    )


@query
def accounting_store(spark, sf):
    """Jobs written by month of submission, and of that the time ranges of a table."""
    return files.accounting_ranges(spark, sf)


@query
def accounting_total(spark, sf):
    return accounting.accounting_total(views.jobs(spark, sf), start_time="1997-01-01", user="user-7")


@query
def cpu_efficiency(spark, sf):
    facts = accounting.accounting_facts(views.jobs(spark, sf))
    return facts.select("job_id", "runtime_seconds", "cpu_time_seconds", "cpu_efficiency")


@query
def wait_time(spark, sf):
    facts = accounting.accounting_facts(views.jobs(spark, sf))
    return facts.groupBy("cluster", "state").agg(
        F.count("wait_seconds").alias("started"),
        F.sum("wait_seconds").alias("total_wait_seconds"),
        F.max("wait_seconds").alias("max_wait_seconds"),
    )


# ---------------------------------------------------------- requests and scripts
@query
def request_checks(spark, sf):
    checked = filters.check_requests(views.requests(spark, sf))
    return checked.select(
        "request_id", "success", F.array_join("reasons", "; ").alias("reasons")
    )


@query
def minicluster_checks(spark, sf):
    checked = filters.check_miniclusters(views.minicluster_specs(spark, sf))
    allowed = filters.in_namespaces(checked, "ns-1, ns-2,ns-5 ,")
    return allowed.select("name", "namespace", "valid", F.array_join("reasons", "; ").alias("reasons"))


@query
def unknown_clusters(spark, sf):
    found = filters.unknown_clusters(views.requests(spark, sf), views.clusters(spark, sf))
    return found.select("request_id", "cluster")


@query
def script_classes(spark, sf):
    classified = scripts.classify(views.requests(spark, sf))
    return classified.select(
        "request_id", "cpu_intensive", "memory_intensive", "io_intensive", "mpi_ranks"
    )


@query
def script_estimates(spark, sf):
    estimated = scripts.estimate(scripts.classify(views.requests(spark, sf)))
    return estimated.select(
        "request_id", "workload", "estimated_memory", "estimated_runtime",
        "recommended_nodes", "recommended_tasks",
    )


@query
def script_recommendations(spark, sf):
    advised = scripts.recommend(scripts.estimate(scripts.classify(views.requests(spark, sf))))
    return scripts.recommendation_rows(advised)


@query
def workload_mix(spark, sf):
    return scripts.workload_mix(scripts.classify(views.requests(spark, sf)))


@query
def script_analysis(spark, sf):
    analyzed = scripts.analyze(
        views.requests(spark, sf), views.clusters(spark, sf), views.jobs(spark, sf)
    )
    return analyzed.select(
        "request_id", "backend", "workload", "similar_jobs", "avg_runtime_seconds",
        "avg_memory_mib", "success_rate", F.size("recommendations").alias("n_recommendations"),
    )


@query
def script_advice(spark, sf):
    """Every recommendation of the analysis, with values from history where there is one."""
    analyzed = scripts.analyze(
        views.requests(spark, sf), views.clusters(spark, sf), views.jobs(spark, sf)
    )
    return scripts.recommendation_rows(analyzed)


def _validated(spark, sf):
    partitions = views.partitions(spark, sf)
    down = partitions.filter(F.col("name") == "low").withColumn("state", F.lit("DOWN"))
    repeated = partitions.unionByName(down)  # a partition listed twice: the one that is UP counts
    return validate.validate(
        views.requests(spark, sf),
        views.clusters(spark, sf),
        views.nodes(spark, sf),
        repeated,
    )


@query
def validate_issues(spark, sf):
    return validate.issue_rows(_validated(spark, sf)).drop("position")


@query
def validate_recommendations(spark, sf):
    return validate.recommendation_rows(_validated(spark, sf))


@query
def validate_rollup(spark, sf):
    return validate.rollup_by_request(_validated(spark, sf))


@query
def validate_issue_kinds(spark, sf):
    return validate.rollup_by_kind(validate.issue_rows(_validated(spark, sf)))


@query
def missing_partitions(spark, sf):
    return validate.missing_partitions(
        views.requests(spark, sf), views.clusters(spark, sf), views.partitions(spark, sf)
    )


# ---------------------------------------------------------------------- history
@query
def history_comparison(spark, sf):
    return history.history(views.jobs(spark, sf))


@query
def similar_jobs(spark, sf):
    return history.compare_with_similar(views.jobs(spark, sf))


@query
def time_limit_from_history(spark, sf):
    return history.time_limit_from_history(views.jobs(spark, sf))


@query
def requested_vs_used(spark, sf):
    return history.requested_vs_used(views.jobs(spark, sf))


# ---------------------------------------------------------------------- batches
@query
def array_expansion(spark, sf):
    return batch.expand_arrays(views.batches(spark, sf))


@query
def array_errors(spark, sf):
    return batch.array_errors(views.batches(spark, sf))


@query
def capped_tasks(spark, sf):
    return batch.expand_arrays(views.batches(spark, sf), cap=3)


@query
def bulk_commands(spark, sf):
    return batch.expand_commands(views.batches(spark, sf))


@query
def batch_sources(spark, sf):
    checked = batch.has_one_source(views.batches(spark, sf).withColumn(
        "commands", F.when(F.col("batch_id") % 4 == 0, F.col("commands"))))
    return checked.select("batch_id", "reason")


@query
def batch_summary(spark, sf):
    given = views.batches(spark, sf)
    key = F.col("batch_id")
    words = F.when(key % 11 == 0, F.array(F.lit("a"))).when(key % 4 != 1, F.col("commands"))
    return batch.batch_summary(given.withColumn("commands", words))


@query
def param_sweep(spark, sf):
    tasks = batch.expand_arrays(views.batches(spark, sf))
    swept = batch.sweep(tasks, views.sweep_parameters(spark))
    return swept.withColumn("parameter", F.col("parameter").cast("double"))


@query
def sweep_export(spark, sf):
    return files.sweep_results(spark, sf, param_sweep(spark, sf))


@query
def sweep_performance(spark, sf):
    """Every job taken as a sweep task whose parameter follows from its id."""
    runs = views.jobs(spark, sf).select(
        (F.col("native_id") % 12).alias("task_id"), "runtime_seconds", "state"
    )
    swept = batch.sweep(runs, views.sweep_parameters(spark))
    done = batch.sweep_performance(swept)
    return done.withColumn("parameter", F.col("parameter").cast("double"))


# --------------------------------------------------------------- output, cancels
_STREAM = ["native_id", "stream"]
_LINE_ORDER = ["turn", "line_no", "line"]


@query
def tail_lines(spark, sf):
    tails = output.tail_lines(views.output_lines(spark, sf), 3, _STREAM, _LINE_ORDER)
    return tails.select(*_STREAM, "from_end", "line", "truncated")


@query
def tail_output(spark, sf):
    return output.tail_output(views.output_lines(spark, sf), 5, _STREAM, _LINE_ORDER)


@query
def tail_text(spark, sf):
    turns = views.table(spark, sf, "conversations")
    return turns.select(
        "conv_id",
        "turn",
        output.tail_text(F.col("text"), 2).alias("tail"),
        output.is_truncated(F.col("text"), 2).alias("truncated"),
    )


@query
def job_results(spark, sf):
    """Jobs with the tail of their output; only jobs that are over."""
    ended = filters.terminal_only(views.jobs(spark, sf))
    tails = output.tail_output(views.output_lines(spark, sf), 2, _STREAM, _LINE_ORDER)
    results = output.with_output(ended.select("native_id", "job_id", "state", "exit_code"), tails, "native_id")
    return results.select("job_id", "state", "exit_code", "stdout", "stderr")


@query
def jobs_with_output(spark, sf):
    found = output.jobs_with_output(views.jobs(spark, sf), views.outputs(spark, sf), "native_id")
    return found.select("job_id", "state")


@query
def jobs_without_output(spark, sf):
    found = output.jobs_without_output(views.jobs(spark, sf), views.outputs(spark, sf), "native_id")
    return found.select("job_id", "stdout_path", "stderr_path")


@query
def cancel_merge(spark, sf):
    jobs = views.jobs(spark, sf).select("native_id", "job_id", "state")
    return status.apply_cancels(jobs, views.cancels(spark, sf), "native_id")


# ----------------------------------------------------------------------- status
@query
def latest_status(spark, sf):
    return _iso_ts(status.latest_status(views.status(spark, sf)))


@query
def first_terminal(spark, sf):
    return _iso_ts(status.first_terminal(views.status(spark, sf)))


@query
def status_timeouts(spark, sf):
    return _iso_ts(status.outcomes(views.status(spark, sf), 60))


@query
def minicluster_ready(spark, sf):
    return _iso_ts(status.first_ready(views.minicluster_status(spark, sf)))


@query
def stream_terminal(spark, sf):
    return _iso_ts(streams.first_terminal(spark, sf))


@query
def stream_timeout(spark, sf):
    return _iso_ts(streams.outcomes(spark, sf))


@query
def stream_minicluster_ready(spark, sf):
    return _iso_ts(streams.first_ready(spark, sf))


@query
def stream_ready_timeout(spark, sf):
    """Readiness within six hours of a MiniCluster's first status."""
    return _iso_ts(_iso_ts(streams.readiness(spark, sf, 360)), "decided")


@query
def output_files(spark, sf):
    """All output written as job files and read back with line numbers."""
    return files.output_lines(spark, sf)


@query
def output_file_tails(spark, sf):
    """The ends of all job files."""
    return files.output_tails(spark, sf, 3)


@query
def stream_queue_status(spark, sf):
    return streams.queue_status(spark, sf)


# ------------------------------------------------------------- data preparation
_LOW, _HIGH = 0.05, 200.0


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _mean_rounded(df: DataFrame) -> DataFrame:
    """More digits for means: halves of two-digit values would be ties at six."""
    return df.withColumn("value", F.round("value", 8))


@query
def range_rejects(spark, sf):
    checked = prep.check_ranges(views.readings(spark, sf), _LOW, _HIGH)
    return prep.rejected(checked).select("reading_id", "sensor_id", "value", "reject")


@query
def impute(spark, sf):
    filled = prep.impute(views.unique_readings(spark, sf))
    return _mean_rounded(filled.select("reading_id", "sensor_id", "value", "imputed"))


@query
def outliers(spark, sf):
    flagged = prep.flag_outliers(views.unique_readings(spark, sf))
    return flagged.select("reading_id", "sensor_id", "outlier")


@query
def dedup(spark, sf):
    unique = prep.deduplicate(views.readings(spark, sf), ["reading_id"])
    return unique.select("reading_id", "sensor_id", "value")


@query
def source_union(spark, sf):
    """Readings and output lines as two sources of one table, counted by source."""
    sensors = views.readings(spark, sf).select(F.lit("sensors").alias("source"), "sensor_id", "value")
    logs = views.output_lines(spark, sf).select(F.lit("logs").alias("source"), "line")
    both = prep.union_sources(sensors, logs)
    return both.groupBy("source").agg(
        F.count(F.lit(1)).alias("records"),
        F.count("value").alias("with_value"),
        F.count("line").alias("with_line"),
    )


@query
def temporal_features(spark, sf):
    timed = prep.temporal_features(views.unique_readings(spark, sf))
    return timed.select("reading_id", "hour_of_day", "day_of_week", "is_weekend")


@query
def rolling_stats(spark, sf):
    rolled = prep.rolling_stats(views.unique_readings(spark, sf))
    return _rounded(rolled.select("reading_id", "rolling_avg", "rolling_std"), "rolling_avg", "rolling_std")


@query
def percentile_rank(spark, sf):
    ranked = prep.percentile_rank(views.unique_readings(spark, sf))
    return _rounded(ranked.select("reading_id", "sensor_id", "percentile_rank"), "percentile_rank")


@query
def log_transform(spark, sf):
    logged = prep.log_transform(views.unique_readings(spark, sf))
    return _rounded(logged.select("reading_id", "log_value"), "log_value")


@query
def scaling(spark, sf):
    scaled = prep.min_max_scale(views.unique_readings(spark, sf))
    return _rounded(scaled.select("reading_id", "sensor_id", "scaled"), "scaled")


@query
def one_hot(spark, sf):
    encoded = prep.one_hot(views.unique_readings(spark, sf), "kind", views.EVENT_TYPES)
    return encoded.select("reading_id", *[f"kind_{v}" for v in views.EVENT_TYPES])


@query
def clean_readings(spark, sf):
    cleaned = prep.clean(views.readings(spark, sf), _LOW, _HIGH)
    columns = ["reading_id", "sensor_id", "value", "imputed", "outlier", "scaled"]
    return _rounded(_mean_rounded(cleaned.select(*columns)), "scaled")


@query
def feature_table(spark, sf):
    """The whole preparation: cleaned readings with all their features."""
    source = views.readings(spark, sf)
    made = prep.feature_table(prep.clean(source, _LOW, _HIGH), views.EVENT_TYPES)
    names = prep.feature_names(made, source)
    digits = {"rolling_avg": 6, "rolling_std": 6, "percentile_rank": 6, "log_value": 6, "scaled": 6}
    return made.select("reading_id", *[F.round(n, digits[n]).alias(n) if n in digits else n for n in names])


@query
def split_counts(spark, sf):
    return prep.split_counts(prep.assign_split(views.unique_readings(spark, sf), "reading_id"))


@query
def quality_report(spark, sf):
    return prep.quality_report(prep.quality_counters(views.readings(spark, sf), _LOW, _HIGH))


@query
def run_metadata(spark, sf):
    source = views.readings(spark, sf)
    cleaned = prep.clean(source, _LOW, _HIGH)
    split = prep.assign_split(cleaned, "reading_id")
    counters = prep.quality_counters(source, _LOW, _HIGH)
    names = prep.feature_names(prep.feature_table(cleaned, views.EVENT_TYPES), source)
    return sinks.run_metadata("run", counters, prep.split_counts(split), len(names)).select(
        "pipeline_id", "input_records", "output_records", "splits.*", "features", "quality_metrics.*"
    )
