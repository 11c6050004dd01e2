"""Native job records to the unified job table, and its projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobfacts import fixed_values as fv
from jobfacts import schemas
from jobfacts.functions import clocks, fields, states


def parse_slurm_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Text rows holding one Slurm job as JSON each, as typed columns."""
    # a one-row generator, so that a line is parsed once and not once per field used
    return typed_numbers(lines.select(F.inline(F.array(F.from_json(column, schemas.slurm_text())))))


def typed_numbers(jobs: DataFrame) -> DataFrame:
    """Slurm jobs read with ``schemas.slurm_text``: numbers that were wrapped, bare or text as typed structs."""
    typed = {n: fields.wrapped_number(F.col(n)) for n in schemas.WRAPPED_TIMES} | {
        n: fields.wrapped_number(F.col(n), limited=True) for n in schemas.WRAPPED_LIMITS
    }
    named = [typed.get(c, F.col(c)).alias(c) for c in jobs.columns]
    # a one-row generator, so that a number is parsed once and not in every filter and column that uses it
    return jobs.select(F.inline(F.array(F.struct(*named))))


def _slurm_reject() -> Column:
    """Why a Slurm row is unusable, else NULL."""
    times = [fields.unwrap_number(F.col(n)) for n in ("submit_time", "start_time", "end_time")]
    in_range = [F.coalesce(clocks.is_epoch(t), F.lit(True)) for t in times]
    return F.when(F.coalesce("job_id", F.lit("")) == "", F.lit("no job id")).when(
        ~(in_range[0] & in_range[1] & in_range[2]), F.lit("time out of range")
    )


def slurm_rejects(native: DataFrame) -> DataFrame:
    """Slurm rows that no unified job can be made of, whole, each with its ``reject``."""
    return native.withColumn("reject", _slurm_reject()).filter(F.col("reject").isNotNull())


def normalize_slurm(native: DataFrame, as_of: Column) -> DataFrame:
    """Slurm jobs in the unified schema; rows that ``slurm_rejects`` names are left out."""
    start = clocks.epoch_to_ts(fields.unwrap_number(F.col("start_time")))
    end = clocks.epoch_to_ts(fields.unwrap_number(F.col("end_time")))
    zero = F.lit(0).cast("int")
    return native.filter(_slurm_reject().isNull()).select(
        "job_id",
        F.coalesce("name", F.lit("")).alias("name"),
        states.slurm_state(
            F.coalesce(states.first_state(F.col("job_state")), F.lit("UNKNOWN"))
        ).alias("state"),
        clocks.epoch_to_ts(fields.unwrap_number(F.col("submit_time"))).alias("submitted"),
        clocks.runtime_seconds(start, end, as_of).alias("runtime_seconds"),
        fields.slurm_exit_code(F.col("exit_code")).alias("exit_code"),
        F.coalesce("user_name", F.lit("")).alias("user"),
        F.coalesce("partition", F.lit("")).alias("partition"),
        start.alias("started"),
        end.alias("ended"),
        F.try_multiply(fields.unwrap_number(F.col("time_limit")), F.lit(60)).alias("time_limit_seconds"),
        F.struct(
            F.coalesce(fields.unwrap_number(F.col("node_count")).try_cast("int"), zero).alias("nodes"),
            F.coalesce(F.col("tasks"), zero).alias("tasks"),
            F.coalesce(F.col("cpus_per_task"), zero).alias("cpus_per_task"),
            F.coalesce("memory_per_node", F.lit("")).alias("memory"),
        ).alias("resources"),
        fields.split_nodes(F.col("nodes")).alias("allocated_nodes"),
        F.coalesce("current_working_directory", F.lit("")).alias("working_directory"),
        F.coalesce("standard_output", F.lit("")).alias("stdout_path"),
        F.coalesce("standard_error", F.lit("")).alias("stderr_path"),
    )


def split_flux_lines(lines: DataFrame, names: list[str], column: str = "value") -> DataFrame:
    """Positional text rows as typed columns plus ``reject`` saying why a row is unusable.

    A name with a comma shifts the columns, so both fewer and more fields reject.
    """
    parts = lines.select(F.col(column).alias("line"), F.split(column, ",").alias("parts"))
    typed, numbers_ok = [], F.lit(True)
    for i, name in enumerate(names):
        value = F.get("parts", i)
        if name.startswith("t_"):
            missing = value == fv.MISSING_FLUX_FIELD
            value = F.when(value.rlike(fields.NUMBER), value.try_cast("double"))
            value = F.when(clocks.is_epoch(value), value)
            numbers_ok = numbers_ok & (missing | value.isNotNull())
        elif name in ("duration", "runtime"):
            value = clocks.flux_duration_seconds(value)
            numbers_ok = numbers_ok & value.isNotNull()
        elif name in ("nnodes", "ntasks"):
            value = F.when(value.rlike("^[0-9]+$"), value.try_cast("int"))
        typed.append(value.alias(name))
    read = parts.select(
        "line", F.size("parts").alias("n_fields"), numbers_ok.alias("numbers_ok"), *typed
    )
    # a one-row generator: each line is split and read once, and filters on the
    # results are not turned into repeated splits of the line
    wide = read.select(F.inline(F.array(F.struct("*")))).filter(F.col("line") != "")
    return wide.withColumn(
        "reject",
        F.when(F.col("n_fields") < len(names), F.lit("too few fields"))
        .when(F.col("n_fields") > len(names), F.lit("too many fields"))
        .when(F.col("id") == "", F.lit("no job id"))
        .when(~F.col("numbers_ok"), F.lit("unparsable number")),
    )


def flux_rejects(split: DataFrame) -> DataFrame:
    return split.filter(F.col("reject").isNotNull()).select("line", "n_fields", "reject")


def normalize_flux(split: DataFrame) -> DataFrame:
    """Usable Flux rows in the unified schema.

    Works on the long and the short form; what the short form lacks is NULL.
    """
    long_form = "result" in split.columns

    def time(name: str) -> Column:
        if name not in split.columns:
            return F.lit(None).cast("timestamp")
        # whole seconds, cut toward zero like the integer part of the epoch text
        return F.timestamp_seconds(F.col(name).cast("bigint"))

    def count(name: str) -> Column:
        return F.coalesce(name, F.lit(0))

    result = F.col("result") if long_form else None
    common = [
        F.col("id").alias("job_id"),
        fields.or_default(F.col("name"), fv.UNNAMED_JOB).alias("name"),
        states.flux_state(F.col("state"), result).alias("state"),
        time("t_submit").alias("submitted"),
        F.col("runtime").alias("runtime_seconds"),
    ]
    usable = split.filter(F.col("reject").isNull())
    if not long_form:
        return usable.select(*common, F.lit(None).cast("int").alias("exit_code"))
    return usable.select(
        *common,
        fields.flux_exit_code(F.col("result")).alias("exit_code"),
        F.lit(fv.FLUX_USER).alias("user"),
        F.lit(fv.DEFAULT_PARTITION).alias("partition"),
        time("t_run").alias("started"),
        time("t_inactive").alias("ended"),
        F.col("duration").alias("time_limit_seconds"),
        F.struct(
            count("nnodes").alias("nodes"),
            count("ntasks").alias("tasks"),
            F.lit(1).alias("cpus_per_task"),
            F.lit(fv.FLUX_MEMORY).alias("memory"),
        ).alias("resources"),
        F.array().cast("array<string>").alias("allocated_nodes"),
        F.lit(fv.FLUX_WORKDIR).alias("working_directory"),
        F.lit("").alias("stdout_path"),
        F.lit("").alias("stderr_path"),
    )


def union_jobs(*tables: DataFrame) -> DataFrame:
    """One job table over several backends; columns a table lacks are NULL."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def concise(jobs: DataFrame) -> DataFrame:
    """Six columns, in output form."""
    return jobs.select(
        "job_id",
        "name",
        "state",
        clocks.iso_utc(F.col("submitted")).alias("submitted"),
        clocks.to_clock(F.col("runtime_seconds")).alias("runtime"),
        "exit_code",
    )


def detailed(jobs: DataFrame) -> DataFrame:
    """All sixteen columns, in output form."""
    return jobs.select(
        "job_id",
        "name",
        "state",
        clocks.iso_utc(F.col("submitted")).alias("submitted"),
        clocks.to_clock(F.col("runtime_seconds")).alias("runtime"),
        "exit_code",
        "user",
        "partition",
        clocks.iso_utc(F.col("started")).alias("started"),
        clocks.iso_utc(F.col("ended")).alias("ended"),
        clocks.to_clock(F.col("time_limit_seconds")).alias("time_limit"),
        "resources",
        "allocated_nodes",
        "working_directory",
        "stdout_path",
        "stderr_path",
    )


def job_summary(native: DataFrame) -> DataFrame:
    """Seventeen-column summary of Slurm jobs with fallbacks for missing fields."""
    def time(name: str) -> Column:
        number = fields.unwrap_number(F.col(name))
        return F.when(clocks.is_epoch(number), number)

    seconds = {n: time(n) for n in ("submit_time", "start_time", "end_time")}
    iso = {n: clocks.iso_utc(clocks.epoch_to_ts(s)) for n, s in seconds.items()}
    started, ended = (F.nullif(seconds[n], F.lit(0)) for n in ("start_time", "end_time"))
    node_count = F.nullif(fields.unwrap_number(F.col("node_count")), F.lit(0))

    def first_set(a: str, b: str) -> Column:
        return F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b))

    return native.select(
        "job_id",
        "name",
        F.col("user_name").alias("user"),
        states.joined_state(F.col("job_state")).alias("state"),
        "partition",
        F.coalesce(node_count.cast("string"), F.col("nodes")).alias("nodes"),
        F.col("tasks").alias("ntasks"),
        "cpus",
        first_set("memory_per_node", "memory_per_tres").alias("memory"),
        iso["submit_time"].alias("submit_time"),
        iso["start_time"].alias("start_time"),
        iso["end_time"].alias("end_time"),
        F.when(
            started.isNotNull() & ended.isNotNull(),
            F.greatest(F.lit(0).cast("bigint"), ended - started),
        ).alias("runtime_seconds"),
        first_set("stdout_expanded", "standard_output").alias("stdout"),
        first_set("stderr_expanded", "standard_error").alias("stderr"),
        F.col("nodes").alias("node_list"),
        fields.slurm_exit_code(F.col("exit_code")).alias("exit_code"),
    )


def status_text(summary: DataFrame) -> DataFrame:
    """One line per job; parts without a value are left out."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("None"))

    def part(label: str, name: str) -> Column:
        text = F.col(name).cast("string")
        return F.when(~text.isin("", "0"), F.concat(F.lit(label), text))

    return summary.select(
        "job_id",
        F.concat_ws(
            ", ",
            F.concat(F.lit("Job "), shown("job_id"), F.lit(" ("), shown("name"), F.lit(")")),
            F.concat(F.lit("user="), shown("user")),
            F.concat(F.lit("state="), shown("state")),
            part("partition=", "partition"),
            part("nodes=", "nodes"),
            part("tasks=", "ntasks"),
            F.concat(F.lit("runtime="), clocks.duration_human(F.col("runtime_seconds"))),
        ).alias("status_text"),
    )


def recent_projection(jobs: DataFrame) -> DataFrame:
    return jobs.select(
        "job_id", "name", "state", clocks.to_clock(F.col("runtime_seconds")).alias("runtime")
    )


def cluster_types(clusters: DataFrame) -> DataFrame:
    return clusters.select("name", F.coalesce("type", F.lit("unknown")).alias("type"))


def redacted_clusters(clusters: DataFrame) -> DataFrame:
    return clusters.withColumn("auth", fields.redact(F.col("auth")))
