"""Row filters and request checks. Arguments are checked before any plan is built."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobfacts import fixed_values as fv
from jobfacts.functions import clocks, scripts


# ------------------------------------------------------------ argument checks
def clean_text(value: str | None) -> str | None:
    """Trimmed argument; empty counts as not given."""
    value = (value or "").strip()
    return value or None


def clean_state(value: str | None) -> str | None:
    state = clean_text(value)
    if state is None:
        return None
    state = state.upper()
    if state not in fv.LIST_STATES:
        raise ValueError(f"state must be one of {', '.join(fv.LIST_STATES)}, got {value!r}")
    return state


def check_list_limit(limit: int) -> int:
    if limit < 1:
        raise ValueError(f"limit must be at least 1, got {limit}")
    return limit


def check_accounting_limit(limit: int) -> int:
    if not 1 <= limit <= fv.MAX_ACCOUNTING_LIMIT:
        raise ValueError(f"limit must be 1 to {fv.MAX_ACCOUNTING_LIMIT}, got {limit}")
    return limit


def check_iso(value: str | None) -> str | None:
    """A date or date-time text has at least the ten characters of a date."""
    value = clean_text(value)
    if value is not None and len(value) < 10:
        raise ValueError(f"expected an ISO-8601 time, got {value!r}")
    return value


def iso_instant(value: str) -> Column:
    """Instant of an ISO text; without a zone it is read as UTC. Other texts raise ``ValueError`` here."""
    datetime.fromisoformat(value)
    zoned = value if value.endswith("Z") or "+" in value[10:] or "-" in value[10:] else None
    return F.lit(zoned or (value + "Z" if len(value) > 10 else value + "T00:00:00Z")).cast(
        "timestamp"
    )


# ------------------------------------------------------------------ job filters
def filter_jobs(
    jobs: DataFrame,
    cluster: str | None = None,
    user: str | None = None,
    state: str | None = None,
    job_id: str | None = None,
    start_time: str | None = None,
    end_time: str | None = None,
) -> DataFrame:
    """Jobs that meet every filter given; the time range is on submission, both ends in."""
    user, state, job_id = clean_text(user), clean_state(state), clean_text(job_id)
    start_time, end_time = check_iso(start_time), check_iso(end_time)
    if cluster is not None:
        jobs = jobs.filter(F.col("cluster") == cluster.strip())
    if user is not None:
        jobs = jobs.filter(F.col("user") == user)
    if state is not None:
        jobs = jobs.filter(F.col("state") == state)
    if job_id is not None:
        jobs = jobs.filter(F.col("job_id") == job_id)
    if start_time is not None:
        jobs = jobs.filter(F.col("submitted") >= iso_instant(start_time))
    if end_time is not None:
        jobs = jobs.filter(F.col("submitted") <= iso_instant(end_time))
    return jobs


def is_filtered(user: str | None = None, state: str | None = None) -> bool:
    return clean_text(user) is not None or clean_state(state) is not None


def in_namespaces(table: DataFrame, allowed: str | None, column: str = "namespace") -> DataFrame:
    """Rows of the namespaces in a comma-separated list; an empty list allows all."""
    names = [n.strip() for n in (allowed or "").split(",") if n.strip()]
    return table.filter(F.col(column).isin(names)) if names else table


def terminal_only(status: DataFrame) -> DataFrame:
    return status.filter(F.col("state").isin(fv.TERMINAL_STATES))


def unknown_clusters(table: DataFrame, clusters: DataFrame) -> DataFrame:
    """Rows that name a cluster the registry does not have."""
    names = clusters.select(F.col("name").alias("cluster"))
    return table.join(names, "cluster", "left_anti")


# --------------------------------------------------------------- request checks
def _blank(value: Column) -> Column:
    return value.isNotNull() & scripts.is_blank(value)


def request_reasons() -> dict[str, Column]:
    """Every reason to refuse a job request; each column is never NULL."""
    script = F.coalesce("script", F.lit(""))
    memory, limit = F.col("memory"), F.col("time_limit")
    checks = {
        "empty script": scripts.is_blank(script),
        "script too long": F.length(script) > fv.MAX_SCRIPT_CHARS,
        "no shebang": ~scripts.is_blank(script) & ~scripts.has_shebang(script),
        "nodes below 1": F.col("nodes") < 1,
        "tasks per node below 1": F.col("tasks_per_node") < 1,
        "cpus per task below 1": F.col("cpus_per_task") < 1,
        "empty memory": _blank(memory),
        "memory format": ~_blank(memory)
        & ~clocks.strip(memory).rlike("(?i)" + fv.MEMORY_FORMAT),
        "empty time limit": _blank(limit),
        "time limit format": ~_blank(limit)
        & ~scripts.matches_any(clocks.strip(limit), fv.REQUEST_TIME_FORMATS),
    }
    return {name: F.coalesce(check, F.lit(False)) for name, check in checks.items()}


def check_requests(requests: DataFrame) -> DataFrame:
    """Requests with ``reasons`` (why refused) and ``success``; the script is not carried on."""
    reasons = F.filter(
        F.array(*[F.when(bad, F.lit(name)) for name, bad in request_reasons().items()]),
        lambda r: r.isNotNull(),
    )
    kept = [c for c in requests.columns if c != "script"]
    return requests.select(*kept, reasons.alias("reasons")).withColumn(
        "success", F.size("reasons") == 0
    )


def check_miniclusters(specs: DataFrame) -> DataFrame:
    """MiniCluster specs (name, namespace, spec) with ``reasons`` and ``valid``."""
    spec = F.col("spec")
    containers = F.coalesce(spec["containers"], F.array().cast(specs.schema["spec"].dataType["containers"].dataType))
    bad_image = F.exists(
        containers,
        lambda c: c["image"].isNull() | scripts.is_blank(c["image"]) | c["image"].contains(".."),
    )
    bad_batch = F.exists(
        containers,
        lambda c: F.coalesce(c["batch"], F.lit(False))
        & (
            scripts.is_blank(F.coalesce(c["command"], F.lit("")))
            | (F.coalesce(c["tasks"], spec["tasks"], F.lit(0)) <= 0)
        ),
    )
    checks = {
        "size below 1": F.coalesce(spec["size"], F.lit(0)) < 1,
        "max size below 1": spec["maxSize"] < 1,
        "max size below size": spec["maxSize"] < spec["size"],
        "negative tasks": spec["tasks"] < 0,
        "image": bad_image,
        "batch needs command and tasks": bad_batch,
    }
    reasons = F.filter(
        F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]),
        lambda r: r.isNotNull(),
    )
    return specs.select("name", "namespace", reasons.alias("reasons")).withColumn(
        "valid", F.size("reasons") == 0
    )
