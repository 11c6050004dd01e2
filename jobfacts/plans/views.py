"""Job-shaped tables derived from the given parquet tables by plain arithmetic.

No clock and no random numbers, so the SQL twins can repeat every derivation.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobfacts.fixed_values import SWEEP_PARAMETERS
from jobfacts.functions import clocks, fields, states
from jobfacts.operators import normalize
from jobfacts.schemas import FLUX_LONG_FIELDS, FLUX_SHORT_FIELDS, GIVEN



def plan_once(build):
    """The lazy plan of a derived table, built once per session and folder.

    Plans are held by the session itself and end with it; no data is kept. A folder whose
    files are replaced needs a new session.
    """

    @wraps(build)
    def once(spark: SparkSession, *args: str) -> DataFrame:
        plans = spark.__dict__.setdefault("jobfacts_plans", {})
        key = (build.__name__, *args)
        if key not in plans:
            plans[key] = build(spark, *args)
        return plans[key]

    return once


AS_OF = 978_307_200  # 2001-01-01T00:00:00Z, the "now" of running jobs

SLURM_ENDED = [
    "COMPLETED", "COMPLETED", "COMPLETED", "FAILED", "CANCELLED", "TIMEOUT", "NODE_FAIL", "PREEMPTED",
]
SLURM_STARTED = [
    "RUNNING", "RUNNING", "COMPLETING", "RUNNING", "SUSPENDED", "RUNNING", "RUNNING", "COMPLETING",
]
SLURM_QUEUED = [
    "PENDING", "CONFIGURING", "PENDING", "PENDING", "PENDING", "CONFIGURING", "PENDING", "PENDING",
]
FLUX_ENDED = [
    "INACTIVE", "INACTIVE", "INACTIVE", "INACTIVE", "INACTIVE", "CANCELED", "TIMEOUT", "INACTIVE",
]
FLUX_STARTED = ["RUN", "RUN", "RUN", "RUN", "RUN", "RUN", "RUN", "CLEANUP"]
FLUX_QUEUED = ["DEPEND", "SCHED", "DEPEND", "SCHED", "DEPEND", "SCHED", "DEPEND", "SCHED"]
FLUX_RESULTS = [
    "COMPLETED", "COMPLETED", "FAILED", "CANCELED", "TIMEOUT", "CANCELED", "TIMEOUT", "COMPLETED",
]
TIME_LIMITS = ["5m", "1h", "30s", "2:00:00", "45:30", "30", "1-02:30:00", "1.5h", "0000000000000007m"]
MEMORY = ["4GB", "16GB", "512M", "1T", "2048MB", "8G", "32gb", "", "00000000004GB", "12345678901234567890T"]
FLUX_DURATIONS = ["1.5h", "90m", "30s", "2d", "42", "-", "1.2.3s", "0.5m"]
PARTITIONS = ["urgent", "high", "medium", "not_specified", "low"]

NODE_STATES = ["IDLE", "ALLOCATED", "MIXED", "DOWN"]
NODE_MEMORY = ["16GB", "32GB", "64GB", "128GB"]
PARTITION_LIMITS = ["24:00:00", "12:00:00", "01:00:00", "2:30:00", "1-00:00:00"]

REQUEST_NODES = [1, 0, 4, 1_000_000, None, 2, 16, -1]
REQUEST_TASKS = [1, 0, None, 4]
REQUEST_CPUS = [1, 2, 0, None, 8]
REQUEST_MEMORY = ["32GB", "invalid", "512M", None, "1T", "  ", "9999TB", "9999999999GB", "12345678901234567890M"]
REQUEST_LIMITS = ["1h", "30m", "invalid", None, "1:30", "2:30:00", "999:00:00", "1.5h", " ", " 45M ", "9999999999999m", "12345678901234567890"]
REQUEST_PARTITIONS = ["urgent", "nope", "low", None, " high ", "medium", "debug"]

ARRAY_SPECS = ["1-10", "1-100:2", "1-50", "5", "1,3,5", "1-10:0", "a-b", "3-7", "10-1", None, "1000000000000000001-1000000000000000004:2", "1-99999999999999999999"]
EVENT_STATES = {
    "view": "PENDING", "click": "RUNNING", "purchase": "COMPLETED",
    "error": "FAILED", "signup": "CANCELLED",
}
COMMENT_IDS = 1_000_000_000  # added to the ids of requests without a text
TICK = 600_000_000  # microseconds
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@plan_once
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(GIVEN[name]).parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list, index: str) -> Column:
    """The list's entry at a 0-based index (an SQL expression) that wraps around."""
    listed = ", ".join("NULL" if v is None else repr(v) for v in values)
    return F.expr(f"get(array({listed}), cast(pmod({index}, {len(values)}) as int))")


# ----------------------------------------------------------------------- jobs
@plan_once
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster registry: one per region, Slurm and Flux in turn."""
    even = F.col("r_regionkey") % 2 == 0
    return table(spark, sf_dir, "region").select(
        F.lower("r_name").alias("name"),
        F.when(even, F.lit("slurm")).otherwise(F.lit("flux")).alias("type"),
        F.col("r_regionkey").cast("bigint").alias("cluster_key"),
    )


def cluster_auth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry with a user and a token per cluster."""
    auth = F.create_map(
        F.lit("user"), F.col("name"), F.lit("jwt_token"), F.concat(F.lit("secret-"), "name")
    )
    return clusters(spark, sf_dir).withColumn("auth", auth)


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured use per job: lines as nodes, peak memory and CPU seconds."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("native_id"))
        .agg(
            F.count(F.lit(1)).alias("line_count"),
            (F.floor(F.max("l_extendedprice")).cast("bigint") * (1 << 20)).alias("memory_used_bytes"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"),
        )
    )


@plan_once
def jobs_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of both schedulers with native states, epochs and texts."""
    key = F.col("o_orderkey")
    phase = "o_orderkey div 40"
    submit = F.col("submit_epoch")
    ended, queued = F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "P"
    start = F.when(~queued, submit + key % 7_200 + 1)
    end = F.when(ended, F.col("start_epoch") + F.floor("o_totalprice").cast("bigint") % 90_000)
    slurm = F.col("type") == "slurm"

    def state(of_ended: list, of_queued: list, of_started: list) -> Column:
        return (
            F.when(ended, pick(of_ended, phase))
            .when(queued, pick(of_queued, phase))
            .otherwise(pick(of_started, phase))
        )

    orders = (
        table(spark, sf_dir, "orders")
        .withColumn("cluster_key", F.col("o_custkey") % 5)
        .withColumn("submit_epoch", clocks.ntz_seconds(F.col("o_orderdate")) + key % 86_400)
        .withColumn("start_epoch", start)
    )
    nodes = F.greatest(F.lit(1), F.coalesce("line_count", F.lit(0))).cast("int")
    return (
        orders.join(clusters(spark, sf_dir), "cluster_key")
        .withColumn("native_id", key)
        .join(_usage(spark, sf_dir), "native_id", "left")
        .select(
            "native_id",
            F.col("name").alias("cluster"),
            F.col("type").alias("backend"),
            F.when(key % 97 == 0, F.lit(""))
            .otherwise(F.concat(F.lit("app-"), (key % 40).cast("string")))
            .alias("job_name"),
            F.concat(F.lit("user-"), F.col("o_custkey").cast("string")).alias("user"),
            F.lower(F.regexp_replace(F.substring("o_orderpriority", 3, 20), " ", "_")).alias("partition"),
            F.when(slurm, state(SLURM_ENDED, SLURM_QUEUED, SLURM_STARTED))
            .otherwise(state(FLUX_ENDED, FLUX_QUEUED, FLUX_STARTED))
            .alias("native_state"),
            F.when(~slurm & ended, pick(FLUX_RESULTS, phase)).alias("result"),
            "submit_epoch",
            "start_epoch",
            end.alias("end_epoch"),
            pick(TIME_LIMITS, "o_orderkey").alias("time_limit"),
            pick(FLUX_DURATIONS, "o_orderkey").alias("flux_duration"),
            nodes.alias("nodes"),
            (nodes * (1 + key % 4)).cast("int").alias("tasks"),
            (1 + key % 3).cast("int").alias("cpus_per_task"),
            pick(MEMORY, "o_orderkey").alias("memory"),
            "memory_used_bytes",
            F.when(key % 3 != 0, F.col("quantity") * 60).alias("cpu_seconds"),
        )
    )


@plan_once
def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unified job table with cluster and backend."""
    return unified_jobs(jobs_native(spark, sf_dir))


def unified_jobs(native: DataFrame) -> DataFrame:
    start = F.timestamp_seconds("start_epoch")
    end = F.timestamp_seconds("end_epoch")
    state = states.unified_state(F.col("backend"), F.col("native_state"), F.col("result"))
    exit_code = F.when(F.col("backend") == "flux", fields.flux_exit_code(F.col("result"))).otherwise(
        F.when(F.col("native_state") == "COMPLETED", F.lit(0)).when(
            F.col("native_state") == "FAILED", F.lit(1)
        )
    )
    job_id = fields.job_id_for(F.col("backend"), F.col("native_id"))
    return native.select(
        "native_id",
        "cluster",
        "backend",
        job_id.alias("job_id"),
        fields.or_default(F.col("job_name"), "unnamed").alias("name"),
        state.alias("state"),
        F.timestamp_seconds("submit_epoch").alias("submitted"),
        clocks.runtime_seconds(start, end, F.timestamp_seconds(F.lit(AS_OF))).alias("runtime_seconds"),
        exit_code.alias("exit_code"),
        "user",
        fields.or_default(F.col("partition"), "default").alias("partition"),
        start.alias("started"),
        end.alias("ended"),
        (clocks.time_limit_minutes(F.col("time_limit")) * 60).alias("time_limit_seconds"),
        F.struct("nodes", "tasks", "cpus_per_task", "memory").alias("resources"),
        F.when(~queued_state(), fields.node_names(F.col("nodes")))
        .otherwise(F.array().cast("array<string>"))
        .alias("allocated_nodes"),
        F.lit("/tmp").alias("working_directory"),
        F.concat(F.lit("/tmp/job-"), job_id, F.lit(".out")).alias("stdout_path"),
        F.concat(F.lit("/tmp/job-"), job_id, F.lit(".err")).alias("stderr_path"),
        "memory_used_bytes",
        "cpu_seconds",
    )


def queued_state() -> Column:
    return F.col("start_epoch").isNull()


@plan_once
def slurm_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Slurm jobs in the scheduler's own wrapped shape, both JSON shapes of the state in turn."""

    def wrapped(value: Column) -> Column:
        return F.struct(value.isNotNull().alias("set"), F.coalesce(value, F.lit(0)).alias("number"))

    def limited(value: Column) -> Column:
        return F.struct(
            value.isNotNull().alias("set"),
            F.coalesce(value, F.lit(0)).cast("bigint").alias("number"),
            F.lit(False).alias("infinite"),
        )

    native = jobs_native(spark, sf_dir).filter(F.col("backend") == "slurm")
    key, state = F.col("native_id"), F.col("native_state")
    code = F.when(state == "COMPLETED", F.lit("0")).when(state == "FAILED", F.lit("1")).otherwise(F.lit('"PENDING"'))
    newer = F.concat(F.lit('{"set":true,"number":'), code, F.lit("}"))
    has_code = state.isin("COMPLETED", "FAILED")
    code = F.when((key % 3 == 0) & has_code, newer).otherwise(code)
    names = F.when(
        F.col("start_epoch").isNotNull(), F.array_join(fields.node_names(F.col("nodes")), ",")
    ).otherwise(F.lit(""))

    def path(name: str, ending: str) -> Column:
        return F.concat(F.lit(f"/tmp/{name}-"), key.cast("string"), F.lit(ending))

    return native.select(
        F.when(key % 101 != 0, key.cast("string")).alias("job_id"),
        F.col("job_name").alias("name"),
        (key % 1000).alias("user_id"),
        F.col("user").alias("user_name"),
        F.lit("default").alias("account"),
        "partition",
        F.when(key % 2 == 0, F.concat(F.lit('["'), state, F.lit('"]'))).otherwise(state).alias("job_state"),
        F.concat(F.lit('{"status":["x"],"return_code":'), code, F.lit("}")).alias("exit_code"),
        wrapped(F.when(key % 107 == 0, 99_999_999_999_999).otherwise(F.col("submit_epoch"))).alias("submit_time"),
        wrapped(F.col("start_epoch")).alias("start_time"),
        wrapped(F.col("end_epoch")).alias("end_time"),
        limited(clocks.time_limit_minutes(F.col("time_limit"))).alias("time_limit"),
        limited(F.col("nodes")).alias("node_count"),
        names.alias("nodes"),
        "tasks",
        (F.col("tasks") * F.col("cpus_per_task")).alias("cpus"),
        "cpus_per_task",
        F.when(key % 4 != 0, F.col("memory")).alias("memory_per_node"),
        F.concat(F.lit("mem="), F.col("memory")).alias("memory_per_tres"),
        F.lit("/home/work").alias("current_working_directory"),
        path("slurm", ".out").alias("standard_output"),
        path("slurm", ".err").alias("standard_error"),
        F.when(key % 5 == 0, path("expanded", ".out")).alias("stdout_expanded"),
        F.lit(None).cast("string").alias("stderr_expanded"),
    )


@plan_once
def flux_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Flux jobs as comma-separated text rows, some of them broken."""
    native = jobs_native(spark, sf_dir).filter(F.col("backend") == "flux")
    key = F.col("native_id")

    def or_dash(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit("-"))

    name = F.when(key % 89 == 0, F.lit("with,comma")).otherwise(F.col("job_name"))
    submit = F.when(key % 166 == 0, F.lit("1e300")).when(key % 83 == 0, F.lit("soon")).otherwise(
        F.concat(F.col("submit_epoch").cast("string"), F.lit(".25"))
    )
    runtime = F.when(F.col("end_epoch").isNotNull(), F.concat((F.col("end_epoch") - F.col("start_epoch")).cast("string"), F.lit("s")))
    values = {
        "id": fields.job_id_for(F.col("backend"), key),
        "name": name,
        "state": F.col("native_state"),
        "t_submit": submit,
        "t_run": or_dash(F.col("start_epoch")),
        "t_inactive": or_dash(F.col("end_epoch")),
        "result": or_dash(F.col("result")),
        "nnodes": F.when(key % 7 == 0, F.lit("?")).otherwise(F.col("nodes").cast("string")),
        "ntasks": F.col("tasks").cast("string"),
        "duration": F.col("flux_duration"),
        "runtime": or_dash(runtime),
    }
    whole = F.concat_ws(",", *[values[n] for n in FLUX_LONG_FIELDS])
    cut = F.concat_ws(",", *[values[n] for n in FLUX_LONG_FIELDS[:4]])
    return native.select(F.when(key % 103 == 0, cut).otherwise(whole).alias("value"))


@plan_once
def flux_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.split_flux_lines(flux_lines(spark, sf_dir), FLUX_LONG_FIELDS)


def flux_short_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Flux jobs as five-field rows."""
    native = jobs_native(spark, sf_dir).filter(F.col("backend") == "flux")
    ran = F.col("end_epoch") - F.col("start_epoch")
    line = F.concat_ws(
        ",",
        fields.job_id_for(F.col("backend"), F.col("native_id")),
        "job_name",
        "native_state",
        F.col("submit_epoch").cast("string"),
        F.coalesce(F.concat(ran.cast("string"), F.lit("s")), F.lit("-")),
    )
    return native.select(line.alias("value"))


def flux_short_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.split_flux_lines(flux_short_lines(spark, sf_dir), FLUX_SHORT_FIELDS)


# ------------------------------------------------------------- nodes, partitions
def _node_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").withColumn(
        "cluster_key", (F.col("s_nationkey") % 5).cast("bigint")
    ).join(clusters(spark, sf_dir), "cluster_key")


@plan_once
def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    first, second = pick(PARTITIONS, "s_suppkey"), pick(PARTITIONS, "s_suppkey + 2")
    return _node_rows(spark, sf_dir).select(
        F.col("name").alias("cluster"),
        F.concat(F.lit("node-"), key.cast("string")).alias("name"),
        pick(NODE_STATES, "s_suppkey").alias("state"),
        (4 + key % 5).cast("int").alias("cpus"),
        pick(NODE_MEMORY, "s_suppkey div 4").alias("memory"),
        F.when(key % 3 == 0, F.array(first)).otherwise(F.array(first, second)).alias("partitions"),
    )


@plan_once
def partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partition per cluster and first partition of its nodes."""
    slot = F.col("s_suppkey") % 5
    found = (
        _node_rows(spark, sf_dir)
        .groupBy(F.col("name").alias("cluster"), "cluster_key", slot.alias("slot"))
        .agg(F.count(F.lit(1)).cast("int").alias("nodes"))
    )
    down = (F.col("cluster_key") + F.col("slot")) % 4 == 3
    return found.select(
        "cluster",
        pick(PARTITIONS, "slot").alias("name"),
        F.when(down, F.lit("DOWN")).otherwise(F.lit("UP")).alias("state"),
        "nodes",
        pick(PARTITION_LIMITS, "slot").alias("max_time_limit"),
        F.concat((2 + F.col("slot")).cast("string"), F.lit("GB")).alias("default_memory_per_cpu"),
    )


# ------------------------------------------------------------- scripts, requests
def _script(key: Column) -> Column:
    """A script around each document: shebang, commands by residue, then the whole text, or a comment without one."""

    def line(divisor: int, text: Column | str) -> Column:
        text = F.lit(text) if isinstance(text, str) else text
        return F.when(key % divisor == 0, text).otherwise(F.lit(""))

    return F.concat(
        line(17, "\n\t "),
        F.when(key % 5 == 0, F.lit("")).otherwise(F.lit("#!/bin/bash\n")),
        line(7, F.concat(F.lit("mpirun -n "), (key % 33).cast("string"), F.lit(" ./solver\n"))),
        line(11, "rsync -a in out\n"),
        line(13, "Module load gcc/11.2.0\n"),
        line(19, "# Process 64GB dataset\n"),
        F.coalesce("text", F.lit("\n  # nothing here\n\t\n")),
    )


@plan_once
def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job requests with whole scripts; some name a cluster that does not exist.

    Beside one request per document there are some whose script is only a comment.
    """
    key = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bare = docs.filter(key % 23 == 0).select((key + COMMENT_IDS).alias("doc_id"), F.lit(None).cast("string").alias("text"))
    docs = docs.union(bare)
    named = clusters(spark, sf_dir).select(F.col("name").alias("cluster"), "cluster_key")
    return (
        docs.withColumn("cluster_key", key % 6)
        .join(named, "cluster_key", "left")
        .select(
            key.alias("request_id"),
            F.coalesce("cluster", F.lit("nowhere")).alias("cluster"),
            _script(key).alias("script"),
            F.concat(F.lit("app-"), (key % 40).cast("string")).alias("job_name"),
            pick(REQUEST_NODES, "doc_id").alias("nodes"),
            pick(REQUEST_TASKS, "doc_id").alias("tasks_per_node"),
            pick(REQUEST_CPUS, "doc_id").alias("cpus_per_task"),
            pick(REQUEST_MEMORY, "doc_id").alias("memory"),
            pick(REQUEST_LIMITS, "doc_id").alias("time_limit"),
            pick(REQUEST_PARTITIONS, "doc_id").alias("partition"),
        )
    )


# ------------------------------------------------------------ status and output
def event_state() -> Column:
    return states.lookup(EVENT_STATES, F.col("event_type"))


def event_status(events: DataFrame) -> DataFrame:
    """Events as job statuses: a job is a user's day, times are cut so that some are equal."""
    day = F.date_format("ts", "yyyyMMdd")
    return events.select(
        F.concat(F.lit("job-"), F.col("user_id").cast("string"), F.lit("-"), day).alias("job_id"),
        event_state().alias("state"),
        F.timestamp_micros(F.call_function("div", clocks.ntz_micros(F.col("ts")), F.lit(TICK)) * TICK).alias("ts"),
    )


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_status(table(spark, sf_dir, "events"))


def event_minicluster_status(events: DataFrame) -> DataFrame:
    """Events as MiniCluster statuses: a MiniCluster is a user's."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    phase = F.when(kind == "purchase", F.lit("Running")).when(kind == "view", F.lit("Pending"))
    truth = F.when(k > 60, F.lit("True")).otherwise(F.lit("False"))
    condition = F.struct(
        F.when(kind == "error", F.lit("JobMiniClusterReady")).otherwise(F.lit("Other")).alias("type"),
        truth.alias("status"),
    )
    unset = F.lit(None).cast("int")
    return events.select(
        F.concat(F.lit("ns-"), (F.col("user_id") % 7).cast("string")).alias("namespace"),
        F.concat(F.lit("mc-"), F.col("user_id").cast("string")).alias("name"),
        F.timestamp_micros(clocks.ntz_micros(F.col("ts"))).alias("ts"),
        F.struct(
            phase.alias("phase"),
            F.when(kind == "signup", k).alias("size"),
            unset.alias("maximumSize"),
            F.lit(0).alias("desiredSize"),
            F.lit(90).alias("specSize"),
            F.array(condition).alias("conditions"),
        ).alias("status"),
    )


def minicluster_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_minicluster_status(table(spark, sf_dir, "events"))


def minicluster_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A MiniCluster spec per part, with some broken in each way."""
    key = F.col("p_partkey")
    image = F.when(key % 13 == 0, F.lit(" ")).when(key % 17 == 0, F.lit("a/../b")).otherwise(F.col("p_type"))
    container = F.struct(
        image.alias("image"),
        F.when(key % 5 != 0, F.col("p_name")).alias("command"),
        (key % 4).cast("int").alias("tasks"),
        (key % 3 == 0).alias("batch"),
    )
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("mc-"), key.cast("string")).alias("name"),
        F.concat(F.lit("ns-"), (key % 7).cast("string")).alias("namespace"),
        F.struct(
            (F.col("p_size") - 2).alias("size"),
            F.when(key % 2 == 0, F.lit(25)).alias("maxSize"),
            (key % 6 - 1).cast("int").alias("tasks"),
            F.array(container).alias("containers"),
        ).alias("spec"),
    )


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which jobs have output, without reading it."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("native_id"))


def output_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as output, line by line: assistant turns are stdout."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("native_id"),
        F.when(F.col("role") == "assistant", F.lit("stdout")).otherwise(F.lit("stderr")).alias("stream"),
        F.col("turn"),
        F.posexplode(F.split("text", "\n")).alias("line_no", "line"),
    )


def cancels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cancel requests, with repeats and ids that do not exist."""
    asked = table(spark, sf_dir, "events").filter(F.col("event_type").isin("signup", "error"))
    return asked.select((F.call_function("div", F.col("event_id"), F.lit(2)) * 3).alias("native_id"))


# -------------------------------------------------------------- batches, readings
@plan_once
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches from parts: array specs by residue, the words of the type as commands."""
    key = F.col("p_partkey")
    spec = pick(ARRAY_SPECS, "p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("batch_id"),
        spec.alias("array_spec"),
        F.when(spec.isNull(), F.split("p_type", " ")).alias("commands"),
        F.when(key % 3 == 0, F.lit(10)).alias("max_concurrent"),
    )


def sweep_parameters(spark: SparkSession) -> DataFrame:
    rows = list(enumerate(SWEEP_PARAMETERS))
    return spark.createDataFrame(rows, "position bigint, parameter string").withColumn(
        "parameter", F.col("parameter").cast("decimal(10,3)")
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor readings from events: some values missing, some rows copied."""
    key = F.col("event_id")
    copies = F.when(key % 100 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return table(spark, sf_dir, "events").select(
        key.alias("reading_id"),
        F.col("user_id").alias("sensor_id"),
        "ts",
        F.when(key % 79 != 0, F.col("value")).alias("value"),
        F.col("event_type").alias("kind"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def unique_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings without the copies."""
    key = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        key.alias("reading_id"),
        F.col("user_id").alias("sensor_id"),
        "ts",
        F.when(key % 79 != 0, F.col("value")).alias("value"),
        F.col("event_type").alias("kind"),
    )
