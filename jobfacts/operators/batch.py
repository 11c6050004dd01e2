"""Job arrays, command lists and parameter sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_SPEC = r"^\s*(\d+)\s*-\s*(\d+)\s*(?::\s*(\d+)\s*)?(?:-.*)?$"
BLOCK = 10_000  # the longest list made from one row
BAD_SPEC = "invalid array spec"


def _given(column: Column) -> Column:
    return F.coalesce(column, F.lit("")) != ""


def has_one_source(batches: DataFrame) -> DataFrame:
    """Add ``reason``: why a batch is refused, NULL when exactly one source is given."""
    spec = _given(F.col("array_spec"))
    commands = F.coalesce(F.size("commands"), F.lit(0)) > 0
    return batches.withColumn(
        "reason",
        F.when(spec & commands, F.lit("both array_spec and commands"))
        .when(~spec & ~commands, F.lit("neither array_spec nor commands")),
    )


def _read_specs(batches: DataFrame) -> DataFrame:
    """Array batches with start, step, number of tasks and whether the spec is bad.

    A spec without a dash gives no tasks and no error; one whose numbers or number of
    tasks do not fit task ids of 64 bits is bad. ``max_concurrent`` cuts
    the list of tasks; zero or missing leaves it whole.
    """
    spec = F.col("array_spec")

    def number(group: int) -> Column:
        return F.regexp_extract(spec, _SPEC, group).try_cast("bigint")

    step_text = F.regexp_extract(spec, _SPEC, 3)
    cap = F.nullif(F.col("max_concurrent").cast("bigint"), F.lit(0))
    span = F.col("__end") - F.col("__start")
    count = F.when(
        (span >= 0) & (F.col("__step") > 0),
        F.try_add(F.call_function("div", span, F.col("__step")), F.lit(1)),
    ).otherwise(F.lit(0))
    fits = F.col("__end").isNotNull() & F.col("__start").isNotNull() & count.isNotNull()
    return (
        batches.filter(_given(spec))
        .withColumn("__start", number(1))
        .withColumn("__end", number(2))
        .withColumn("__step", F.when(step_text == "", F.lit(1)).otherwise(number(3)))
        .withColumn(
            "bad_spec",
            spec.contains("-")
            & ~F.coalesce(spec.rlike(_SPEC) & (F.col("__step") > 0) & fits, F.lit(False)),
        )
        .withColumn(
            "__tasks",
            F.when(F.col("bad_spec"), F.lit(0))
            .when(cap.isNotNull(), F.least(count, F.greatest(cap, F.lit(0))))
            .otherwise(count)
            .cast("bigint"),
        )
    )


def expand_arrays(batches: DataFrame, cap: int | None = None) -> DataFrame:
    """One row per array task: ``batch_id, task_index, task_id``; with ``cap`` no more than that of each batch are made.

    A range is first cut into at most ``BLOCK`` even pieces, each of at least ``BLOCK``
    tasks, which spread over the cluster. A piece is expanded level by level, so that
    no list is longer than ``BLOCK`` however many tasks there are.
    """
    def div(a: Column, b: Column | int) -> Column:
        return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)

    tasks = F.col("__tasks")
    specs = _read_specs(batches).select("batch_id", "__start", "__step", "__tasks")
    if cap is not None:
        specs = specs.withColumn("__tasks", F.least(tasks, F.lit(cap).cast("bigint")))
    rows = (
        specs.filter(tasks > 0)
        .withColumn("__size", F.greatest(F.lit(BLOCK), div(tasks - 1, BLOCK) + 1))
        .withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("bigint"), div(tasks - 1, F.col("__size")))))
        .repartition("batch_id", "__piece")
        .withColumn("__from", F.col("__piece") * F.col("__size"))
        .withColumn("__n", F.least(F.col("__size"), tasks - F.col("__from")))
    )
    for unit in (BLOCK**3, BLOCK**2, BLOCK, 1):  # a piece has at most 10^15 tasks
        part = F.explode(F.sequence(F.lit(0).cast("bigint"), div(F.col("__n") - 1, unit)))
        # A generated method runs through a whole list before it hands rows on, and nested
        # lists would multiply in it. Coalescing to more partitions than there are moves
        # nothing and ends the method, so each holds one list at a time.
        rows = (
            rows.coalesce(1 << 20)
            .select("batch_id", "__start", "__step", "__from", "__n", part.alias("__k"))
            .withColumn("__from", F.col("__from") + F.col("__k") * unit)
            .withColumn("__n", F.least(F.lit(unit), F.col("__n") - F.col("__k") * unit))
        )
    return rows.withColumn("task_index", F.col("__from")).select(
        "batch_id",
        "task_index",
        (F.col("__start") + F.col("task_index") * F.col("__step")).alias("task_id"),
    )


def array_errors(batches: DataFrame) -> DataFrame:
    """One row per array spec that cannot be read."""
    return (
        _read_specs(batches)
        .filter("bad_spec")
        .select(
            "batch_id",
            F.lit(0).alias("index"),
            F.col("array_spec").alias("command"),
            F.lit(BAD_SPEC).alias("error"),
        )
    )


def expand_commands(batches: DataFrame) -> DataFrame:
    """One row per command: ``batch_id, task_index, command``."""
    return (
        batches.filter(~_given(F.col("array_spec")))
        .select("batch_id", F.posexplode("commands").alias("task_index", "command"))
    )


def batch_summary(batches: DataFrame) -> DataFrame:
    """Per batch: type, submitted, failed, success and reason, without expanding anything.

    A batch with both sources or neither is refused: it submits nothing, and reason says why.
    """
    zero = F.lit(0).cast("bigint")
    checked = has_one_source(batches)
    allowed = checked.filter(F.col("reason").isNull())
    arrays = _read_specs(allowed).select(
        "batch_id",
        F.lit("array").alias("batch_type"),
        F.col("__tasks").alias("submitted"),
        F.col("bad_spec").cast("bigint").alias("failed"),
        "reason",
    )
    bulk = allowed.filter(~_given(F.col("array_spec"))).select(
        "batch_id",
        F.lit("bulk").alias("batch_type"),
        F.size("commands").cast("bigint").alias("submitted"),
        zero.alias("failed"),
        "reason",
    )
    refused = checked.filter(F.col("reason").isNotNull()).select(
        "batch_id", F.lit(None).cast("string").alias("batch_type"), zero.alias("submitted"), zero.alias("failed"), "reason"
    )
    return arrays.unionByName(bulk).unionByName(refused).withColumn("success", F.col("submitted") > 0)


def cap_tasks(tasks: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` tasks of each batch, by their index."""
    return tasks.filter(F.col("task_index") < cap)


def sweep(tasks: DataFrame, parameters: DataFrame) -> DataFrame:
    """Give each task its parameter by position and compute its result.

    Task ids start at 1, and 0 also takes the first parameter. A task beyond the
    list has no parameter and fails.
    """
    position = F.greatest(F.col("task_id") - 1, F.lit(0))
    joined = tasks.withColumn("position", position.cast("bigint")).join(
        parameters, "position", "left"
    )
    return joined.select(
        *tasks.columns,
        "parameter",
        (F.col("parameter") * 100 + F.col("task_id")).cast("double").alias("result"),
        F.when(F.col("parameter").isNull(), F.lit("FAILED"))
        .otherwise(F.lit("SUCCESS"))
        .alias("status"),
    )


def sweep_performance(runs: DataFrame) -> DataFrame:
    """Runs per parameter: count, average runtime, share that completed."""
    done = F.count_if(F.col("state") == "COMPLETED")
    return runs.groupBy("parameter").agg(
        F.count(F.lit(1)).alias("runs"),
        (F.sum("runtime_seconds") / F.count(F.lit(1))).alias("avg_runtime_seconds"),
        (done / F.count(F.lit(1))).alias("success_rate"),
    )
