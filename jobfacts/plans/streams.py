"""Registered streaming queries: the events read as a stream of several triggers until they are used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobfacts import schemas
from jobfacts.plans import views
from jobfacts.session import shared_folder
from jobfacts.streaming import changes, timeouts


TRIGGERS, FILES = 4, 2
#: Row groups of at most so many bytes: a file of any size is read by as many tasks as it has.
ROW_GROUP = 8 << 20
#: The user of a last event far in the future, with which every timer runs out.
LAST = -1


def _events(spark: SparkSession, sf_dir: str, days: int = 0) -> DataFrame:
    """The events as they would arrive: `TRIGGERS` stretches of time, `FILES` files each, one stretch a trigger.

    With `days` an event of user `LAST` follows so many days later.
    """
    folder = shared_folder(spark, "event-files")
    events = views.table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(at), F.max(at)).first()
    span = max(1, ((high or 0) - (low or 0)) // TRIGGERS + 1)
    for k in range(TRIGGERS):
        begin = (low or 0) + k * span
        part = events.filter((at >= begin) & (at < begin + span))
        part.repartition(FILES).write.mode("append").option("parquet.block.size", ROW_GROUP).parquet(folder)
    if days:
        later = {"ts": F.max("ts") + F.expr(f"interval {days} days"), "user_id": F.lit(LAST), "event_type": F.lit("view")}
        kinds = {f.name: f.dataType for f in events.schema}
        last = events.agg(*[later.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])
        last.write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schemas.GIVEN["events"])
    return stream.option("maxFilesPerTrigger", FILES).parquet(folder)


def _run(spark: SparkSession, name: str, start) -> str:
    folder = shared_folder(spark, name)
    start(f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return f"{folder}/out"


def _jobs(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("job_id").startswith(f"job-{LAST}-"))


def first_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job's first terminal state, written once."""
    stream = views.event_status(_events(spark, sf_dir, 10))
    out = _run(spark, "terminal", lambda path, ckpt: timeouts.stream_ends(stream, path, ckpt))
    return _jobs(timeouts.read_ends(spark, out))


def first_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readiness of each MiniCluster; those that are never ready time out a year after their first status."""
    return readiness(spark, sf_dir, 365 * 1440).drop("decided")


def readiness(spark: SparkSession, sf_dir: str, minutes: int) -> DataFrame:
    """Readiness of each MiniCluster within `minutes` of its first status, else Timeout."""
    stream = views.event_minicluster_status(_events(spark, sf_dir, minutes // 1440 + 10))
    out = _run(spark, "ready", lambda path, ckpt: timeouts.stream_readiness(stream, path, ckpt, minutes))
    return timeouts.read_readiness(spark, out).filter(F.col("name") != f"mc-{LAST}")


def queue_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = views.event_status(_events(spark, sf_dir)).withColumn(
        "cluster", F.regexp_extract("job_id", r"^job-(\d)", 1)
    )
    out = _run(spark, "queue", lambda path, ckpt: changes.stream_queue_status(stream, path, ckpt))
    return changes.read_queue_status(spark, out)


def outcomes(spark: SparkSession, sf_dir: str, minutes: int = 60) -> DataFrame:
    """Outcomes of all jobs, written once each as their timers run out."""
    stream = views.event_status(_events(spark, sf_dir, 10))
    out = _run(spark, "outcomes", lambda path, ckpt: timeouts.stream_outcomes(stream, path, ckpt, minutes))
    return _jobs(timeouts.read_outcomes(spark, out))
