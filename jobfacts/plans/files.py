"""Registered round trips: derived tables written in their native file formats and read back.

Each query writes below the shared folder and reads with the package's own readers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobfacts.operators import filters, normalize, prep, resources, scripts
from jobfacts.plans import views
from jobfacts.session import shared_folder, shipped
from jobfacts.sources import readers, sinks, store


#: About as many rows as one written answer holds at most.
PER_ANSWER = 5000


def _page(rows: DataFrame, group: str) -> DataFrame:
    """`rows` with page: at most PER_ANSWER rows of a group and a task have the same, and nothing is counted before.

    A row's place in its task is known as it is read, so a page is a stretch of one task's rows.
    """
    place = F.monotonically_increasing_id()
    return rows.withColumn("page", F.struct(group, F.call_function("div", place, F.lit(PER_ANSWER)).alias("stretch")))


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of an answer that holds all jobs of a task, a job a row."""

    def line(text: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"value": [text]})

    yield line('{"meta":{"note":"a \\"}]{ in a text"},"errors":[{"jobs":[{}]}],"jobs":[')
    comma = ""
    for batch in batches:
        if batch.num_rows:
            jobs = pc.binary_join_element_wise(",", batch.column("value"), "")
            if not comma:
                first = batch.column("value").slice(0, 1)
                jobs = pa.concat_arrays([first.cast(jobs.type), jobs.slice(1)])
                comma = ","
            yield pa.RecordBatch.from_arrays([jobs], names=["value"])
    yield line('],"warnings":[{"n":1}]}')


def slurm_jobs(spark: SparkSession, sf_dir: str, layout: str) -> DataFrame:
    """The Slurm dump as JSON files: one job per line, or answers of one partition name each, in pages.

    Every third number is written bare and every fifth as text, as older dumps have them.
    """
    shipped(spark)
    folder = shared_folder(spark, f"slurm-{layout}")
    dump = views.slurm_dump(spark, sf_dir)
    key = F.coalesce(F.col("job_id").try_cast("bigint"), F.lit(1))
    bare = F.col("submit_time.number").cast("string")
    written = dump.withColumn(
        "submit_time",
        F.when(key % 3 == 0, bare)
        .when(key % 5 == 0, F.concat(F.lit('"'), bare, F.lit('"')))
        .otherwise(F.to_json("submit_time")),
    )
    rest = [c for c in dump.columns if c != "submit_time"]
    body = F.to_json(F.struct(*rest))
    line = F.concat(F.lit('{"submit_time":'), "submit_time", F.lit(","), F.substring(body, 2, 1 << 30))
    lines = written.select("partition", line.alias("value"))
    if layout == "lines":
        lines.select("value").write.text(folder)
    elif layout == "ranges":  # an answer of all its jobs from each task, with lists and braces that are no jobs
        lines.select("value").mapInArrow(_answer, "value string").write.text(folder)
    else:
        answers = _page(lines, "partition").groupBy("page").agg(F.concat_ws(",", F.collect_list("value")).alias("jobs"))
        answer = F.concat(F.lit('{"jobs":['), "jobs", F.lit("]}"))
        answers.select(answer.alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return readers.read_slurm_jobs(spark, folder, layout)


def flux_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "flux")
    views.flux_lines(spark, sf_dir).write.text(folder)
    return readers.read_flux_jobs(spark, folder)


def flux_short_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "flux-short")
    views.flux_short_lines(spark, sf_dir).write.text(folder)
    return readers.read_flux_jobs(spark, folder, 5)


def cluster_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "clusters")
    views.cluster_auth(spark, sf_dir).drop("cluster_key").write.json(folder)
    return normalize.cluster_types(readers.read_clusters(spark, folder))


def node_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "nodes")
    views.nodes(spark, sf_dir).write.json(folder)
    return resources.node_summary(readers.read_nodes(spark, folder, "json"))


def partition_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "partitions")
    views.partitions(spark, sf_dir).write.parquet(folder)
    return resources.partition_names(readers.read_partitions(spark, folder))


def minicluster_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List answers of one namespace each, in pages, checked like the specs themselves."""
    folder = shared_folder(spark, "miniclusters")
    specs = views.minicluster_specs(spark, sf_dir)
    item = F.struct(F.struct("name", "namespace").alias("metadata"), "spec")
    answers = _page(specs, "namespace").groupBy("page").agg(F.collect_list(item).alias("items")).select("items")
    answers.write.option("maxRecordsPerFile", 1).json(folder)
    return filters.check_miniclusters(readers.read_miniclusters(spark, folder))


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command list per brand, with a comment and a blank line in each: a file of as many lines as there are parts."""
    folder = shared_folder(spark, "commands")
    parts = views.table(spark, sf_dir, "part")
    named = parts.select("p_brand", F.lit(2).alias("place"), F.col("p_name").alias("value"))
    heads = parts.select("p_brand").distinct()
    for place, line in enumerate(("# parts", "")):
        named = named.unionByName(heads.select("p_brand", F.lit(place).alias("place"), F.lit(line).alias("value")))
    dealt = named.repartition("p_brand").sortWithinPartitions("p_brand", "place", "value")
    dealt.select("p_brand", "value").write.partitionBy("p_brand").text(folder)
    found = readers.read_command_lines(spark, folder)
    return found.select(F.col("task_index").cast("int").alias("task_index"), "command")


def _output_files(spark: SparkSession, sf_dir: str) -> str:
    """The output of all jobs as files."""
    folder = shared_folder(spark, "output")
    lines = views.output_lines(spark, sf_dir).withColumnRenamed("native_id", "job_id")
    sinks.write_job_output(lines, folder, ["turn", "line_no", "line"])
    return folder


def output_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = readers.read_job_output(spark, f"{_output_files(spark, sf_dir)}/*.*", "lines")
    return lines.select(F.col("job_id").cast("bigint").alias("native_id"), "stream", "line_no", "line")


def output_tails(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    tails = readers.read_output_tails(spark, _output_files(spark, sf_dir), n)
    return tails.withColumn("native_id", F.col("job_id").cast("bigint")).drop("job_id")


def script_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script file per request, classified from its file."""
    folder = shared_folder(spark, "scripts")
    sinks.write_scripts(views.requests(spark, sf_dir).repartition("request_id"), folder)
    read = readers.read_scripts(spark, folder, "folders").withColumn("request_id", F.col("path"))
    found = scripts.classify(read.withColumns({"cluster": F.lit(None).cast("string"), "job_name": F.lit("")}))
    return found.groupBy("cpu_intensive", "memory_intensive", "io_intensive", "mpi_ranks").agg(F.count(F.lit(1)).alias("scripts"))


RANGES = [(1, "1995-01-01", "1995-03-31T12:00:00"), (2, "1995-03-01", "1996-01-15"), (3, "1998-01-01", "1997-01-01"), (4, None, "1996-01-01")]


def accounting_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All jobs written to the store by month, and the sums of those in some ranges of time."""
    folder = shared_folder(spark, "accounting")
    store.write_accounting(views.jobs(spark, sf_dir).select("job_id", "cluster", "runtime_seconds", "submitted"), folder, unit="month")
    schema = "job_id string, cluster string, runtime_seconds bigint, submitted timestamp"
    ranges = spark.createDataFrame(RANGES, "range_id int, start string, end string").select(
        "range_id", *[F.col(c).cast("timestamp").alias(c) for c in ("start", "end")]
    )
    found = store.in_ranges(store.read_accounting(spark, folder, schema, unit="month"), ranges, unit="month")
    return found.groupBy("range_id", "cluster").agg(
        F.count(F.lit(1)).alias("jobs"), F.sum("runtime_seconds").alias("runtime_seconds")
    )


def sensor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "sensors")
    events = views.table(spark, sf_dir, "events")
    events.select(
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("s-"), (F.col("user_id") % 50).cast("string")).alias("sensor_id"),
        F.col("value").alias("temperature"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 100).cast("double").alias("humidity"),
    ).write.options(header=True, timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(folder)
    return readers.read_sensors(spark, folder).groupBy("sensor_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.count("humidity").alias("with_humidity"),
        F.sum("humidity").alias("humidity"),
        F.max("temperature").alias("highest"),
        F.unix_micros(F.max("timestamp").cast("timestamp")).alias("latest"),
    )


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "user-events")
    events = views.table(spark, sf_dir, "events")
    names = {"event_id": "event_id", "user_id": "user_id", "event_type": "event_type", "ts": "timestamp"}
    events.select(*[F.col(c).alias(n) for c, n in names.items()]).write.option("header", True).csv(folder)
    return readers.read_user_events(spark, folder).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("users")
    )


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "splits")
    sinks.write_splits(prep.assign_split(views.unique_readings(spark, sf_dir), "reading_id"), folder)
    return prep.split_counts(spark.read.parquet(folder))


def sweep_results(spark: SparkSession, sf_dir: str, swept: DataFrame) -> DataFrame:
    folder = shared_folder(spark, "sweep")
    sinks.write_sweep_results(swept, folder, "json")
    return spark.read.schema(swept.schema).json(folder)
