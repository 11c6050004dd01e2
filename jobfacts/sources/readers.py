"""Readers of job dumps, listings, registries, scripts, output and sensor files.

Every reader has an explicit schema and leaves filters and column choice to the
caller's plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobfacts import schemas
from jobfacts.operators import normalize
from jobfacts.sources import envelopes, job_files, script_files
from jobfacts.sources.lines import numbered_among, numbered_lines


def _slurm_struct() -> T.StructType:
    return T.StructType.fromDDL(schemas.slurm_text())


def read_slurm_jobs(spark: SparkSession, path: str, layout: str = "envelope") -> DataFrame:
    """Slurm jobs as typed columns.

    ``envelope``: each file is one ``{"jobs": [...]}`` answer, so a file is the
    unit of work. ``ranges``: the same, valid JSON of any size, cut into blocks that
    many tasks read. ``lines``: one job per line, which splits at any size.
    """
    if layout == "ranges":
        records = envelopes.read_records(spark, path, "jobs")
        return normalize.parse_slurm_lines(records, "text")
    if layout == "lines":
        return normalize.typed_numbers(spark.read.schema(_slurm_struct()).json(path))
    if layout != "envelope":
        raise ValueError(f"layout must be envelope, ranges or lines, got {layout!r}")
    # cut into jobs first: on multi-line files Spark's JSON reader takes about ten times as long for a job
    answers = spark.read.text(path, wholetext=True)
    jobs = answers.select(F.explode(F.from_json("value", "jobs array<string>")["jobs"]).alias("text"))
    return normalize.parse_slurm_lines(jobs, "text")


def read_flux_jobs(spark: SparkSession, path: str, fields: int = 11) -> DataFrame:
    """Flux job lines split into named columns; ``reject`` says why a row is unusable."""
    names = {11: schemas.FLUX_LONG_FIELDS, 5: schemas.FLUX_SHORT_FIELDS}.get(fields)
    if names is None:
        raise ValueError(f"fields must be 11 or 5, got {fields}")
    return normalize.split_flux_lines(spark.read.text(path), names)


def _read_table(spark: SparkSession, path: str, schema: str, format: str) -> DataFrame:
    if format not in ("json", "parquet"):
        raise ValueError(f"format must be json or parquet, got {format!r}")
    return spark.read.format(format).schema(schema).load(path)


def read_nodes(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return _read_table(spark, path, schemas.NODES, format)


def read_partitions(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return _read_table(spark, path, schemas.PARTITIONS, format)


def read_clusters(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """The cluster registry; entries without a name are skipped."""
    return _read_table(spark, path, schemas.CLUSTERS, format).filter(F.col("name").isNotNull())


def read_miniclusters(spark: SparkSession, path: str) -> DataFrame:
    """MiniClusters from list answers (``{"items": [...]}``), one row each."""
    item = T.StructType.fromDDL(schemas.MINICLUSTERS)
    answer = T.StructType([T.StructField("items", T.ArrayType(item))])
    listed = spark.read.schema(answer).option("multiLine", True).json(path)
    return listed.select(F.explode("items").alias("item")).select(
        F.col("item.metadata.namespace").alias("namespace"),
        F.col("item.metadata.name").alias("name"),
        "item.spec",
        "item.status",
    )


_OUTPUT_NAME = r"([^/]+?)\.(out|err)$"


def _output_columns(path: Column | None = None) -> list:
    path = F.col("_metadata.file_path") if path is None else path
    ending = F.regexp_extract(path, _OUTPUT_NAME, 2)
    return [
        F.url_decode(F.regexp_extract(path, _OUTPUT_NAME, 1)).alias("job_id"),
        F.when(ending == "err", F.lit("stderr")).otherwise(F.lit("stdout")).alias("stream"),
    ]


def read_job_output(spark: SparkSession, path: str, layout: str = "files") -> DataFrame:
    """Lines of ``<job>.out`` and ``<job>.err`` files: job_id, stream, block, line_no, line.

    ``files``: a file is read whole, and a final newline makes an empty last
    line. ``lines``: files of any size, split over tasks; a final newline is then
    no line of its own. line_no is the line's number in its file in both; block is
    where the file's part begins that the line was read with. An empty
    file gives no row, and reads as empty output after ``output.with_output``.
    """
    if layout == "files":
        texts = spark.read.text(path, wholetext=True)
        return texts.select(
            *_output_columns(),
            F.lit(0).cast("bigint").alias("block"),
            F.posexplode(F.split("value", "\n")).alias("line_no", "line"),
        ).withColumn("line_no", F.col("line_no").cast("bigint"))
    if layout != "lines":
        raise ValueError(f"layout must be files or lines, got {layout!r}")
    lines = numbered_lines(spark, path)
    return lines.select(*_output_columns(F.col("file")), "block", "line_no", "line")


def read_output_tails(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The last ``n`` lines of each ``<job>.out`` and ``<job>.err``: job_id, stream, from_end, line, truncated.

    Only the ends of the files are read. The rows are those of ``output.tail_lines`` over ``read_job_output`` in the
    ``lines`` layout; an empty file gives none.
    """
    return job_files.registered(spark).read.format("job_output").option("lines", n).load(path)


def read_scripts(spark: SparkSession, path: str, layout: str = "files") -> DataFrame:
    """Script files: path and whole text.

    ``files``: what Spark lists at ``path``, all of it on the driver. ``folders``: folders of files below ``path``, such as
    ``sinks.write_scripts`` makes, each listed by the task that reads it.
    """
    if layout == "folders":
        return script_files.registered(spark).read.format("script_files").load(path)
    if layout != "files":
        raise ValueError(f"layout must be files or folders, got {layout!r}")
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("script")
    )


def read_commands(spark: SparkSession, path: str) -> DataFrame:
    """Command lists: one row per file with its commands in order.

    Blank lines and lines that start with ``#`` are no commands. The shape is
    what ``batch.expand_commands`` takes.
    """
    lines = F.split("value", "\n")
    commands = F.filter(lines, lambda line: line.rlike(r"\S") & ~line.startswith("#"))
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("batch_id"),
        F.lit(None).cast("string").alias("array_spec"),
        commands.alias("commands"),
        F.lit(None).cast("int").alias("max_concurrent"),
    )


def read_command_lines(spark: SparkSession, path: str) -> DataFrame:
    """The commands of lists of any length, one a row: batch_id (the file), task_index (from 0), command.

    The same commands as ``read_commands`` and ``batch.expand_commands`` give, without a row that holds a list.
    """
    command = F.col("line").rlike(r"\S") & ~F.col("line").startswith("#")
    found = numbered_among(spark, path, command)
    return found.select(F.col("file").alias("batch_id"), F.col("number").alias("task_index"), F.col("line").alias("command"))


def read_sensors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(schemas.SENSORS).csv(path)


def read_user_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(schemas.USER_EVENTS).csv(path)


def read_accounting_store(
    spark: SparkSession,
    url: str,
    table: str,
    column: str,
    lower: int,
    upper: int,
    partitions: int,
    **options: str,
) -> DataFrame:
    """A relational accounting table, read in parallel ranges of a numeric column."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    return reader.options(
        partitionColumn=column,
        lowerBound=str(lower),
        upperBound=str(upper),
        numPartitions=str(partitions),
    ).load()


def read_accounting_export(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A parquet export of the accounting store."""
    return spark.read.schema(schema).parquet(path)
