"""What several of the operators need: written intermediates, bounded Arrow batches, string buffers."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import jobfacts
from jobfacts.session import shared_folder

BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """`df` written to the shared folder and read back: its lineage ends here, and lost executors lose nothing."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shipped(spark: SparkSession) -> None:
    """Hand this package to the Python workers, as `spark-submit --py-files` does; once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "jobfacts_shipped", False):
        return
    package = Path(jobfacts.__file__).parent
    target = Path(tempfile.mkdtemp(prefix="jobfacts-code-")) / "jobfacts.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    context.jobfacts_shipped = True


def given_back() -> None:
    """Hand free memory of this process back to the system: Python workers live on after a task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """`df.mapInArrow`, with this package at hand in the workers, which keep no memory when a task is over."""
    shipped(df.sparkSession)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        given_back()

    return df.mapInArrow(tidy, schema)


def apart(df: DataFrame, key: str) -> DataFrame:
    """`df` dealt out anew, by another function of its key than the join that follows uses.

    A join next to an aggregate reuses the aggregate's partitions, and adaptive execution can't split a hot key there;
    between two plain exchanges it can.
    """
    return df.repartition(F.xxhash64(key))


def spread(df: DataFrame) -> int:
    """How many partitions the session shuffles into."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the offsets of its values; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = column.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    at = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return body, at - at[0]


def small(batches: Iterator[pa.RecordBatch], name: str, size: int = BATCH_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes of column `name`, one row at least and `rows` at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = raw(batch.column(name))[1]
        begin = 0
        while begin < batch.num_rows:
            end = min(begin + rows, max(begin + 1, int(np.searchsorted(at, at[begin] + size, "right")) - 1))
            yield batch.slice(begin, end - begin)
            begin = end
