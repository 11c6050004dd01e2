"""Data source ``job_output``: writes ``<job>.out`` and ``<job>.err`` files, and reads the ends of such files.

Files are reached through pyarrow: a shared folder, S3, GCS or HDFS. Reading whole files is ``readers.read_job_output``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from jobfacts.session import shipped

FILES_A_TASK = 256
BLOCK = 64 << 10
_ENDINGS = {"stdout": "out", "stderr": "err"}
_NAME = re.compile(r"([^/]+)\.(out|err)$")


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path on it; a path without a scheme, or with ``file:``, is one that all machines share."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def last_lines(file, size: int, n: int) -> tuple[list[bytes], bool]:
    """The last `n` lines of an open file and whether there are more, from blocks read backwards until they suffice."""
    held, at, breaks = [], size, 0
    while at and breaks <= n + 1:
        begin = max(0, at - BLOCK)
        file.seek(begin)
        held.append(file.read(at - begin))
        breaks += held[-1].count(b"\n")
        at = begin
    text = b"".join(reversed(held)).removesuffix(b"\n")
    lines = text.split(b"\n") if size else []
    return lines[-n:] if n else [], len(lines) > n


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class _Tails(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.n = options["path"], int(options.get("lines", 10))

    def partitions(self) -> list[_Files]:
        system, path = _opened(self.path)
        found = sorted(
            (i.path, i.size) for i in system.get_file_info(fs.FileSelector(path))
            if i.type == fs.FileType.File and _NAME.search(i.path) and not i.base_name.startswith(("_", "."))
        )
        return [_Files(found[i : i + FILES_A_TASK]) for i in range(0, len(found), FILES_A_TASK)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        system, _ = _opened(self.path)
        for path, size in partition.files:
            job, ending = _NAME.search(path).groups()
            with system.open_input_file(path) as file:
                lines, more = last_lines(file, size, self.n)
            for k, line in enumerate(reversed(lines), 1):
                yield job, "stderr" if ending == "err" else "stdout", k, line.decode("utf-8", "replace"), more


class _Writer(DataSourceWriter):
    """Tasks write a file aside and move it to its name when it is complete: a repeated task replaces it by the same."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, path = _opened(self.path)
        system.create_dir(f"{path}/_staging", recursive=True)
        name, file, aside = None, None, ""

        def done() -> None:
            if file is not None:
                file.close()
                system.move(aside, f"{path}/{name}")

        for row in iterator:
            now = f"{row['job_id']}.{_ENDINGS[row['stream']]}"
            if now != name:
                done()
                if "/" in now:
                    raise ValueError(f"a job id names a file and can't have a slash: {row['job_id']!r}")
                name, aside = now, f"{path}/_staging/{uuid.uuid4().hex}"
                file = system.open_output_stream(aside)
            file.write(row["line"].encode() + b"\n")
        done()
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        system, path = _opened(self.path)
        if system.get_file_info(f"{path}/_staging").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/_staging")
        system.create_dir(path, recursive=True)
        system.open_output_stream(f"{path}/_SUCCESS").close()

    def abort(self, messages: list) -> None:
        """What was begun stays in the staging folder, which readers skip."""


class JobOutput(DataSource):
    @classmethod
    def name(cls) -> str:
        return "job_output"

    def schema(self) -> str:
        return "job_id string, stream string, from_end int, line string, truncated boolean"

    def reader(self, schema) -> _Tails:
        return _Tails(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def registered(spark: SparkSession) -> SparkSession:
    shipped(spark)
    spark.dataSource.register(JobOutput)
    return spark
