"""Data source ``script_files``: script files in folders, written and read by tasks, listed by tasks.

A corpus of scripts is many small files. Spark's own writer makes each with several calls (and a checksum file), its reader
lists all of them on the driver. Here a task writes its files into folders of ``FILES_A_FOLDER``, and a reading task
lists the folders it reads; the driver sees names of folders only. Files are reached through pyarrow, as in ``job_files``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from jobfacts.session import shipped
from jobfacts.sources.job_files import _opened

FILES_A_FOLDER = 1000
#: Texts are handed on in batches of about so many bytes.
BATCH = 4 << 20
#: The folders of a complete write, a name a line; others belong to tasks that were repeated.
_LIST = "_folders"


class _Folder(InputPartition):
    def __init__(self, folder: str, below: bool):
        self.folder, self.below = folder, below


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[_Folder]:
        """A folder each: those of the list, or, without one, all that are seen at the top and the files beside them."""
        system, path = _opened(self.path)
        if system.get_file_info(f"{path}/{_LIST}").type == fs.FileType.File:
            with system.open_input_stream(f"{path}/{_LIST}") as listed:
                names = listed.read().decode().split()
            return [_Folder(f"{path}/{name}", True) for name in names]
        found = system.get_file_info(fs.FileSelector(path))
        folders = sorted(i.path for i in found if i.type == fs.FileType.Directory and not i.base_name.startswith(("_", ".")))
        return [_Folder(path, False), *[_Folder(folder, True) for folder in folders]]

    def read(self, partition: _Folder) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.path)
        paths, texts, size = [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], names=["path", "script"])

        for info in system.get_file_info(fs.FileSelector(partition.folder, recursive=partition.below)):
            if info.type != fs.FileType.File or info.base_name.startswith(("_", ".")):
                continue
            with system.open_input_file(info.path) as file:
                texts.append(file.read().decode("utf-8", "replace"))
            paths.append(info.path)
            size += info.size
            if size > BATCH:
                yield batch()
                paths, texts, size = [], [], 0
        if paths:
            yield batch()


class _Written(WriterCommitMessage):
    def __init__(self, folders: list[str]):
        self.folders = folders


class _Writer(DataSourceArrowWriter):
    """Folders have names of their own in each attempt of a task; a complete write lists those that count."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, path = _opened(self.path)
        task, folders, n = uuid.uuid4().hex, [], 0
        for batch in iterator:
            for script in batch.column("script"):
                if n % FILES_A_FOLDER == 0:
                    folders.append(f"{task}-{n // FILES_A_FOLDER}")
                    system.create_dir(f"{path}/{folders[-1]}", recursive=True)
                with system.open_output_stream(f"{path}/{folders[-1]}/{n % FILES_A_FOLDER}.sh") as file:
                    file.write((script.as_py() or "").encode() + b"\n")
                n += 1
        return _Written(folders)

    def commit(self, messages: list) -> None:
        system, path = _opened(self.path)
        system.create_dir(path, recursive=True)
        names = sorted(name for message in messages if message is not None for name in message.folders)
        with system.open_output_stream(f"{path}/{_LIST}") as listed:
            listed.write("\n".join(names).encode())

    def abort(self, messages: list) -> None:
        """What was written is in no list; a path without one was not written by a complete write."""


class ScriptFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "script_files"

    def schema(self) -> str:
        return "path string, script string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def registered(spark: SparkSession) -> SparkSession:
    shipped(spark)
    spark.dataSource.register(ScriptFiles)
    return spark
