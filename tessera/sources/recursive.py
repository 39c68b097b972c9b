"""A data source of whole files: every file below a folder once, whatever its name, read by tasks.

``spark.read.format("tessera_files").load(path)`` gives ``(path, bytes, error)``. Spark's own readers pass over files
and folders whose names begin with ``_`` or ``.``; here the file system's own recursive listing decides, and the
driver lists names only. Files are packed into partitions of about ``PART_BYTES`` or ``PART_FILES`` files.

A file that cannot be read gives a row with the name of the error and no bytes: ``FileTooLarge`` (over
``MOST_BYTES``), ``FileNotFoundError`` (gone since it was listed), ``PermissionError``, ``OSError``. A path that does not
exist is refused with ``ValueError``; an empty folder gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "tessera_files"
PART_BYTES, PART_FILES, MOST_BYTES = 64 << 20, 2000, 1 << 30
#: Files that leave the worker together, at most, and their bytes.
BATCH_FILES, BATCH_BYTES = 256, 4 << 20
FOLDER_FILES = 1000
#: Schemes that can be listed and read from Python.
SCHEMES = ("file", "hdfs", "s3", "gs")
SCHEMA = "path string, bytes binary, error string"


def open_path(path: str) -> tuple[pafs.FileSystem, str, str]:
    """(file system, path in it, what to put before such a path)."""
    if "://" not in path:
        return pafs.LocalFileSystem(), path.removeprefix("file:"), "file:"
    system, inner = pafs.FileSystem.from_uri(path)
    return system, inner, "file:" if path.startswith("file:") else path[: len(path) - len(inner)] if path.endswith(inner) else path.split("://")[0] + "://"


class Files(InputPartition):
    def __init__(self, names: list[tuple[str, int]]):
        self.names = names


class FilesReader(DataSourceReader):
    def __init__(self, path: str, most_bytes: int):
        self.path, self.most_bytes = path, most_bytes

    def partitions(self) -> list[Files]:
        system, inner, _ = open_path(self.path)
        top = system.get_file_info(inner)
        if top.type == pafs.FileType.NotFound:
            raise ValueError(f"invalid source path: {self.path}")
        found = [top] if top.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(inner, recursive=True))
        parts, size = [Files([])], 0
        for info in sorted((f for f in found if f.type == pafs.FileType.File), key=lambda f: f.path):
            if parts[-1].names and (size + info.size > PART_BYTES or len(parts[-1].names) >= PART_FILES):
                parts.append(Files([]))
                size = 0
            parts[-1].names.append((info.path, info.size))
            size += info.size
        return parts

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _, before = open_path(self.path)
        names, values, errors, held = [], [], [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.binary()), pa.array(errors, pa.string())], ["path", "bytes", "error"])

        for name, size in partition.names:
            value, error = None, None
            if size > self.most_bytes:
                error = "FileTooLarge"
            else:
                try:
                    with system.open_input_file(name) as f:
                        value = f.read()
                except (FileNotFoundError, PermissionError) as e:
                    error = type(e).__name__
                except OSError:
                    error = "OSError"
            if names and held + len(value or b"") > BATCH_BYTES:
                yield batch()
                names, values, errors, held = [], [], [], 0
            names.append(before + name)
            values.append(value)
            errors.append(error)
            held += len(value or b"")
            if len(names) >= BATCH_FILES:
                yield batch()
                names, values, errors, held = [], [], [], 0
        if names:
            yield batch()


def writer(path: str):
    """Rows (name, content) -> files of their own, in folders by task and number; the number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner, _ = open_path(path)
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            for name, content in zip(*batch.columns):
                folder = f"{inner}/{part}/{done // FOLDER_FILES}"
                if done % FOLDER_FILES == 0:
                    system.create_dir(folder, recursive=True)
                with system.open_output_stream(f"{folder}/{name.as_py()}-{part}-{done}.txt") as f:
                    f.write(content.as_buffer())
                done += 1
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["n"])

    return run


class FilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FilesReader:
        return FilesReader(self.options["path"], int(self.options.get("mostBytes", MOST_BYTES)))
