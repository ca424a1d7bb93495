"""Files of containers as Spark data sources.

`container_headers` reads what a header scan needs and no more: the 78 bytes of a file's header, its directory and record 0, by seeks.
Which of them are read follows the schema that is asked for, so a scan of names reads 78 bytes a file. Files are dealt to
tasks by the bytes that will be read. `container_files` writes rows as files in two steps: tasks write into a folder of their
own attempt, and the job's commit moves what the successful attempts wrote; a job that fails leaves nothing behind, an attempt
that is repeated doubles nothing. Paths may be of any store that Arrow opens (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatch

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

HEADERS = "path string, length long, head binary, directory binary, record0 binary, bytes_read long"
FILES = "file_name string, data binary"
HEAD, GUESS = 78, 16 << 10  # bytes of the header, and of what follows in a usual file
TASK = 64 << 20  # bytes that a task reads
MOVERS = 16


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """(store, path in it) of a path with or without a scheme; file:/x is /x."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int]]


class HeaderReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.where = schema.names, options.get("path", "")
        self.glob = options.get("pathglobfilter", options.get("pathGlobFilter", "*"))

    def partitions(self) -> list[InputPartition]:
        store, root = store_of(self.where)
        own = store.get_file_info(fs.FileSelector(root, recursive=True)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
        found = sorted((f.path, f.size) for f in own if f.type == fs.FileType.File and fnmatch(f.base_name, self.glob) and not f.base_name.startswith(("_", ".")))
        each = max(1, TASK // (HEAD if not {"directory", "record0"} & {*self.columns} else GUESS))
        return [Files(found[i : i + each]) for i in range(0, len(found), each)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = store_of(self.where)
        for path, length in partition.paths:
            row = {"path": path, "length": length, "head": None, "directory": None, "record0": None, "bytes_read": 0}
            if {"head", "directory", "record0", "bytes_read"} & {*self.columns}:
                with store.open_input_file(path) as file:
                    self.fill(file, row)
            yield tuple(row[c] for c in self.columns)

    def fill(self, file, row: dict) -> None:
        """The parts that are asked for; null where the file ends before."""
        part = lambda at, size: file.read_at(size, at) if at + size <= row["length"] else None
        head = row["head"] = part(0, HEAD)
        row["bytes_read"] += len(head or b"")
        if head is None or not {"directory", "record0"} & {*self.columns}:
            return
        count = int.from_bytes(head[76:78], "big")
        directory = part(HEAD, 8 * count if "directory" in self.columns else 8 * min(2, count))
        row["bytes_read"] += len(directory or b"")
        if "directory" in self.columns:
            row["directory"] = directory
        if "record0" in self.columns and directory:
            start = int.from_bytes(directory[:4], "big")
            stop = int.from_bytes(directory[8:12], "big") if count > 1 else row["length"]
            row["record0"] = part(start, stop - start) if stop >= start else None
            row["bytes_read"] += len(row["record0"] or b"")


class HeaderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "container_headers"

    def schema(self) -> str:
        return HEADERS

    def reader(self, schema: StructType) -> DataSourceReader:
        return HeaderReader(schema, dict(self.options))


@dataclass
class Wrote(WriterCommitMessage):
    folder: str
    names: list[str]
    n_bytes: int


class FileWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.where, self.job, self.joined = options["path"], uuid.uuid4().hex, options.get("joined") == "true"
        store, _, pending = self.pending()
        store.create_dir(pending, recursive=True)

    def pending(self) -> tuple[fs.FileSystem, str, str]:
        store, root = store_of(self.where)
        return store, root, f"{root}/_pending-{self.job}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, _, pending = self.pending()
        task = TaskContext.get()
        folder = f"{pending}/{task.partitionId()}-{task.taskAttemptId()}"
        names, total, out = [], 0, None
        store.create_dir(folder, recursive=False)  # fails once the job has been given up and its folder is gone
        try:
            for row in iterator:
                name, data = os.path.basename(row["file_name"]), bytes(row["data"])
                if not name or name in (".", ".."):
                    raise ValueError(f"no name for a file: {row['file_name']!r}")
                if out is None or not self.joined or names[-1] != name:
                    if out is not None:
                        out.close()
                    out = store.open_output_stream(f"{folder}/{name}")
                    names.append(name)
                out.write(data)
                total += len(data)
        finally:
            if out is not None:
                out.close()
        return Wrote(folder, names, total)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root, pending = self.pending()
        done = [m for m in messages if m is not None]
        with ThreadPoolExecutor(MOVERS) as pool:  # names only: no byte passes through here
            list(pool.map(lambda p: store.move(*p), ((f"{m.folder}/{n}", f"{root}/{n}") for m in done for n in m.names)))
        with store.open_output_stream(f"{root}/_committed.json") as out:
            out.write(json.dumps({"files": sum(len(m.names) for m in done), "bytes": sum(m.n_bytes for m in done)}).encode())
        store.delete_dir(pending) if store.get_file_info(pending).type == fs.FileType.Directory else None

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _, pending = self.pending()
        if store.get_file_info(pending).type == fs.FileType.Directory:
            store.delete_dir(pending)


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "container_files"

    def schema(self) -> str:
        return FILES

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FileWriter(dict(self.options))


def read_headers(spark: SparkSession, path: str, glob: str = "*", columns: str = HEADERS) -> DataFrame:
    """HEADERS, or those of its columns, of the files below path."""
    spark.dataSource.register(HeaderSource)
    return spark.read.format("container_headers").schema(columns).option("pathGlobFilter", glob).load(path)


def write_files(rows: DataFrame, folder: str) -> tuple[int, int]:
    """Write each row (file_name, data) as a file of a folder, all or none; gives their number and bytes. Names stay inside the
    folder and begin with no dot or underscore of their own that readers skip."""
    return save(rows.select("file_name", "data"), folder, joined=False)


def write_joined(parts: DataFrame, folder: str) -> tuple[int, int]:
    """Write (file_name, place, data) as one file for each name, its parts one after the other by place, as write_files does. A
    task holds one part at a time, however long a file is."""
    own = parts.repartition("file_name").sortWithinPartitions("file_name", "place")
    return save(own.select("file_name", "data"), folder, joined=True)


def save(rows: DataFrame, folder: str, joined: bool) -> tuple[int, int]:
    rows.sparkSession.dataSource.register(FileSink)
    rows.write.format("container_files").option("joined", str(joined).lower()).mode("append").save(folder)
    store, root = store_of(folder)
    with store.open_input_stream(f"{root}/_committed.json") as file:
        done = json.loads(file.read())
    return done["files"], done["bytes"]
