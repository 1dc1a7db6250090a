"""Messages in files: a Spark data source that reads and writes one file for each message, and a stream of them.

Paths are URIs that pyarrow can open (local and mounted folders, hdfs:, s3:, gs:). Files are written
under a hidden name and moved, so that readers see whole files only; a task that is run again writes
the same names.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "trace_messages"
#: Suffixes of the formats' files.
SUFFIXES = {"proto": "out_proto", "proto_zstd": "out_proto_zstd", "proto_gzip": "out_proto_gzip", "json": "out_json", "dict": "out", "dict_zstd": "out_zstd", "dict_gzip": "out_gzip"}
SCHEMA = "name string, body binary"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def listed(uri: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files in a folder, by name; hidden ones left out."""
    store, path = opened(uri)
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


def store_file(uri: str, name: str, body: bytes) -> None:
    """Writes a file of a folder as a whole."""
    store, path = opened(uri)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/.{name}") as out:
        out.write(body)
    store.move(f"{path}/.{name}", f"{path}/{name}")


def file_name(form: str, number: int | None = None) -> str:
    """<number>_<suffix of the format>; the number is the time in nanoseconds and something that no other name has, unless one is told."""
    return f"{f'{time.time_ns()}-{uuid.uuid4().hex}' if number is None else number}_{SUFFIXES[form]}"


@dataclass
class _Files(InputPartition):
    paths: list[str]


def _parts(found: list[tuple[str, int]], size: int) -> list[InputPartition]:
    """Files in partitions of about `size` bytes."""
    parts, held = [_Files([])], 0
    for path, n in found:
        if held and held + n > size:
            parts.append(_Files([]))
            held = 0
        parts[-1].paths.append(path)
        held += n
    return parts


def _rows(uri: str, partition: _Files) -> Iterator[tuple[str, bytes]]:
    store, _ = opened(uri)
    for path in partition.paths:
        with store.open_input_stream(path) as source:
            yield path.rpartition("/")[2], source.read()


class _Reader(DataSourceReader):
    def __init__(self, uri: str, size: int):
        self.uri, self.size = uri, size

    def partitions(self) -> list[InputPartition]:
        return _parts(listed(self.uri), self.size)

    def read(self, partition: _Files) -> Iterator[tuple[str, bytes]]:
        return _rows(self.uri, partition)


@dataclass
class _Done(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, uri: str):
        self.uri = uri

    def write(self, rows: Iterator) -> WriterCommitMessage:
        names = []
        for row in rows:
            store_file(self.uri, row.name, bytes(row.body))
            names.append(row.name)
        return _Done(names)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, path = opened(self.uri)
        for name in (n for m in messages if m for n in m.names):
            store.delete_file(f"{path}/{name}")


class TraceMessages(DataSource):
    """format("trace_messages"): options path, partitionBytes; columns name, body."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("partitionBytes", 64 << 20)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the data source known to a session."""
    spark.dataSource.register(TraceMessages)


def stream(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """(name, body) of the files of a folder as they land, whatever their names and times.

    Spark's file source keeps the names that it has read in the query's checkpoint. Files that are deleted
    before they are read are passed over.
    """
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    found = source.option("maxFilesPerTrigger", files).option("maxFileAge", "36500d").load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("body"))
