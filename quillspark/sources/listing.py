"""Listing files as a Spark data source: path, length and time of every file below a folder, empty ones too, without opening any."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SCHEMA = "path string, length long, modified timestamp"
BATCH = 4096


@dataclass
class Folder(InputPartition):
    path: str
    recursive: bool


class ListingReader(DataSourceReader):
    """The folder's own files are one task, and each folder in it, with all that is below, another."""

    def __init__(self, schema: StructType, path: str) -> None:
        self.schema, self.path = schema, path

    def partitions(self) -> list[Folder]:
        where, top = fs.FileSystem.from_uri(self.path)
        inside = [f.path for f in where.get_file_info(fs.FileSelector(top)) if f.type == fs.FileType.Directory]
        return [Folder(top, False), *[Folder(p, True) for p in sorted(inside)]]

    def read(self, part: Folder) -> Iterator[pa.RecordBatch]:
        where, _ = fs.FileSystem.from_uri(self.path)
        kind = to_arrow_schema(self.schema)
        files = [f for f in where.get_file_info(fs.FileSelector(part.path, recursive=part.recursive)) if f.is_file]
        for at in range(0, len(files), BATCH):
            some = files[at : at + BATCH]
            columns = {"path": [f.path for f in some], "length": [f.size for f in some], "modified": [f.mtime for f in some]}
            yield pa.RecordBatch.from_arrays([pa.array(columns[c.name]).cast(c.type) for c in kind], names=kind.names)


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ListingReader:
        return ListingReader(schema, self.options["path"])


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modified of every file below ``root``, a path that pyarrow's file systems open."""
    spark.dataSource.register(ListingSource)
    return spark.read.format("listing").load(root)
