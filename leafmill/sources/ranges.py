"""Byte ranges of files, read by seeking: a Python data source with one partition a range."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, offset long, limit long, content binary"


@dataclass
class ByteRange(InputPartition):
    path: str
    offset: int
    limit: int


class _RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.ranges = [ByteRange(*r) for r in json.loads(options["ranges"])]

    def partitions(self) -> Sequence[ByteRange]:
        return self.ranges

    def read(self, partition: ByteRange) -> Iterator[tuple]:
        from pyarrow import fs

        if "://" in partition.path:
            store, name = fs.FileSystem.from_uri(partition.path)
        else:
            store, name = fs.LocalFileSystem(), partition.path.removeprefix("file:")
        with store.open_input_file(name) as file:
            size = file.size()
            start = min(partition.offset, size)
            left = size - start
            content = file.read_at(left if partition.limit < 0 else min(left, partition.limit), start)
        yield partition.path, partition.offset, partition.limit, content


class RangeSource(DataSource):
    """``spark.read.format("byte_ranges").option("ranges", json)`` with a list of [path, offset, limit]."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _RangeReader(dict(self.options))


def read_ranges(spark: SparkSession, ranges: Sequence[tuple[str, int, int]]) -> DataFrame:
    """``path, offset, limit, content`` of byte ranges of files; only the bytes asked for are read.

    A negative limit reads to the end, what lies past the end of a file is left out. Paths are addresses pyarrow can open (files, hdfs, s3, gs) and must be
    reachable from the executors; other stores are read whole by ``scan_binary``.
    """
    spark.dataSource.register(RangeSource)
    told = json.dumps([[str(p), int(o), int(n)] for p, o, n in ranges])
    return spark.read.format("byte_ranges").option("ranges", told).load()
