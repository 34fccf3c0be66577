"""Arrow IPC (Feather) files, one task a record batch.

The driver reads the footer; a task reads the footer and the bytes of its batch.
Stores that Arrow knows (files, HDFS, object stores) are read by ranges. A path
that only Spark's readers open is read through them, a file a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

from axonspark.sources import store


class Batch(InputPartition):
    def __init__(self, path: str, index: int):
        self.path, self.index = path, index


def _open(path: str) -> pa.ipc.RecordBatchFileReader:
    where, name = store.native(path)
    return pa.ipc.open_file(where.open_input_file(name))


class ArrowFile(DataSource):
    """``spark.read.format("arrow_file").load(path)``: a record batch at a time."""

    @classmethod
    def name(cls) -> str:
        return "arrow_file"

    def schema(self):
        return from_arrow_schema(_open(self.options["path"]).schema)

    def reader(self, schema) -> DataSourceReader:
        return ArrowReader(self.options["path"])


class ArrowReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Batch]:
        return [Batch(self.path, k) for k in range(_open(self.path).num_record_batches)]

    def read(self, partition: Batch) -> Iterator[pa.RecordBatch]:
        yield _open(partition.path).get_batch(partition.index)


def _schema(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for body in b.column(0):
            yield pa.RecordBatch.from_pydict({"schema": [pa.ipc.open_file(body.as_buffer()).schema.serialize().to_pybytes()]})


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for body in b.column(0):
            opened = pa.ipc.open_file(body.as_buffer())
            for k in range(opened.num_record_batches):
                yield opened.get_batch(k)


def _known(path: str) -> bool:
    """Whether Arrow itself can open files of this store."""
    try:
        store.native(path)
    except (pa.ArrowInvalid, OSError, NotImplementedError):
        return False
    return True


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    if _known(path):
        spark.dataSource.register(ArrowFile)
        return spark.read.format("arrow_file").load(path)
    files = spark.read.format("binaryFile").load(path).select("content")
    found = files.limit(1).mapInArrow(_schema, "schema binary").first()
    if found is None:
        raise FileNotFoundError(path)
    return files.mapInArrow(_rows, from_arrow_schema(pa.ipc.read_schema(pa.py_buffer(found["schema"]))))
