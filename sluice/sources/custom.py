"""Sources written in Python through Spark's data source interface: pull iterators and Arrow IPC files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage


def custom(spark: SparkSession, name: str, partitions: int, rows: Callable[[int], Iterator[tuple]], columns: str) -> DataFrame:
    """A frame whose partition i holds the tuples of ``rows(i)``."""

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(i) for i in range(partitions)]

        def read(self, part):
            yield from rows(part.value)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return columns

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Source)
    return spark.read.format(name).load()


def arrow(spark: SparkSession, path: str | list[str], schema=None, batches_per_task: int = 16) -> DataFrame:
    """All columns of Arrow IPC files (file or stream format).

    A file of the file format is read by ranges of ``batches_per_task`` record batches, one range a task, as its footer tells
    where they lie, so neither a task nor its memory grows with the file. A file of the stream format has no footer: one task
    reads it, batch by batch. Files are listed by Spark and opened through Arrow's file systems, by path or URI.
    """
    names = [r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect()]  # paths, not contents
    if not names:
        raise ValueError(f"no Arrow files at {path}")
    if schema is None:
        with _opened(names[0]) as (reader, _):
            schema = spark.createDataFrame(reader.schema.empty_table()).schema

    def ranges(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with _opened(name) as (_, count):
                    starts = [0] if count is None else list(range(0, count, batches_per_task))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(starts), pa.string()), pa.array(starts, pa.int64())], names=["path", "first"])

    def read(batches):
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with _opened(name) as (reader, count):
                    if count is None:
                        yield from reader
                    else:
                        for k in range(first, min(count, first + batches_per_task)):
                            yield reader.get_batch(k)

    listed = spark.createDataFrame([(n,) for n in names], "path string").repartition(min(len(names), 1000))
    parts = listed.mapInArrow(ranges, "path string, first long")
    return parts.repartition(spark.sparkContext.defaultParallelism * 4).mapInArrow(read, schema)


@contextmanager
def _opened(name: str):
    """(reader, number of record batches or None for the stream format) of a file, which is read by range."""
    fs, base = pafs.FileSystem.from_uri(name) if "://" in name else (pafs.LocalFileSystem(), name.removeprefix("file:"))
    with fs.open_input_file(base) as f:
        if f.read_at(6, 0) == b"ARROW1":
            reader = pa.ipc.open_file(f)
            yield reader, reader.num_record_batches
        else:
            f.seek(0)
            yield pa.ipc.open_stream(f), None


def custom_sink(df: DataFrame, name: str, write: Callable[[int, Iterator], object], commit: Callable[[list], None]) -> None:
    """Write through Spark's data sink interface: ``write(partition, rows)`` runs in each task and returns what it wrote;
    ``commit(parts)`` runs once, in a Python process beside the driver, with the results of the tasks that count."""

    class Message(WriterCommitMessage):
        def __init__(self, part):
            self.part = part

    class Writer(DataSourceWriter):
        def write(self, rows):
            from pyspark import TaskContext

            return Message(write(TaskContext.get().partitionId(), rows))

        def commit(self, messages):
            commit([m.part for m in messages if m is not None])

    class Sink(DataSource):
        @classmethod
        def name(cls):
            return name

        def writer(self, schema, overwrite):
            return Writer()

    df.sparkSession.dataSource.register(Sink)
    df.write.format(name).mode("append").save()
