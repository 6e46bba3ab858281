"""Sinks and actions."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sink(df: DataFrame, fn) -> None:
    """``fn`` gets each partition as an iterator of rows."""
    df.foreachPartition(fn)


def write_text(df: DataFrame, path: str, column: str = "value", overwrite: bool = False) -> None:
    """One file per partition; without ``overwrite`` an existing target is an error."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite" if overwrite else "error").text(path)


def write_csv(df: DataFrame, path: str, delimiter: str = ",", header: bool = True, overwrite: bool = False) -> None:
    """One header per file."""
    df.write.mode("overwrite" if overwrite else "error").csv(path, sep=delimiter, header=header)


def write_arrow(df: DataFrame, folder: str) -> DataFrame:
    """One Arrow IPC file per partition; returns (file, rows), which must be consumed for the files to be written.

    File names are fresh for each attempt, so only the returned names count.
    """

    def write(batches):
        out, rows, name = None, 0, f"{uuid.uuid4().hex}.arrow"
        fs, base = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder.removeprefix("file:"))
        fs.create_dir(base, recursive=True)
        stream = None
        for batch in batches:
            if out is None:
                stream = fs.open_output_stream(f"{base}/{name}")
                out = pa.ipc.new_file(stream, batch.schema)
            out.write_batch(batch)
            rows += batch.num_rows
        if out is not None:
            out.close()
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows])], names=["file", "rows"])

    return df.mapInArrow(write, "file string, rows long")


def cache(df: DataFrame) -> DataFrame:
    """Materialised in memory now, spilling to disk."""
    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    return out


def lazy_cache(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def persist(df: DataFrame, path: str) -> DataFrame:
    """Materialised at ``path``; a later run finds the finished set there and reads it instead of computing it."""
    spark = df.sparkSession
    if not finished(spark, path):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def lazy_persist(df: DataFrame, path: str):
    """The persisted set, made when the result is called."""
    return lambda: persist(df, path)


def finished(spark, path: str) -> bool:
    """Whether a set was written completely: Spark leaves the mark last."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def get_data(df: DataFrame):
    """Rows on the driver, one partition at a time."""
    return df.toLocalIterator()
