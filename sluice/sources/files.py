"""Reading bounded data: lists, maps, text, CSV, binary files, Hadoop formats, stored sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parallelize(spark: SparkSession, items: list, schema, n: int | None = None) -> DataFrame:
    """A driver-side list as a frame."""
    df = spark.createDataFrame(items, schema)
    return df.repartition(n) if n else df


collection = parallelize


def parallelize_map(spark: SparkSession, items: dict, schema="key string, value string", by: Column | None = None, n: int | None = None) -> DataFrame:
    """A driver-side map as (key, value), sorted by key or by ``by``."""
    df = spark.createDataFrame(list(items.items()), schema)
    order = by if by is not None else F.col(df.columns[0])
    return (df.repartitionByRange(n, order).sortWithinPartitions(order)) if n else df.orderBy(order)


def text(spark: SparkSession, path: str, mode: str = "split", copies: int = 1) -> DataFrame:
    """Lines of text files. "split" deals the lines out; "complete" (or "shared") gives every one of ``copies`` tasks all of them."""
    lines = spark.read.text(path)
    if mode == "split":
        return lines
    if mode in ("complete", "shared"):
        return lines.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    raise ValueError(f"mode is split or complete, not {mode}")


def text_by_lines(spark: SparkSession, path: str, lines: int, name: str = "split") -> DataFrame:
    """Lines of a text file in splits of ``lines`` consecutive lines, one split a task: (split, value).

    Hadoop's line-count splits: the driver scans the file for the splits' borders, tasks read their own part.
    """
    kinds = ("org.apache.hadoop.mapreduce.lib.input.NLineInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text")
    conf = {"mapreduce.input.lineinputformat.linespermap": str(lines)}
    rows = hadoop(spark, path, *kinds, "offset long, value string", conf)
    return rows.select(F.spark_partition_id().alias(name), "value")


def csv(spark: SparkSession, path: str, schema=None, delimiter: str = ",", header: bool = False) -> DataFrame:
    """Typed columns with a schema; without one, each line split at the delimiter, without quoting, as an array."""
    if schema is not None:
        return spark.read.csv(path, schema=schema, sep=delimiter, header=header)
    return spark.read.text(path).select(F.split("value", f"\\Q{delimiter}\\E", -1).alias("fields"))


def keyed(df: DataFrame, key: Column, value: Column) -> DataFrame:
    return df.select(key.alias("key"), value.alias("value"))


def binary_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def fixed_records(spark: SparkSession, path: str, size: int) -> DataFrame:
    """Records of ``size`` bytes from binary files, splittable at record borders; (record)."""
    rdd = spark.sparkContext.binaryRecords(path, size)
    return spark.createDataFrame(rdd.map(lambda b: (bytearray(b),)), "record binary")


def hadoop(spark: SparkSession, path: str, input_format: str, key_class: str, value_class: str, schema, conf: dict | None = None) -> DataFrame:
    """Any Hadoop input format, as (key, value) by ``schema``."""
    rdd = spark.sparkContext.newAPIHadoopFile(path, input_format, key_class, value_class, conf=conf or {})
    return spark.createDataFrame(rdd, schema)


def generated(spark: SparkSession, rows: int, n: int | None = None, **columns: Column) -> DataFrame:
    """``rows`` generated rows; expressions may use ``id``."""
    base = spark.range(rows, numPartitions=n) if n else spark.range(rows)
    return base.select(*[c.alias(k) for k, c in columns.items()]) if columns else base


def stored(spark: SparkSession, path: str) -> DataFrame:
    """A persisted set, for instance after a restart."""
    return spark.read.parquet(path)
