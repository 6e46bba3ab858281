"""Structured Streaming: sources, stateless steps, sinks, and the running keyed operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.time import micros


def files(spark: SparkSession, path: str, schema, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    """A stream of the files of a folder or glob."""
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(path)


def arrow_files(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the Arrow IPC files of a folder: Spark lists them, tasks read their batches by range."""
    from ..sources.custom import _opened

    def read(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with _opened(name) as (reader, count):
                    yield from reader if count is None else (reader.get_batch(k) for k in range(count))

    kinds = "path string, modificationTime timestamp, length long, content binary"
    return files(spark, path, kinds, "binaryFile").select("path").mapInArrow(read, schema)


def rate(spark: SparkSession, per_second: int, **columns: Column) -> DataFrame:
    base = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return base.select(*[c.alias(n) for n, c in columns.items()]) if columns else base


def kafka_reader(spark: SparkSession, servers: str, topics: str, starting: str = "earliest", **options):
    """The configured reader; ``options`` are Kafka's or Spark's own, with ``__`` for dots."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).option("startingOffsets", starting)
    for key, value in options.items():
        reader = reader.option(key.replace("__", "."), value)
    return reader


def kafka(spark: SparkSession, servers: str, topics: str, starting: str = "earliest", **options) -> DataFrame:
    """Needs Spark's Kafka package on the class path; offsets live in the query's checkpoint and resume after the last."""
    reader = kafka_reader(spark, servers, topics, starting, **options)
    return reader.load().select("topic", "partition", "offset", "timestamp", F.col("key").cast("string"), F.col("value").cast("string"))


def start(df: DataFrame, sink: str, checkpoint: str, mode: str = "append", name: str | None = None, path: str | None = None, once: bool = True) -> StreamingQuery:
    """Run a stream into a memory table (``name``), files (``path``) or the console; ``once`` drains what is there."""
    writer = df.writeStream.format(sink).outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    writer = writer.trigger(availableNow=True) if once else writer
    return writer.start(path) if path else writer.start()


def for_each_batch(df: DataFrame, fn, checkpoint: str, mode: str = "append", once: bool = True) -> StreamingQuery:
    """``fn(batch, id)`` on each micro-batch: any batch operator or sink. ``fn`` may see an id again after a failure."""
    writer = df.writeStream.foreachBatch(fn).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def keyed_reduce(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """A running fold per key: with mode ``update`` each trigger emits the keys it changed."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def keyed_gather(df: DataFrame, keys: list[str], value: str, name: str = "values") -> DataFrame:
    """All values of each key so far. State grows with the stream; ``stateful.keyed_gather`` hands values on in parts and sheds them."""
    return df.groupBy(*keys).agg(F.collect_list(value).alias(name))


def word_count(df: DataFrame, column: str = "value") -> DataFrame:
    words = df.select(F.explode(F.split(column, r"\s+")).alias("word")).where("word != ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))


def event_time_windows(df: DataFrame, ts: str, length: str, slide: str | None = None, lateness: str = "0 seconds", keys: list[str] | None = None, **aggregates: Column) -> DataFrame:
    """Windows (end - length, end] over event time, with Spark's watermark on the shifted timestamp.

    Spark drops a row only once its windows are closed, so a row behind the watermark may still count where a window is
    open; ``stateful.late_rows`` is the strict rule.
    """
    # Watermarks need timestamps with a zone; times without one are taken as UTC.
    shifted = df.withColumn("__ts", F.timestamp_micros(micros(df, ts) - 1)).withWatermark("__ts", lateness)
    grouped = shifted.groupBy(*(keys or []), F.window("__ts", length, slide or length).alias("__w"))
    return grouped.agg(*[c.alias(n) for n, c in aggregates.items()]).select(*(keys or []), F.col("__w.end").alias("window_end"), *aggregates)


def processing_time_windows(df: DataFrame, length: str, slide: str | None = None, keys: list[str] | None = None, **aggregates: Column) -> DataFrame:
    """Windows over the time at which rows are processed."""
    return event_time_windows(df.withColumn("__now", F.current_timestamp()), "__now", length, slide, keys=keys, **aggregates)


def join(left: DataFrame, right: DataFrame, on: str, left_ts: str, right_ts: str, within: str, lateness: str = "0 seconds", how: str = "inner") -> DataFrame:
    """Rows of two streams with equal keys whose times are at most ``within`` apart; watermarks let old rows leave the state."""
    a = left.withWatermark(left_ts, lateness).alias("l")
    b = right.withWatermark(right_ts, lateness).alias("r")
    near = F.expr(f"r.`{right_ts}` BETWEEN l.`{left_ts}` - INTERVAL {within} AND l.`{left_ts}` + INTERVAL {within}")
    return a.join(b, (F.col(f"l.{on}") == F.col(f"r.{on}")) & near, how)


def custom(spark: SparkSession, name: str, rows, columns: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of the tuples ``rows(i)`` for i = 0, 1, ...; None ends what is there for now.

    The offset is the next i, kept in the query's checkpoint, so ``rows`` must give the same tuple for the same i.
    """
    from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

    class Reader(SimpleDataSourceStreamReader):
        def initialOffset(self):
            return {"next": 0}

        def read(self, start):
            at, found = start["next"], []
            while len(found) < per_trigger and (row := rows(at)) is not None:
                found.append(row)
                at += 1
            return iter(found), {"next": at}

        def readBetweenOffsets(self, start, end):
            return iter([rows(i) for i in range(start["next"], end["next"])])

        def commit(self, end):
            pass

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return columns

        def simpleStreamReader(self, schema):
            return Reader()

    spark.dataSource.register(Source)
    return spark.readStream.format(name).load()
