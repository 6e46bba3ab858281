"""Operators that decide where rows are: partitioning, gathering, replication, union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def direct(df: DataFrame) -> DataFrame:
    """Task i to task i: a narrow dependency, so the frame itself. Also the keyed and the pipelined form."""
    return df


pipe = keyed_direct = keyed_pipe = direct


def partition(df: DataFrame, target: Column, n: int) -> DataFrame:
    """Send each row to the partition that ``target`` names, modulo ``n``; null targets go to partition 0."""
    return df.repartitionById(n, F.coalesce(F.pmod(target.cast("int"), F.lit(n)), F.lit(0)))


def hash_partition(df: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """Rows with equal keys on one partition. Without ``n`` adaptive execution picks the number."""
    return df.repartition(*keys) if n is None else df.repartition(n, *keys)


keyed_partition = hash_partition


def load_balance(df: DataFrame, n: int) -> DataFrame:
    """Rows dealt out evenly, one after another."""
    return df.repartition(n)


def key_modulo(df: DataFrame, key: str, n: int) -> DataFrame:
    """Whole-number keys to partition ``key mod n``; keys of another type to partition 0."""
    whole = df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    return partition(df, F.col(key) % n if whole else F.lit(0), n)


def range_partition(df: DataFrame, *keys, n: int | None = None, sort: bool = False) -> DataFrame:
    """Partitions hold consecutive ranges of the keys, found by sampling; ``sort`` also orders each partition."""
    out = df.repartitionByRange(*keys) if n is None else df.repartitionByRange(n, *keys)
    return out.sortWithinPartitions(*keys) if sort else out


def gather(df: DataFrame, index: str = "source") -> DataFrame:
    """All rows on one partition, each with the partition it came from.

    For small results: the contract of a gather is that one task sees every row. What comes before keeps its own tasks.
    """
    return df.withColumn(index, F.spark_partition_id()).repartition(1)


def all_gather(df: DataFrame, targets: int, index: str = "source", target: str = "target") -> DataFrame:
    """``gather`` for each of ``targets`` receivers: every row once per receiver, narrow and without a shuffle of ``df``."""
    return replicate(df.withColumn(index, F.spark_partition_id()), targets, target)


def replicate(df: DataFrame, n: int, copy: str = "copy") -> DataFrame:
    """``n`` copies of every row, numbered from 0."""
    return df.withColumn(copy, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n > 0 else df.withColumn(copy, F.lit(0)).limit(0)


def union(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Bag union by column name."""
    return reduce(DataFrame.unionByName, others, first)


class Partitioner:
    """A partitioner with a life of its own, for ``partition_with``: ``prepare`` learns the numbers of partitions on both
    sides, ``partition`` gives the target as an expression, ``commit`` is called when the exchange has been planned."""

    def prepare(self, sources: int, destinations: int) -> None:
        self.sources, self.destinations = sources, destinations

    def partition(self, df: DataFrame) -> Column:
        raise NotImplementedError

    def commit(self) -> None:
        pass


class OneToOne(Partitioner):
    """Source partition i to destination i; the numbers must be equal."""

    def prepare(self, sources: int, destinations: int) -> None:
        super().prepare(sources, destinations)
        if sources != destinations:
            raise ValueError(f"{sources} sources for {destinations} destinations")

    def partition(self, df: DataFrame) -> Column:
        return F.spark_partition_id()


def partition_with(df: DataFrame, partitioner: Partitioner, n: int) -> DataFrame:
    """An exchange to ``n`` partitions by a ``Partitioner``."""
    partitioner.prepare(df.rdd.getNumPartitions() if not df.isStreaming else n, n)
    out = partition(df, partitioner.partition(df), n)
    partitioner.commit()
    return out


def table_partition(df: DataFrame, column: int, n: int) -> DataFrame:
    """Rows, moved as Arrow tables, to ``n`` partitions by the hash of the column at an index; null keys go to partition 0."""
    key = F.col(df.columns[column])
    target = F.when(key.isNotNull(), F.pmod(F.xxhash64(key), F.lit(n)))
    return partition(df, target, n)


def table_pipe(df: DataFrame, fn=None) -> DataFrame:
    """Each Arrow table of a partition through ``fn`` (RecordBatch to RecordBatch of the same schema), task i to task i."""
    return df.mapInArrow(lambda batches: (fn(b) if fn else b for b in batches), df.schema)


def source_sequence(df: DataFrame, source: str, order: str, seq: str = "seq") -> DataFrame:
    """Number the rows of each source from 0: the rounds of lock-step streaming operators."""
    return df.withColumn(seq, F.row_number().over(Window.partitionBy(source).orderBy(order)) - 1)
