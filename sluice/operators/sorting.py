"""Order, ranks, limits and set operations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_sort(df: DataFrame, *keys) -> DataFrame:
    """Range partitions in order, each sorted."""
    return df.orderBy(*keys)


def global_rank(df: DataFrame, keys: list, name: str = "rank", parts: int | None = None) -> DataFrame:
    """The place of each row in the total order, from 1, without one task seeing all rows.

    Rows are range-partitioned and numbered within partitions; the partitions' sizes, one row each, give the offsets.
    ``keys`` must be a total order.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = df.repartitionByRange(n, *keys).withColumn("__part", F.spark_partition_id())
    numbered = parted.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(*keys)))
    sizes = numbered.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return numbered.join(F.broadcast(before), "__part").withColumn(name, F.col("__at") + F.col("__before")).drop("__part", "__at", "__before")


def top_k(df: DataFrame, k: int, *keys) -> DataFrame:
    return df.orderBy(*keys).limit(k)


def top_k_by_key(df: DataFrame, k: int, keys: list[str], *order: Column, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def distinct(df: DataFrame, *keys: str) -> DataFrame:
    return df.dropDuplicates(list(keys)) if keys else df.distinct()


def intersect(a: DataFrame, b: DataFrame, bag: bool = False) -> DataFrame:
    return a.intersectAll(b) if bag else a.intersect(b)


def difference(a: DataFrame, b: DataFrame, bag: bool = True) -> DataFrame:
    return a.exceptAll(b) if bag else a.subtract(b)


def sort_check(df: DataFrame, key: str) -> DataFrame:
    """One row of a range-partitioned sort: sorted, rows, and checksum (the sum of 32 bits of the keys' MD5), without sorting again.

    Each partition is read once, in order; it gives its first and last key, and these are compared across partitions.
    """
    kind = df.schema[key].dataType.simpleString()

    def ends(frames):
        first = last = None
        rows, good = 0, True
        for frame in frames:
            keys = frame["key"]
            if not len(keys):
                continue
            good &= bool(keys.is_monotonic_increasing) and (last is None or not keys.iloc[0] < last)
            first, last = keys.iloc[0] if first is None else first, keys.iloc[-1]
            rows += len(keys)
        if rows:
            yield pd.DataFrame({"part": [frame["part"].iloc[0]], "lo": [first], "hi": [last], "n": [rows], "good": [good]})

    text = F.hex(key) if kind == "binary" else F.col(key).cast("string")
    code = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    marked = df.select(F.spark_partition_id().alias("part"), F.col(key).alias("key"))
    parts = marked.mapInPandas(ends, f"part int, lo {kind}, hi {kind}, n long, good boolean")
    # A row per partition is in the window.
    crossing = parts.withColumn("cross", F.coalesce(F.lag("hi").over(Window.orderBy("part")) > F.col("lo"), F.lit(False)))
    order = crossing.agg(F.coalesce(F.bool_and(F.col("good") & ~F.col("cross")), F.lit(True)).alias("sorted"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    return order.crossJoin(F.broadcast(df.agg(F.coalesce(F.sum(code), F.lit(0)).alias("checksum"))))


def is_sorted(df: DataFrame, key: str) -> DataFrame:
    """One row: whether every partition is in order and partitions follow one another."""
    return sort_check(df, key).select("sorted")
