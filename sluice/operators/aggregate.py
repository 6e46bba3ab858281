"""Reductions and groupings, global and by key."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Built-in reductions. Spark combines before the shuffle for each of them.
OPS: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "min": F.min, "max": F.max, "product": F.product, "count": F.count, "avg": F.avg}


def _measures(spec: dict[str, tuple[str, str] | Column]) -> list[Column]:
    """{'name': ('op', 'column')} or {'name': aggregate} as aliased aggregates."""
    return [(v if isinstance(v, Column) else OPS[v[0]](F.col(v[1]))).alias(k) for k, v in spec.items()]


def reduce(df: DataFrame, **spec) -> DataFrame:
    """Fold all rows to one: ``reduce(df, total=('sum', 'x'))``."""
    return df.agg(*_measures(spec))


def all_reduce(df: DataFrame, **spec) -> DataFrame:
    """``reduce`` with the result on every row of ``df``. The broadcast side is one row."""
    return df.crossJoin(F.broadcast(reduce(df, **spec)))


def keyed_reduce(df: DataFrame, keys: list[str], **spec) -> DataFrame:
    """Fold the rows of each key."""
    return df.groupBy(*keys).agg(*_measures(spec))


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], value: str, start: Column, step, name: str = "folded") -> DataFrame:
    """Fold values of each key in a stated order: for folds that are neither associative nor commutative.

    ``step`` maps two columns, the state and the value. The values of a key meet in one row, so a key must fit a task.
    """
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__value"))))
    folded = df.groupBy(*keys) if keys else df.groupBy()
    return folded.agg(items.alias("__items")).select(*keys, F.aggregate("__items", start, lambda s, x: step(s, x["__value"])).alias(name))


def division(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "quotient") -> DataFrame:
    """The first value of each key divided by all the others in turn; only defined with an order."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("__value"))))
    first = F.element_at("__items", 1)["__value"]
    rest = F.slice("__items", F.lit(2), F.greatest(F.size("__items") - 1, F.lit(0)))
    grouped = (df.groupBy(*keys) if keys else df.groupBy()).agg(items.alias("__items"))
    return grouped.select(*keys, F.aggregate(rest, first, lambda s, x: s / x["__value"]).alias(name))


def keyed_gather(df: DataFrame, keys: list[str], value: str, order: Column | str | None = None, name: str = "values") -> DataFrame:
    """All values of each key as an array, sorted by ``order`` (ties by value) when given.

    A group becomes one row; for groups that may not fit a task use ``keyed_gather_ungrouped``.
    """
    if order is None:
        return df.groupBy(*keys).agg(F.collect_list(value).alias(name))
    by = F.col(order) if isinstance(order, str) else order
    pairs = F.array_sort(F.collect_list(F.struct(by.alias("o"), F.col(value).alias("v"))))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda x: x["v"]).alias(name))


def keyed_gather_ungrouped(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of a key next to each other on one partition, in order: spills, and needs no row per group."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *(order or []))


def keyed_apply(df: DataFrame, keys: list[str], fn, schema) -> DataFrame:
    """An opaque function over each key's rows as a pandas frame: a cost of milliseconds a key, so for few large groups."""
    return df.groupBy(*keys).applyInPandas(fn, schema)


def keyed_process(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """An opaque function over each key's rows, for many small groups: ``fn(key, rows)`` yields rows; all are tuples.

    Groups are gathered in the JVM and reach Python by Arrow batches of many, where ``keyed_apply`` makes a frame for each.
    A key's rows, in no stated order, must fit a row.
    """
    values = [c for c in df.columns if c not in keys]
    kinds = StructType.fromDDL(schema)

    def run(batches):
        arrow = to_arrow_schema(kinds)
        for batch in batches:
            held = batch.column(len(keys))
            opened, ends = held.flatten(), held.offsets.to_pylist()
            columns = [opened.field(i).to_pylist() for i in range(len(values))]
            rows, out, base = list(zip(*columns, strict=True)), [], ends[0]
            for i, key in enumerate(zip(*[batch.column(k).to_pylist() for k in range(len(keys))], strict=True)):
                out.extend(fn(key, rows[ends[i] - base : ends[i + 1] - base]))
            turned = list(zip(*out, strict=True)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(turned, arrow, strict=True)], schema=arrow)

    return df.groupBy(*keys).agg(F.collect_list(F.struct(*values)).alias("__rows")).mapInArrow(run, kinds)


def array_reduce(df: DataFrame, value: str, op: str = "sum", keys: list[str] | None = None, name: str = "reduced") -> DataFrame:
    """Element-wise reduction of equally long arrays, over all rows or by key.

    Arrays are opened by position and partially aggregated before the shuffle, so the traffic is one row per position
    and task. Arrays of different lengths raise an error at run time, also across tasks.
    """
    keys = keys or []
    lengths = F.size(value)
    opened = df.select(*keys, lengths.alias("__n"), F.posexplode(value).alias("__at", "__x"))
    by_place = opened.groupBy(*keys, "__at").agg(OPS[op](F.col("__x")).alias("__x"), F.min("__n").alias("__lo"), F.max("__n").alias("__hi"))
    whole = F.array_sort(F.collect_list(F.struct("__at", "__x")))
    out = by_place.groupBy(*keys).agg(whole.alias("__all"), F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"))
    same = F.when(F.col("__lo") == F.col("__hi"), F.col("__all")).otherwise(F.raise_error(F.lit("arrays of different lengths")).cast(out.schema["__all"].dataType))
    return out.select(*keys, F.transform(same, lambda x: x["__x"]).alias(name))
