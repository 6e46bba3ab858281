"""User functions: the slow path, always over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vector_udf(fn: Callable[..., pd.Series], returns: str):
    """A scalar function over whole columns."""
    return F.pandas_udf(fn, returns)


def reduce_udf(fn: Callable[[float, float], float], returns: str = "double"):
    """A grouped aggregate from a two-argument function; a group's values must fit a task."""

    def run(values: pd.Series) -> float:
        items = iter(values)
        total = next(items, None)
        for x in items:
            total = fn(total, x)
        return total

    run.__annotations__ = {"values": pd.Series, "return": float}
    return F.pandas_udf(run, returns)


def tree_reduce(df: DataFrame, column: str, fn, returns: str = "double", name: str = "reduced") -> DataFrame:
    """Fold a column with an opaque associative, commutative function: first within partitions, then over their results.

    Only the partitions' results, a row each, are shuffled to the one task of the last fold.
    """

    def fold(frames):
        total, seen = None, False
        for frame in frames:
            for x in frame.iloc[:, 0]:
                total, seen = (fn(total, x), True) if seen else (x, True)
        if seen:
            yield pd.DataFrame({name: [total]})

    schema = f"`{name}` {returns}"
    partial = df.select(column).where(F.col(column).isNotNull()).mapInPandas(fold, schema)
    return partial.repartition(1).mapInPandas(fold, schema)


def keyed_tree_reduce(df: DataFrame, key: str, column: str, fn, returns: str = "double", name: str = "reduced", held_keys: int = 100_000) -> DataFrame:
    """``tree_reduce`` by key: keys are folded within each partition before the shuffle, so a hot key sends a row per task.

    The first fold hands on what it holds whenever that is ``held_keys`` keys; the second sees its keys in order and holds one.
    """
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, `{name}` {returns}"

    def table(held):
        return pd.DataFrame({key: list(held), name: list(held.values())})

    def first(frames):
        held: dict = {}
        for frame in frames:
            for k, x in zip(frame.iloc[:, 0], frame.iloc[:, 1], strict=True):
                held[k] = fn(held[k], x) if k in held else x
            if len(held) >= held_keys:
                yield table(held)
                held = {}
        if held:
            yield table(held)

    def second(frames):
        held: dict = {}
        for frame in frames:
            for k, x in zip(frame.iloc[:, 0], frame.iloc[:, 1], strict=True):
                held[k] = fn(held[k], x) if k in held else x
            if len(held) > 1:
                last = next(reversed(held))  # the key that may go on in the next frame
                rest = {last: held.pop(last)}
                yield table(held)
                held = rest
        if held:
            yield table(held)

    partial = df.select(key, column).where(F.col(column).isNotNull()).mapInPandas(first, schema)
    return partial.repartition(key).sortWithinPartitions(key).mapInPandas(second, schema)


def table_function(fn: Callable[..., object], returns: str):
    """A user-defined table function from a generator function of scalars: 0..n rows (tuples) per call.

    Register it with ``spark.udtf.register`` and call it with LATERAL, or apply it with ``flat_map_table``.
    """
    from pyspark.sql.functions import udtf

    class Rows:
        def eval(self, *values):
            yield from fn(*values)

    return udtf(Rows, returnType=returns)


def flat_map_table(df: DataFrame, fn, returns: str, arguments: list[str], name: str = "sluice_rows") -> DataFrame:
    """Each row of ``df`` with each row of the table function of its columns ``arguments``."""
    spark = df.sparkSession
    spark.udtf.register(name, table_function(fn, returns))
    df.createOrReplaceTempView(f"{name}_input")
    return spark.sql(f"SELECT i.*, f.* FROM {name}_input i, LATERAL {name}({', '.join(f'i.`{a}`' for a in arguments)}) f")
