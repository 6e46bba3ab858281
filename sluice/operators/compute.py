"""Per-record and per-partition computation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """One row to one row, as column expressions."""
    return df.select(*[c.alias(n) for n, c in columns.items()])


def map_pandas(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """An opaque record function, applied to Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]):
        for frame in frames:
            yield fn(frame)

    return df.mapInPandas(run, schema)


def flat_map(df: DataFrame, items: Column, name: str = "item", keep: list[str] | None = None) -> DataFrame:
    """One row to 0..n rows: the elements of an array expression."""
    return df.select(*(keep or []), F.explode(items).alias(name))


def map_to_tuple(df: DataFrame, key: Column, value: Column) -> DataFrame:
    return df.select(key.alias("key"), value.alias("value"))


def compute(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], dict], schema) -> DataFrame:
    """A whole partition to one row; ``fn`` sees the partition as a stream of frames and must not hold them all."""

    def run(frames):
        yield pd.DataFrame([fn(frames)])

    return df.mapInPandas(run, schema)


def compute_collect(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema) -> DataFrame:
    """A whole partition to 0..n rows. Code before the first and after the last frame is the task's set-up and tear-down."""
    return df.mapInPandas(fn, schema)


compute_to_tuple = compute_collect


def partition_aggregate(df: DataFrame, **spec: Column) -> DataFrame:
    """One row per partition by built-in aggregates, without leaving the JVM."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(*[c.alias(n) for n, c in spec.items()])


def with_schema(df: DataFrame, schema) -> DataFrame:
    """Reorder and cast to a schema; columns that it doesn't name are dropped."""
    return df.to(schema)


def for_each(df: DataFrame, fn) -> None:
    """Eager: run the plan and call ``fn`` per row on the executors."""
    df.foreach(fn)


def lazy_for_each(df: DataFrame, fn) -> Callable[[], None]:
    """The plan with its function, to be run by calling the result."""
    return lambda: df.foreach(fn)


def task_context() -> dict:
    """Inside a function that runs in a task: its partition, attempt and stage."""
    from pyspark import TaskContext

    at = TaskContext.get()
    return {} if at is None else {"partition": at.partitionId(), "attempt": at.attemptNumber(), "stage": at.stageId(), "resources": at.resources()}


class Task:
    """A task with a life cycle, for ``run_task``: one instance lives in each partition.

    ``prepare`` gets the task's context, ``compute`` each Arrow batch as a frame, ``end`` follows the last one and ``close`` runs
    in any case. ``compute`` and ``end`` give out frames by ``write``, to a named edge where there are several.
    """

    def prepare(self, context: dict) -> None:
        pass

    def compute(self, frame: pd.DataFrame) -> None:
        raise NotImplementedError

    def end(self) -> None:
        pass

    def close(self) -> None:
        pass

    def write(self, frame: pd.DataFrame, edge: str = "") -> None:
        self.__dict__.setdefault("_written", []).append((edge, frame))


def run_task(df: DataFrame, task: Callable[[], Task], schema: str, edges: list[str] | None = None, edge: str = "__edge"):
    """Run ``task()`` in each partition: a frame, or with ``edges`` a dict of frames that share one pass, see ``release``."""

    def run(frames):
        own = task()
        own.prepare(task_context())

        def out():
            for to, frame in own.__dict__.pop("_written", []):
                yield frame.assign(**{edge: to}) if edges else frame

        try:
            for frame in frames:
                own.compute(frame)
                yield from out()
            own.end()
            yield from out()
        finally:
            own.close()

    if not edges:
        return df.mapInPandas(run, schema)
    whole = df.mapInPandas(run, f"{schema}, `{edge}` string").persist()
    outputs = {name: whole.where(F.col(edge) == name).drop(edge) for name in edges}
    _shared.extend((f, whole) for f in outputs.values())
    return outputs


def reduce_task(start: Callable[[], object], step: Callable[[object, pd.DataFrame], object], finish: Callable[[object], pd.DataFrame]) -> Callable[[], Task]:
    """A typed task: fold the frames of a partition and write the result at its end."""

    class Fold(Task):
        def prepare(self, context):
            self.state = start()

        def compute(self, frame):
            self.state = step(self.state, frame)

        def end(self):
            self.write(finish(self.state))

    return Fold


class Gang:
    """What a member of a gang knows of it: its rank, the gang's size, the members' addresses, and a collective."""

    def __init__(self):
        from pyspark import BarrierTaskContext

        self._task = BarrierTaskContext.get()
        self.rank = self._task.partitionId()
        self.addresses = [i.address for i in self._task.getTaskInfos()]
        self.size = len(self.addresses)

    def all_gather(self, message: str) -> list[str]:
        """Every member's message, by rank; waits for all."""
        return self._task.allGather(message)

    def barrier(self) -> None:
        self._task.barrier()


def run_gang(df: DataFrame, fn, schema, n: int) -> DataFrame:
    """``fn(gang, batches)`` in ``n`` tasks that start together, each over its Arrow batches: a hand-over to a program with
    collectives of its own, for instance data-parallel training. All fail and start again together. Needs ``n`` free slots; Spark
    polls for a collective about once a second, so members should share sums, not steps."""

    def run(batches):
        yield from fn(Gang(), batches)

    return df.repartition(n).mapInArrow(run, schema, barrier=True)


def multi_output(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, tags: list[str], tag: str = "tag") -> dict[str, DataFrame]:
    """One pass with several outputs: ``fn`` names each row's output in column ``tag``; the frames share a cached result.

    The cache spills to disk and is freed by ``release`` once the outputs have been used.
    """
    out = map_pandas(df, fn, schema).persist()
    outputs = {name: out.where(F.col(tag) == name).drop(tag) for name in tags}
    _shared.extend((f, out) for f in outputs.values())
    return outputs


_shared: list = []


def release(outputs: dict[str, DataFrame]) -> None:
    """Free the cached pass behind the outputs of ``multi_output`` or ``run_task``."""
    own = {id(f) for f in outputs.values()}
    for at in range(len(_shared) - 1, -1, -1):
        if id(_shared[at][0]) in own:
            _shared.pop(at)[1].unpersist()
