"""A graph of named tasks joined by operators: the builder, its connections and the options of their edges.

A task is a function of its inputs. Each input arrives over an edge, by the connection that the edge names (partition,
reduce, gather, join, ...), and ``build`` turns the whole into one lazy plan, so Catalyst sees through all tasks that are
plain DataFrame code. Nothing runs until an output is used. ``stream`` graphs take the connections that a stream has.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import aggregate, joins, movement

Function = Callable[[dict[str, DataFrame]], "DataFrame | dict[str, DataFrame]"]


@dataclass
class Edge:
    """One connection: its operator, where its rows come from, and its options."""

    kind: str
    sources: list[str]
    options: dict = field(default_factory=dict)
    name: str = ""
    disk: bool = False
    schema: object = None
    sort: list = field(default_factory=list)
    group: tuple | None = None

    def via_edge(self, name: str) -> Edge:
        """The name by which the task finds this input; the source's name otherwise."""
        self.name = name
        return self

    def with_schema(self, schema) -> Edge:
        """The types of the rows on this edge, as ``DataFrame.to`` takes them."""
        self.schema = schema
        return self

    def with_partitioner(self, partitioner: movement.Partitioner, n: int) -> Edge:
        self.options |= {"partitioner": partitioner, "n": n}
        return self

    def use_disk(self) -> Edge:
        """Keep the edge's rows on disk until they are used up."""
        self.disk = True
        return self

    def sort_by(self, *keys) -> Edge:
        """The rows of a partition in order of ``keys``, which may be any expressions: the comparator."""
        self.sort = list(keys)
        return self

    def group_by_key(self, keys: list[str], value: str, order: str | None = None) -> Edge:
        """One row per key with its values as an array."""
        self.group = (keys, value, order)
        return self

    def connect(self, frames: list[DataFrame]) -> DataFrame:
        out = CONNECTIONS[self.kind](*frames, **self.options)
        if self.group:
            out = aggregate.keyed_gather(out, self.group[0], self.group[1], self.group[2])
        if self.schema is not None:
            out = out.to(self.schema)
        if self.sort:
            out = out.sortWithinPartitions(*self.sort)
        return out.persist(StorageLevel.DISK_ONLY) if self.disk else out


def _partition(df: DataFrame, target: Column | None = None, n: int | None = None, partitioner: movement.Partitioner | None = None) -> DataFrame:
    if partitioner is not None:
        return movement.partition_with(df, partitioner, n)
    if target is None:
        return movement.hash_partition(df, *df.columns, n=n)  # as a partition edge without a function does
    return movement.partition(df, target, n)


def _keyed_partition(df: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    return movement.keyed_partition(df, *keys, n=n)


CONNECTIONS: dict[str, Callable[..., DataFrame]] = {
    "direct": movement.direct,
    "pipe": movement.pipe,
    "broadcast": lambda df, n: movement.replicate(df, n, "task"),
    "partition": _partition,
    "keyed_partition": _keyed_partition,
    "reduce": lambda df, **spec: aggregate.reduce(df, **spec),
    "all_reduce": lambda df, n, **spec: movement.replicate(aggregate.reduce(df, **spec), n, "task"),
    "keyed_reduce": lambda df, keys, **spec: aggregate.keyed_reduce(df, keys, **spec),
    "gather": movement.gather,
    "all_gather": lambda df, n: movement.all_gather(df, n, target="task"),
    "keyed_gather": lambda df, keys, value, order=None: aggregate.keyed_gather(df, keys, value, order),
    "union": movement.union,
    "join": lambda left, right, on, how="inner", algorithm=None: joins.join(left, right, on, how, algorithm),
}
#: What a stream has: joins of streams are ``streaming.flows.join``, and rounds are ``streaming.stateful.rounds``.
ON_STREAMS = {"direct", "pipe", "broadcast", "partition", "keyed_partition", "keyed_reduce", "union"}


class Compute:
    """A task of a builder; its connections each return the edge, for its options."""

    def __init__(self, name: str, fn: Function, mode: str):
        self.name, self.fn, self.mode, self.edges = name, fn, mode, []

    def _edge(self, kind: str, sources: list[str], **options) -> Edge:
        if self.mode == "stream" and kind not in ON_STREAMS:
            raise ValueError(f"a stream has no {kind} connection")
        self.edges.append(Edge(kind, sources, options))
        return self.edges[-1]

    def direct(self, source: str) -> Edge:
        return self._edge("direct", [source])

    def pipe(self, source: str) -> Edge:
        return self._edge("pipe", [source])

    def broadcast(self, source: str, n: int) -> Edge:
        """Every row to each of ``n`` tasks, numbered in column ``task``."""
        return self._edge("broadcast", [source], n=n)

    def partition(self, source: str, target: Column | None = None, n: int | None = None) -> Edge:
        """By a target expression, by a ``Partitioner`` (see ``Edge.with_partitioner``) or else by the hash of whole rows."""
        return self._edge("partition", [source], target=target, n=n)

    def keyed_partition(self, source: str, keys: list[str], n: int | None = None) -> Edge:
        return self._edge("keyed_partition", [source], keys=keys, n=n)

    def reduce(self, source: str, **spec) -> Edge:
        return self._edge("reduce", [source], **spec)

    def all_reduce(self, source: str, n: int, **spec) -> Edge:
        return self._edge("all_reduce", [source], n=n, **spec)

    def keyed_reduce(self, source: str, keys: list[str], **spec) -> Edge:
        return self._edge("keyed_reduce", [source], keys=keys, **spec)

    def gather(self, source: str) -> Edge:
        return self._edge("gather", [source])

    def all_gather(self, source: str, n: int) -> Edge:
        return self._edge("all_gather", [source], n=n)

    def keyed_gather(self, source: str, keys: list[str], value: str, order: str | None = None) -> Edge:
        return self._edge("keyed_gather", [source], keys=keys, value=value, order=order)

    def union(self, *sources: str) -> Edge:
        return self._edge("union", list(sources)).via_edge("+".join(sources))

    def join(self, left: str, right: str, on: str | list[str], how: str = "inner", algorithm: str | None = None) -> Edge:
        """Types and algorithms as in ``operators.joins``."""
        return self._edge("join", [left, right], on=on, how=how, algorithm=algorithm).via_edge(f"{left}+{right}")


class GraphBuilder:
    """Collects sources and tasks; ``build`` checks them and gives the graph."""

    def __init__(self, name: str = "graph", mode: str = "batch"):
        self.name, self.constraints = name, {}
        self.sources: dict[str, object] = {}
        self.tasks: dict[str, Compute] = {}
        self.set_mode(mode)

    def set_mode(self, mode: str) -> GraphBuilder:
        if mode not in ("batch", "stream"):
            raise ValueError("a graph's mode is batch or stream")
        self.mode = mode
        return self

    def add_constraint(self, name: str, value) -> GraphBuilder:
        """A Spark setting that holds while the graph runs, for instance its number of shuffle partitions."""
        self.constraints[name] = str(value)
        return self

    def _new(self, name: str) -> None:
        if name in self.sources or name in self.tasks:
            raise ValueError(f"there is a {name} already")

    def add_source(self, name: str, source: DataFrame | Callable[[], DataFrame]) -> GraphBuilder:
        self._new(name)
        self.sources[name] = source
        return self

    def add_compute(self, name: str, fn: Function | None = None) -> Compute:
        """``fn`` gets its inputs by edge name and returns a frame, or several by output name; without it the one input is the result."""
        self._new(name)
        self.tasks[name] = Compute(name, fn or (lambda inputs: next(iter(inputs.values()))), self.mode)
        return self.tasks[name]

    def build(self) -> Graph:
        order, seen = [], set(self.sources)
        left = dict(self.tasks)
        for task in self.tasks.values():
            if not task.edges:
                raise ValueError(f"{task.name} has no input")
            for source in (s for e in task.edges for s in e.sources):
                if source.split(".")[0] not in self.sources and source.split(".")[0] not in self.tasks:
                    raise ValueError(f"{task.name} takes rows from {source}, which is not there")
        while left:
            ready = [n for n, t in left.items() if all(s.split(".")[0] in seen for e in t.edges for s in e.sources)]
            if not ready:
                raise ValueError(f"tasks wait for each other: {sorted(left)}")
            order += ready
            seen |= set(ready)
            for n in ready:
                del left[n]
        return Graph(self, order)


class Graph:
    """A built graph. A task's several outputs are named ``task.output``."""

    def __init__(self, builder: GraphBuilder, order: list[str]):
        self.builder, self.order = builder, order
        self._kept: list[DataFrame] = []

    def run(self, inputs: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        """The frames of all tasks by name; ``inputs`` replace sources of those names."""
        frames: dict[str, DataFrame] = {}
        for name, source in {**self.builder.sources, **(inputs or {})}.items():
            frames[name] = source() if callable(source) else source
        for name in self.order:
            self._run_task(name, frames)
        return frames

    def run_one(self, name: str, inputs: dict[str, DataFrame] | None = None) -> DataFrame:
        """The frame of one task, with what leads to it and nothing else."""
        needed, todo = set(), [name.split(".")[0]]
        while todo:
            task = self.builder.tasks.get(at := todo.pop())
            if at not in needed:
                needed.add(at)
                todo += [s.split(".")[0] for e in (task.edges if task else []) for s in e.sources]
        frames = {n: f() if callable(f) else f for n, f in {**self.builder.sources, **(inputs or {})}.items() if n in needed}
        for n in self.order:
            if n in needed:
                self._run_task(n, frames)
        return frames[name]

    def _run_task(self, name: str, frames: dict[str, DataFrame]) -> None:
        task = self.builder.tasks[name]
        got = {}
        for edge in task.edges:
            got[edge.name or edge.sources[0]] = edge.connect([frames[s] for s in edge.sources])
            if edge.disk:
                self._kept.append(got[edge.name or edge.sources[0]])
        out = task.fn(got)
        if isinstance(out, dict):
            frames.update({f"{name}.{k}": f for k, f in out.items()})
        else:
            frames[name] = out

    def settings(self, spark) -> None:
        """Put the builder's constraints into force."""
        for key, value in self.builder.constraints.items():
            spark.conf.set(key, value)

    def close(self) -> None:
        """Free what edges keep on disk."""
        while self._kept:
            self._kept.pop().unpersist()


class TopologyBuilder:
    """Spouts and bolts: a stream graph whose connections are called groupings."""

    def __init__(self, name: str = "topology"):
        self.builder = GraphBuilder(name, "stream")

    def set_spout(self, name: str, stream: DataFrame | Callable[[], DataFrame]) -> TopologyBuilder:
        self.builder.add_source(name, stream)
        return self

    def set_bolt(self, name: str, fn: Callable[[DataFrame], DataFrame]) -> Bolt:
        """``fn`` gets the union of the bolt's inputs, for instance one of ``streaming.stateful``'s windows as a windowed bolt."""

        def run(inputs):
            return fn(movement.union(*inputs.values()))

        return Bolt(self.builder.add_compute(name, run))

    def build(self) -> Graph:
        return self.builder.build()


class Bolt:
    """The groupings by which a bolt takes its rows; several may be named."""

    def __init__(self, task: Compute):
        self.task = task

    def fields_grouping(self, source: str, *fields: str, n: int | None = None) -> Bolt:
        self.task.keyed_partition(source, list(fields), n)
        return self

    def shuffle_grouping(self, source: str, n: int) -> Bolt:
        self.task.partition(source, F.floor(F.rand() * n), n)
        return self

    def all_grouping(self, source: str, n: int) -> Bolt:
        self.task.broadcast(source, n)
        return self

    def direct_grouping(self, source: str, target: Column, n: int) -> Bolt:
        """The sender names the receiver."""
        self.task.partition(source, target, n)
        return self

    def global_grouping(self, source: str) -> Bolt:
        """All rows to one task."""
        self.task.partition(source, F.lit(0), 1)
        return self

    def local_or_shuffle_grouping(self, source: str) -> Bolt:
        self.task.direct(source)
        return self

    none_grouping = local_or_shuffle_grouping
