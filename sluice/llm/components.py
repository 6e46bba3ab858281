"""Connected components of an edge list, in DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node it is joined to by any path) of the nodes that are not the least of theirs."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while len(u):
        lower = np.minimum(label[u], label[v])
        new = label.copy()
        for end in (u, v):
            np.minimum.at(new, end, lower)
            np.minimum.at(new, label[end], lower)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def edge_batches(a: np.ndarray, b: np.ndarray):
    for at in range(0, len(a), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 100_000]), pa.array(b[at : at + 100_000])], names=["a", "b"])


def _contract(batches):
    parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if parts:
        yield from edge_batches(*forest(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])))


def connected_components(edges: DataFrame) -> DataFrame:
    """(a long, b long) to (node long, label long), the label being the least node reachable.

    First the edges are dealt out by their greater end and each partition keeps a spanning forest of its own. Then,
    round by round, each node looks at its neighbours' labels' labels; the least of them lowers the node's label and
    the label of the node's label, and labels are replaced by their own labels, until nothing changes. The rounds grow
    with the logarithm of the longest path. Aggregates are combined before each shuffle and the joins have one row a
    node on one side, so a node with many neighbours can be split. Lineage is cut each round by a written table. No
    edges give an empty table.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = edges.repartition("a").mapInArrow(_contract, "a long, b long").distinct()
    both = materialize(edges.union(edges.select("b", "a")).toDF("a", "b"), "cc-edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "cc-labels")
    while True:
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("grand"))
        grand = materialize(labels.join(up, "label").select("node", "label", "grand"), "cc-grand")
        near = both.join(grand, both.b == grand.node).groupBy("a").agg(F.min("grand").alias("near"))
        seen = materialize(grand.join(near, grand.node == near.a).select("node", "label", "grand", "near"), "cc-near")
        hooks = seen.groupBy(F.col("label").alias("root")).agg(F.min("near").alias("hook"))
        stepped = seen.join(hooks, seen.node == hooks.root, "left").select(
            "node", F.col("label").alias("old"), F.least("label", "grand", "near", "hook").alias("label")
        )
        stepped = materialize(stepped, "cc-labels")
        labels = stepped.select("node", "label")
        if stepped.where("old != label").isEmpty():
            return labels
