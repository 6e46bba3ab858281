"""Graphs as two frames: vertices (id, ...) and edges (src, dst, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .iterate import cut, iterate


def adjacency_text(lines: DataFrame, weighted: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) from lines "vertex nbr nbr ..." or, weighted, "vertex nbr weight nbr weight ..."; blank lines are skipped."""
    parts = lines.select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.element_at("p", 1) != "")
    rest = parts.select(F.element_at("p", 1).alias("src"), F.slice("p", F.lit(2), F.size("p")).alias("rest"))
    if weighted:
        pair = lambda i: F.struct(F.get("rest", i * 2).alias("dst"), F.get("rest", i * 2 + 1).cast("int").alias("weight"))
        pairs = F.transform(F.sequence(F.lit(0), (F.size("rest") / 2 - 1).cast("int")), pair)
        edges = rest.where(F.size("rest") >= 2).select("src", F.inline(pairs))
    else:
        edges = rest.select("src", F.explode("rest").alias("dst"), F.lit(1).alias("weight"))
    return rest.select(F.col("src").alias("id")).distinct(), edges


def vertex_centric(vertices: DataFrame, edges: DataFrame, message: Column, combine: Column, update: Column, rounds: int, changed: Column | None = None) -> DataFrame:
    """Rounds of messages along edges.

    ``vertices`` is (id, value). ``message`` uses ``value`` of the source and the edge's columns; ``combine`` aggregates
    ``message`` per target; ``update`` uses ``value`` and ``incoming`` (null without messages). With ``changed``, a
    condition on ``value`` and ``new``, only changed vertices send in the next round and no change ends the loop.
    """
    edges = edges.persist()
    state = cut(vertices.select("id", "value", F.lit(True).alias("active")))

    def step(state: DataFrame, _round: int) -> DataFrame:
        sent = state.where("active").join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), message.alias("message"))
        new = state.join(sent.groupBy("id").agg(combine.alias("incoming")), "id", "left").withColumn("new", update)
        active = F.lit(True) if changed is None else F.coalesce(changed, F.lit(False))
        return new.select("id", F.col("new").alias("value"), active.alias("active"))

    until = None if changed is None else (lambda _old, new: new.where("active").isEmpty())
    try:
        return iterate(state, step, rounds, every=1, until=until).select("id", "value")  # every round is written
    finally:
        edges.unpersist()


def pagerank(vertices: DataFrame, edges: DataFrame, rounds: int, damping: float = 0.85) -> DataFrame:
    """(id, rank) after fixed rounds from 1/N; the mass of vertices without out-edges is spread over all vertices.

    Edges carry their source's out-degree and are partitioned by source once; a round shuffles ranks and messages.
    """
    n = vertices.count()
    by_source = edges.select("src", "dst").repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "src").persist()
    degree = by_source.groupBy("src").agg(F.count("*").alias("degree"))  # in place, as the next join
    links = by_source.join(degree, "src").select("src", "dst", "degree").persist()
    state = vertices.join(degree, vertices.id == degree.src, "left").select("id", F.col("degree").isNull().alias("dangling"), F.lit(1.0 / max(n, 1)).alias("rank"))

    def step(state: DataFrame, _round: int) -> DataFrame:
        lost = F.broadcast(state.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost")))  # one row
        sent = state.join(links, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("degree")).alias("sum"))
        return state.join(sent, "id", "left").crossJoin(lost).select(
            "id", "dangling", ((1 - damping) / n + damping * (F.coalesce("sum", F.lit(0.0)) + F.col("lost") / n)).alias("rank")
        )

    # Each round reads its state twice (the lost mass, the messages), so lineage is cut every round.
    try:
        return iterate(cut(state), step, rounds, every=1).select("id", "rank")
    finally:
        links.unpersist()
        by_source.unpersist()


def shortest_paths(vertices: DataFrame, edges: DataFrame, source, max_rounds: int = 10_000) -> DataFrame:
    """(id, distance) from one source by relaxing along edges from changed vertices only; null where there is no path."""
    start = vertices.select("id", F.when(F.col("id") == F.lit(source), F.lit(0)).cast("long").alias("value"))
    out = vertex_centric(
        start,
        edges,
        message=F.col("value") + F.col("weight"),
        combine=F.min("message"),
        update=F.least("value", "incoming"),
        rounds=max_rounds,
        changed=~F.col("new").eqNullSafe(F.col("value")),
    )
    return out.withColumnRenamed("value", "distance")
