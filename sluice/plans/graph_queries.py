"""Queries of built graphs: each connection, the options of edges, connected graphs, topologies and portable pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files
from ..streaming import stateful
from . import dataflow, iterate, transforms
from .catalog import register
from .queries import _drained, _stream, money, t


def _graph(spark, d, connect, fn=None, table="orders", columns=("o_orderkey", "o_custkey")):
    """One task behind one connection of a table."""
    builder = dataflow.GraphBuilder("one")
    builder.add_source("rows", lambda: t(spark, d, table).select(*columns))
    connect(builder.add_compute("task", fn))
    return builder.build().run()["task"]


@register("graph_direct", "SELECT o_orderkey, o_custkey FROM orders")
def graph_direct(spark, d):
    return _graph(spark, d, lambda task: task.direct("rows"))


@register("graph_broadcast", "SELECT n_nationkey, CAST(i AS INTEGER) AS task FROM nation, (SELECT unnest(range(3)) AS i)")
def graph_broadcast(spark, d):
    return _graph(spark, d, lambda task: task.broadcast("rows", 3), table="nation", columns=["n_nationkey"])


@register("graph_partition", "SELECT o_orderkey, CAST(o_orderkey % 3 AS INTEGER) AS part FROM orders")
def graph_partition(spark, d):
    return _graph(spark, d, lambda task: task.partition("rows", F.col("o_orderkey") % 3, 3), lambda i: i["rows"].select("o_orderkey", F.spark_partition_id().alias("part")))


@register("graph_keyed_partition", "SELECT o_custkey, 1 AS partitions FROM orders GROUP BY o_custkey")
def graph_keyed_partition(spark, d):
    def spread(inputs):
        placed = inputs["rows"].withColumn("p", F.spark_partition_id())
        return placed.groupBy("o_custkey").agg(F.countDistinct("p").cast("int").alias("partitions"))

    return _graph(spark, d, lambda task: task.keyed_partition("rows", ["o_custkey"], 5), spread)


@register("graph_reduce", "SELECT count(*) AS n, max(o_orderkey) AS top FROM orders")
def graph_reduce(spark, d):
    return _graph(spark, d, lambda task: task.reduce("rows", n=("count", "o_orderkey"), top=("max", "o_orderkey")))


@register("graph_all_reduce", "SELECT max(o_orderkey) AS top, CAST(i AS INTEGER) AS task FROM orders, (SELECT unnest(range(4)) AS i) GROUP BY i")
def graph_all_reduce(spark, d):
    return _graph(spark, d, lambda task: task.all_reduce("rows", 4, top=("max", "o_orderkey")))


@register("graph_keyed_reduce", "SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY o_custkey")
def graph_keyed_reduce(spark, d):
    return _graph(spark, d, lambda task: task.keyed_reduce("rows", ["o_custkey"], n=("count", "o_totalprice"), total=money("o_totalprice")), columns=["o_custkey", "o_totalprice"])


@register("graph_gather", "SELECT CAST(i AS BIGINT) AS id, CAST(i // 20 AS INTEGER) AS source FROM (SELECT unnest(range(60)) AS i)")
def graph_gather(spark, d):
    builder = dataflow.GraphBuilder().add_source("rows", files.generated(spark, 60, 3))
    builder.add_compute("task").gather("rows")
    return builder.build().run_one("task")


@register("graph_all_gather", "SELECT CAST(i AS BIGINT) AS id, CAST(i // 20 AS INTEGER) AS source, CAST(k AS INTEGER) AS task FROM (SELECT unnest(range(60)) AS i), (SELECT unnest(range(2)) AS k)")
def graph_all_gather(spark, d):
    builder = dataflow.GraphBuilder().add_source("rows", files.generated(spark, 60, 3))
    builder.add_compute("task").all_gather("rows", 2)
    return builder.build().run_one("task")


@register("graph_keyed_gather", "SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS orders FROM orders GROUP BY o_custkey")
def graph_keyed_gather(spark, d):
    def joined(inputs):
        return inputs["rows"].select("o_custkey", F.array_join(F.col("values").cast("array<string>"), ",").alias("orders"))

    return _graph(spark, d, lambda task: task.keyed_gather("rows", ["o_custkey"], "o_orderkey", "o_orderkey"), joined)


_SIDES = "(SELECT c_custkey AS key, c_name AS name FROM customer) c {how} JOIN (SELECT o_custkey + 20 AS key, o_orderkey AS number FROM orders) o ON c.key = o.key"
for _how in ("inner", "left", "right", "full"):

    def _join(spark, d, how=_how):
        builder = dataflow.GraphBuilder(f"join-{how}")
        builder.add_source("customers", lambda: t(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")))
        builder.add_source("orders", lambda: t(spark, d, "orders").select((F.col("o_custkey") + 20).alias("key"), F.col("o_orderkey").alias("number")))
        builder.add_compute("task", lambda i: i["both"]).join("customers", "orders", "key", how, "sort").via_edge("both")
        return builder.build().run()["task"]

    register(f"graph_join_{_how}", "SELECT coalesce(c.key, o.key) AS key, c.name AS name, o.number AS number FROM " + _SIDES.format(how=_how))(_join)


@register("graph_edge_options", "SELECT o_custkey, CAST(list(o_orderkey ORDER BY o_orderkey)[1] AS VARCHAR) AS first, count(*) AS n, true AS ordered FROM orders GROUP BY o_custkey")
def graph_edge_options(spark, d):
    """Typed, sorted, grouped and kept on disk, over edges with names."""
    builder = dataflow.GraphBuilder("options").add_source("rows", lambda: t(spark, d, "orders").select("o_custkey", "o_orderkey"))
    task = builder.add_compute(
        "task",
        lambda i: i["grouped"].join(i["sorted"], "o_custkey").select("o_custkey", F.element_at("values", 1).cast("string").alias("first"), F.size("values").cast("long").alias("n"), "ordered"),
    )
    task.direct("rows").group_by_key(["o_custkey"], "o_orderkey", "o_orderkey").via_edge("grouped")
    task.direct("runs").via_edge("sorted")

    def check(inputs):
        def run(frames):
            last = None
            for f in frames:
                keys = list(zip(f["o_custkey"], f["o_orderkey"]))
                good = [a <= b for a, b in zip([last or keys[0], *keys], keys)] if keys else []
                last = keys[-1] if keys else last
                yield f.assign(good=good)[["o_custkey", "good"]]

        return inputs["rows"].mapInPandas(run, "o_custkey long, good boolean").groupBy("o_custkey").agg(F.bool_and("good").alias("ordered"))

    rows = builder.add_compute("runs", check).keyed_partition("rows", ["o_custkey"], 4)
    rows.sort_by("o_custkey", "o_orderkey").with_schema(t(spark, d, "orders").select("o_custkey", "o_orderkey").schema).use_disk()
    graph = builder.build()
    out = iterate.cut(graph.run_one("task"))
    graph.close()
    return out


@register("graph_outputs", "SELECT o_orderkey, 'small' AS kind FROM orders WHERE o_totalprice < 50000 UNION ALL SELECT o_orderkey, 'large' FROM orders WHERE o_totalprice >= 50000")
def graph_outputs(spark, d):
    """A task with two named outputs, which a union takes up again."""
    builder = dataflow.GraphBuilder("outputs").add_source("rows", lambda: t(spark, d, "orders").select("o_orderkey", "o_totalprice"))
    small = F.col("o_totalprice") < 50000
    split = builder.add_compute("split", lambda i: {n: i["rows"].where(c).select("o_orderkey", F.lit(n).alias("kind")) for n, c in (("small", small), ("large", ~small))})
    split.direct("rows")
    builder.add_compute("all").union("split.small", "split.large")
    return builder.build().run_one("all")


@register("graph_connected", "SELECT n_regionkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey")
def graph_connected(spark, d):
    """One graph's result is another's source, by name."""
    first = dataflow.GraphBuilder("first").add_source("customers", lambda: t(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey")))
    first.add_compute("counts").keyed_reduce("customers", ["n_nationkey"], c=F.count("*"))
    second = dataflow.GraphBuilder("second").add_source("counts", None).add_source("nations", lambda: t(spark, d, "nation").select("n_nationkey", "n_regionkey"))
    second.add_compute("named").join("counts", "nations", "n_nationkey")
    second.add_compute("regions").keyed_reduce("named", ["n_regionkey"], n=("sum", "c"))
    return second.build().run_one("regions", {"counts": first.build().run_one("counts")})


@register("graph_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def graph_stream(spark, d):
    builder = dataflow.GraphBuilder("stream", "stream").add_source("events", lambda: _stream(spark, d, ["event_type", "event_id"]))
    builder.add_compute("spread").keyed_partition("events", ["event_type"], 4)
    builder.add_compute("counts").keyed_reduce("spread", ["event_type"], n=F.count("*"))
    return _drained(spark, builder.build().run_one("counts"), "graph-stream", "complete")


@register("topology_groupings", "SELECT event_id, CAST(event_id % 3 AS INTEGER) AS task FROM events")
def topology_groupings(spark, d):
    """Shuffled to one bolt, dealt by a field to the next, named by the sender for the last."""
    topology = dataflow.TopologyBuilder().set_spout("events", lambda: _stream(spark, d, ["event_id", "user_id"]))
    topology.set_bolt("first", lambda df: df).shuffle_grouping("events", 4)
    topology.set_bolt("second", lambda df: df).fields_grouping("first", "user_id", n=4)
    topology.set_bolt("third", lambda df: df.select("event_id", F.spark_partition_id().alias("task"))).direct_grouping("second", F.col("event_id") % 3, 3)
    return _drained(spark, topology.build().run_one("third"), "topology")


@register("topology_all_grouping", "SELECT event_id, CAST(i AS INTEGER) AS task FROM events, (SELECT unnest(range(2)) AS i)")
def topology_all_grouping(spark, d):
    topology = dataflow.TopologyBuilder().set_spout("events", lambda: _stream(spark, d, ["event_id"]))
    topology.set_bolt("local", lambda df: df).local_or_shuffle_grouping("events")
    topology.set_bolt("all", lambda df: df).all_grouping("local", 2)
    return _drained(spark, topology.build().run_one("all"), "topology-all")


@register(
    "topology_windowed_bolt",
    "SELECT user_id, CAST(rn // 2 AS BIGINT) AS window_id, CAST(least(rn, 6) AS BIGINT) AS n FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn % 2 = 0",
)
def topology_windowed_bolt(spark, d):
    topology = dataflow.TopologyBuilder().set_spout("events", lambda: _stream(spark, d, ["event_id", "user_id", F.col("event_id").alias("seq")]))
    topology.set_bolt("windows", lambda df: stateful.count_windows(df, 6, 2, value="event_id", key="user_id")).fields_grouping("events", "user_id")
    out = _drained(spark, topology.build().run_one("windows"), "topology-window")
    return out.select("user_id", "window_id", F.size("values").cast("long").alias("n"))


@register(
    "topology_stateful_bolt",
    "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS seen FROM events",
)
def topology_stateful_bolt(spark, d):
    """A bolt with state of its own: how often it has seen the user."""
    import pandas as pd

    def count(key, frames, state):
        seen = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values("event_id", kind="stable")
        state.update((seen + len(rows),))
        yield rows.assign(seen=range(seen + 1, seen + 1 + len(rows)))[["user_id", "event_id", "seen"]]

    topology = dataflow.TopologyBuilder().set_spout("events", lambda: _stream(spark, d, ["event_id", "user_id"]))
    topology.set_bolt("counter", lambda df: stateful.custom(df, ["user_id"], count, "user_id long, event_id long, seen long", "seen long")).fields_grouping("events", "user_id")
    return _drained(spark, topology.build().run_one("counter"), "topology-state")


_DAY = 86_400_000_000


@register(
    "portable_pipeline",
    "WITH r AS (SELECT user_id, event_type, event_id, ts FROM events WHERE event_type IN ('click', 'error')) "
    f"SELECT event_type, CAST(ceil(epoch_us(ts) / {_DAY}.0) AS BIGINT) * {_DAY} AS window_end, CAST(sum(event_id) AS BIGINT) AS total, count(*) AS n FROM r GROUP BY 1, 2",
)
def portable_pipeline(spark, d):
    """Read, a side input, two outputs of one pass, flatten, windows, grouping by key."""
    from ..functions.time import micros

    def route(frame, wanted):
        frame = frame[frame["event_type"].isin(set(wanted["event_type"]))]
        return frame.assign(tag=frame["event_type"] + "s")

    out = transforms.run(
        spark,
        [
            ("read", [], ["events"], {"source": lambda: t(spark, d, "events").select("event_id", "event_type", "ts")}),
            ("read", [], ["kinds"], {"source": lambda: spark.createDataFrame([("click",), ("error",)], "event_type string")}),
            ("view", ["kinds"], ["wanted"], {}),
            ("par_do", ["events"], ["clicks", "errors"], {"fn": route, "schema": "event_id long, event_type string, ts timestamp_ntz", "sides": ["wanted"]}),
            ("flatten", ["clicks", "errors"], ["both"], {}),
            ("assign_windows", ["both"], ["windowed"], {"ts": "ts", "length": "1 day"}),
            ("group_by_key", ["windowed"], ["grouped"], {"keys": ["event_type"], "value": "event_id"}),
        ],
    )["grouped"]
    total = F.aggregate("values", F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select("event_type", micros(out, "window_end").alias("window_end"), total.alias("total"), F.size("values").cast("long").alias("n"))
