"""Queries of streams that are stopped and started again: several batches over one checkpoint, each with its SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import movement
from ..sources import sinks
from ..streaming import flows, stateful
from .catalog import register
from .queries import _DAY, _drained, _folder, _stream, t

_TYPES = ("click", "error", "purchase", "signup", "view")


def _restarted(spark, d, columns, build, tag, mode="append", parts=3, order=None):
    """``build`` a stream over the events, which arrive in ``parts`` by ``order`` (in [0, 1)); it is stopped after each part."""
    where = _folder(tag, spark)
    events = t(spark, d, "events")
    top = events.agg(F.max("event_id")).first()[0] or 0
    part = F.least(F.floor((order if order is not None else F.col("event_id") / (top + 1)) * parts), F.lit(parts - 1))
    schema = events.select(*columns).schema
    for k in range(parts):
        events.where(part == k).select(*columns).write.mode("append").parquet(f"{where}/in")
        stream = build(flows.files(spark, f"{where}/in", schema))
        if mode == "append":
            flows.start(stream, "parquet", f"{where}/state", path=f"{where}/out").awaitTermination()
        else:
            flows.for_each_batch(stream, lambda batch, _id: batch.write.mode("overwrite").parquet(f"{where}/out"), f"{where}/state", mode).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/out")


def _list(column):
    return F.array_join(F.col(column).cast("array<string>"), ",")


# --- sources, sinks and movement ----------------------------------------------------------------------------------------


@register("stream_map", "SELECT event_id * 2 + 1 AS odd, upper(event_type) AS kind FROM events WHERE value > 10")
def stream_map(spark, d):
    return _restarted(
        spark, d, ["event_id", "event_type", "value"], lambda s: s.where("value > 10").select((F.col("event_id") * 2 + 1).alias("odd"), F.upper("event_type").alias("kind")), "map"
    )


@register("stream_foreach_batch", "SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events")
def stream_foreach_batch(spark, d):
    """The function of a batch is a sink that is called again with the same id after a failure: it keeps sums by id."""
    sums = {}

    def keep(batch, at):
        sums[at] = tuple(batch.agg(F.count("*"), F.coalesce(F.sum("event_id"), F.lit(0))).first())

    flows.for_each_batch(_stream(spark, d, ["event_id"]), keep, _folder("batches", spark)).awaitTermination()
    return spark.createDataFrame([(sum(s[0] for s in sums.values()), sum(s[1] for s in sums.values()))], "n long, total long")


@register("stream_memory_sink", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_memory_sink(spark, d):
    counts = flows.keyed_reduce(_stream(spark, d, ["event_type"]), ["event_type"], n=F.count("*"))
    flows.start(counts, "memory", _folder("memory", spark), "complete", name="sluice_counts").awaitTermination()
    return spark.table("sluice_counts")


@register("stream_text", "SELECT n_name AS value FROM nation")
def stream_text(spark, d):
    path = _folder("text-stream", spark)
    sinks.write_text(t(spark, d, "nation"), path, "n_name")
    return _drained(spark, flows.files(spark, path, "value string", "text"), "text-out")


@register("stream_csv", "SELECT n_nationkey, n_name FROM nation")
def stream_csv(spark, d):
    path, nation = _folder("csv-stream", spark), t(spark, d, "nation").select("n_nationkey", "n_name")
    sinks.write_csv(nation, path, header=False)
    return _drained(spark, flows.files(spark, path, nation.schema, "csv"), "csv-out")


@register("stream_arrow", "SELECT o_orderkey, o_custkey FROM orders")
def stream_arrow(spark, d):
    path, orders = _folder("arrow-stream", spark), t(spark, d, "orders").select("o_orderkey", "o_custkey")
    sinks.write_arrow(orders, path).write.parquet(path + "-manifest")
    return _drained(spark, flows.arrow_files(spark, path, orders.schema), "arrow-out")


@register("stream_keyed_source", "SELECT CAST(i AS BIGINT) AS key, CAST(i * i AS BIGINT) AS value FROM (SELECT unnest(range(500)) AS i)")
def stream_keyed_source(spark, d):
    rows = flows.custom(spark, "sluice_squares", lambda i: (i, i * i) if i < 500 else None, "key long, value long", per_trigger=120)
    where = _folder("squares", spark)
    query = flows.start(rows, "parquet", where + "-state", path=where, once=False)
    query.processAllAvailable()
    query.stop()
    return spark.read.schema(rows.schema).parquet(where)


@register("stream_partition", "SELECT event_id, CAST(event_id % 4 AS INTEGER) AS part FROM events")
def stream_partition(spark, d):
    return _restarted(
        spark, d, ["event_id"], lambda s: movement.partition(s, F.col("event_id") % 4, 4).withColumn("part", F.spark_partition_id()), "partition"
    )


@register("stream_keyed_partition", "SELECT user_id, 1 AS partitions, count(*) AS n FROM events GROUP BY user_id")
def stream_keyed_partition(spark, d):
    """Equal keys go to one partition, in later batches too."""
    out = _restarted(spark, d, ["user_id"], lambda s: movement.keyed_partition(s, "user_id", n=4).withColumn("p", F.spark_partition_id()), "keyed-partition")
    return out.groupBy("user_id").agg(F.countDistinct("p").cast("int").alias("partitions"), F.count("*").alias("n"))


@register("stream_keyed_direct", "SELECT user_id AS key, event_id AS value FROM events")
def stream_keyed_direct(spark, d):
    return _restarted(spark, d, ["user_id", "event_id"], lambda s: movement.keyed_direct(s).select(F.col("user_id").alias("key"), F.col("event_id").alias("value")), "keyed-direct")


@register("stream_table_partition", "SELECT user_id, 1 AS partitions FROM events GROUP BY user_id")
def stream_table_partition(spark, d):
    out = _restarted(
        spark, d, ["user_id", "event_id"], lambda s: movement.table_pipe(movement.table_partition(s, 0, 4)).withColumn("p", F.spark_partition_id()), "table-partition"
    )
    return out.groupBy("user_id").agg(F.countDistinct("p").cast("int").alias("partitions"))




def _sources():
    """Three sources that number their own rows."""
    return [(F.col("event_id") % 3).alias("source"), F.expr("event_id div 3").alias("number"), "event_id"]


_ROUNDS = "(SELECT event_id // 3 AS r, list(event_id ORDER BY event_id % 3) AS ids FROM events GROUP BY 1 HAVING count(*) = 3)"


@register("stream_all_reduce", f"SELECT CAST(r AS BIGINT) AS round, CAST(list_max(ids) AS BIGINT) AS value, CAST(i AS INTEGER) AS receiver FROM {_ROUNDS}, (SELECT unnest(range(3)) AS i)")
def stream_all_reduce(spark, d):
    return _restarted(spark, d, _sources(), lambda s: stateful.rounds(s, "source", [0, 1, 2], "event_id", fold=max, copies=3, number="number"), "all-reduce")


@register("stream_all_gather", f"SELECT CAST(r AS BIGINT) AS round, array_to_string(ids, ',') AS ids, CAST(i AS INTEGER) AS receiver FROM {_ROUNDS}, (SELECT unnest(range(2)) AS i)")
def stream_all_gather(spark, d):
    out = _restarted(spark, d, _sources(), lambda s: stateful.rounds(s, "source", [0, 1, 2], "event_id", copies=2, number="number"), "all-gather")
    return out.select("round", _list("values").alias("ids"), "receiver")


@register(
    "stream_gather_parts",
    "SELECT user_id, CAST(p AS BIGINT) AS part, array_to_string(list(event_id ORDER BY event_id), ',') AS ids FROM "
    "(SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 7 AS p FROM events) GROUP BY user_id, p HAVING count(*) = 7",
)
def stream_gather_parts(spark, d):
    out = _restarted(spark, d, ["user_id", "event_id"], lambda s: stateful.keyed_gather(s, "user_id", "event_id", 7, seq="event_id"), "gather-parts")
    return out.select("user_id", "part", _list("values").alias("ids"))


@register(
    "stream_join",
    "SELECT a.event_id AS click, b.event_id AS purchase FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' "
    "AND b.ts BETWEEN a.ts - INTERVAL 2 DAY AND a.ts + INTERVAL 2 DAY",
)
def stream_join(spark, d):
    def build(stream):
        stamped = stream.withColumn("at", F.to_timestamp_ltz(F.col("ts").cast("string")))
        clicks = stamped.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click"), F.col("at").alias("clicked"))
        bought = stamped.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), F.col("at").alias("paid"))
        return flows.join(clicks, bought, "user_id", "clicked", "paid", "2 days", "40 days").select("click", "purchase")

    return _restarted(spark, d, ["event_id", "user_id", "event_type", "ts"], build, "join")


# --- windows --------------------------------------------------------------------------------------------------------------

_RN = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)"


@register(
    "stream_sliding_count",
    f"SELECT a.user_id, CAST(a.rn // 2 AS BIGINT) AS window_id, array_to_string(list(b.event_id ORDER BY b.rn), ',') AS ids FROM {_RN} a JOIN {_RN} b "
    "ON a.user_id = b.user_id AND b.rn BETWEEN a.rn - 4 AND a.rn WHERE a.rn % 2 = 0 GROUP BY a.user_id, a.rn",
)
def stream_sliding_count(spark, d):
    out = _restarted(spark, d, ["user_id", "event_id"], lambda s: stateful.count_windows(s, 5, 2, value="event_id", seq="event_id", key="user_id"), "sliding")
    return out.select("user_id", "window_id", _list("values").alias("ids"))


@register(
    "stream_text_windows",
    f"SELECT user_id, CAST((rn - 1) // 3 + 1 AS BIGINT) AS window_id, array_to_string(list(event_type ORDER BY rn), ',') AS kinds FROM {_RN} GROUP BY user_id, (rn - 1) // 3 HAVING count(*) = 3",
)
def stream_text_windows(spark, d):
    """Windows over texts: values keep their type."""
    out = _restarted(spark, d, ["user_id", "event_id", "event_type"], lambda s: stateful.count_windows(s, 3, value="event_type", seq="event_id", key="user_id"), "texts")
    return out.select("user_id", "window_id", _list("values").alias("kinds"))


@register("stream_processing_tumbling", "SELECT count(*) AS n, true AS whole FROM events")
def stream_processing_tumbling(spark, d):
    """Windows of the clock: every row is in one."""
    out = _drained(spark, flows.processing_time_windows(_stream(spark, d, ["event_id"]), "10 seconds", n=F.count("*")), "processing", "complete")
    return out.agg(F.sum("n").alias("n"), F.bool_and(F.second("window_end") % 10 == 0).alias("whole"))


@register("stream_processing_sliding", "SELECT 3 * count(*) AS n, true AS whole FROM events")
def stream_processing_sliding(spark, d):
    """Windows of 30 seconds every 10: every row is in three."""
    out = _drained(spark, flows.processing_time_windows(_stream(spark, d, ["event_id"]), "30 seconds", "10 seconds", n=F.count("*")), "processing-sliding", "complete")
    return out.agg(F.sum("n").alias("n"), F.bool_and(F.second("window_end") % 10 == 0).alias("whole"))


_TOPS = ", ".join(f"max(CASE WHEN event_type = '{k}' THEN epoch_us(ts) END) OVER (ORDER BY event_id) AS t{i}" for i, k in enumerate(_TYPES))
_ALL = " AND ".join(f"t{i} IS NOT NULL" for i in range(len(_TYPES)))
_LEAST = f"least({', '.join(f't{i}' for i in range(len(_TYPES)))})"


@register("stream_watermark", f"SELECT DISTINCT {_LEAST} - 1000000 AS watermark FROM (SELECT event_id, {_TOPS} FROM events) WHERE {_ALL}")
def stream_watermark(spark, d):
    """The least of the five types' greatest times, less a second, whenever it grows."""
    return _restarted(spark, d, ["event_id", "event_type", "ts"], lambda s: stateful.watermark(s, "ts", "event_type", list(_TYPES), 1_000_000, seq="event_id"), "watermark")


_MIXED = "(event_id * 7919) % 1009"
_MARKED = (
    f"SELECT *, coalesce(us < max(us) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {_DAY}, false) AS late FROM "
    f"(SELECT user_id, event_id, epoch_us(ts) AS us, {_MIXED} * 1000000000000 + event_id AS seq FROM events)"
)


@register(
    "stream_lateness",
    f"WITH m AS ({_MARKED}), top AS (SELECT user_id, max(us) - {_DAY} AS mark FROM m GROUP BY user_id) "
    "SELECT user_id, 'late' AS kind, us AS at, CAST(1 AS BIGINT) AS n FROM m WHERE late "
    f"UNION ALL SELECT user_id, 'window', w, count(*) FROM (SELECT user_id, CAST(ceil(us / {_DAY}.0) AS BIGINT) * {_DAY} AS w FROM m WHERE NOT late) JOIN top USING (user_id) WHERE w <= mark GROUP BY user_id, w",
)
def stream_lateness(spark, d):
    """Days per user with a day of lateness, the events out of order; late rows come out by themselves."""

    def build(stream):
        mixed = F.col("event_id") * 7919 % 1009 * 1_000_000_000_000 + F.col("event_id")
        return stateful.windows_by(stream.withColumn("seq", mixed), stateful.WindowParams.tumbling_time(_DAY, lag_us=_DAY), "ts", "event_id", key="user_id")

    out = _restarted(spark, d, ["event_id", "user_id", "ts"], build, "lateness", order=F.expr(f"{_MIXED} / 1009"))
    return out.select("user_id", "kind", "at", F.size("values").cast("long").alias("n"))


@register(
    "stream_window_params",
    "SELECT user_id, CAST(rn // 3 AS BIGINT) AS at, array_to_string(ids, ',') AS ids FROM (SELECT user_id, rn, list(event_id) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ids "
    "FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)) WHERE rn % 3 = 0",
)
def stream_window_params(spark, d):
    params = stateful.WindowParams.sliding_count(5, 3)
    out = _restarted(spark, d, ["event_id", "user_id", "ts"], lambda s: stateful.windows_by(s, params, "ts", "event_id", seq="event_id", key="user_id"), "params")
    return out.where("kind = 'window'").select("user_id", "at", _list("values").alias("ids"))


@register("stream_global_window", f"SELECT user_id, CAST(rn // 10 AS BIGINT) AS firing, CAST(rn AS BIGINT) AS n, event_id AS last FROM {_RN} WHERE rn % 10 = 0")
def stream_global_window(spark, d):
    return _restarted(spark, d, ["user_id", "event_id"], lambda s: stateful.global_windows(s, "user_id", "event_id", 10, seq="event_id"), "global")


@register(
    "stream_custom_window",
    "SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER "
    "(PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM events) GROUP BY user_id, g HAVING max_by(event_type, event_id) = 'purchase'",
)
def stream_custom_window(spark, d):
    """A window of the user's own: it closes with a purchase, however many rows or hours that takes."""

    def step(key, frames, state):
        first, n = state.get if state.exists else (None, 0)
        out = []
        rows = pd.concat(list(frames)).sort_values("event_id", kind="stable")
        for at, kind in zip(rows["event_id"], rows["event_type"], strict=True):
            first, n = int(at) if first is None else first, n + 1
            if kind == "purchase":
                out.append((key[0], first, int(at), n))
                first, n = None, 0
        state.update((first, n))
        yield pd.DataFrame(out, columns=["user_id", "first", "last", "n"])

    schema = "user_id long, first long, last long, n long"
    return _restarted(spark, d, ["user_id", "event_id", "event_type"], lambda s: stateful.custom(s, ["user_id"], step, schema, "first long, n long"), "custom-window")


@register("stream_resume", "SELECT event_type, count(*) AS n, max(event_id) AS top FROM events GROUP BY event_type")
def stream_resume(spark, d):
    """Running folds whose state is restored twice from the checkpoint."""
    return _restarted(
        spark, d, ["event_type", "event_id"], lambda s: flows.keyed_reduce(s, ["event_type"], n=F.count("*"), top=F.max("event_id")), "resume", "complete"
    )


@register("global_windows", f"SELECT user_id, CAST(rn // 10 AS BIGINT) AS firing, CAST(rn AS BIGINT) AS n, event_id AS last FROM {_RN} WHERE rn % 10 = 0")
def global_windows(spark, d):
    from ..operators import windows

    return windows.global_windows(t(spark, d, "events"), 10, ["event_id"], "event_id", ["user_id"])
