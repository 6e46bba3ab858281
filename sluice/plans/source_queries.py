"""Queries of sources, sinks, actions, partitioners, tasks, comparators and scalar functions, each with its SQL."""

from __future__ import annotations

import json

import pyarrow.fs as pafs
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import udf
from ..operators import compute, joins, movement, sorting
from ..sources import custom, files, sinks
from . import iterate
from .catalog import register
from .queries import _folder, t

_TEXT_FORMAT = ("org.apache.hadoop.mapreduce.lib.input.TextInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text")
_LINE = "lpad(CAST(c_custkey AS VARCHAR), 9, '0')"


def _lines(spark, d) -> str:
    """Customer keys as text lines of nine digits."""
    path = _folder("lines", spark)
    sinks.write_text(t(spark, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("line")), path, "line")
    return path


@register("hadoop_text", "SELECT r_name AS value FROM region")
def hadoop_text(spark, d):
    path = _folder("hadoop", spark)
    sinks.write_text(t(spark, d, "region"), path, "r_name")
    return files.hadoop(spark, path, *_TEXT_FORMAT, "key long, value string").select("value")


@register("hadoop_keyed", f"SELECT CAST(0 AS BIGINT) AS rest, {_LINE} AS value FROM customer")
def hadoop_keyed(spark, d):
    """Keys are the lines' offsets, multiples of ten here."""
    rows = files.hadoop(spark, _lines(spark, d), *_TEXT_FORMAT, "key long, value string")
    return files.keyed(rows, F.col("key"), F.col("value")).select((F.col("key") % 10).alias("rest"), "value")


@register("fixed_records", f"SELECT {_LINE} AS record FROM customer")
def fixed_records(spark, d):
    return files.fixed_records(spark, _lines(spark, d), 10).select(F.rtrim(F.translate(F.decode("record", "UTF-8"), "\n", "")).alias("record"))


@register("text_line_splits", f"SELECT {_LINE} AS value, true AS small FROM customer")
def text_line_splits(spark, d):
    rows = files.text_by_lines(spark, _lines(spark, d), 40)
    sizes = rows.groupBy("split").agg((F.count("*") <= 40).alias("small"), F.collect_list("value").alias("values"))
    return sizes.select(F.explode("values").alias("value"), "small")


@register("binary_files", f"SELECT CAST(10 * count(*) AS BIGINT) AS bytes FROM customer")
def binary_files(spark, d):
    return files.binary_files(spark, _lines(spark, d), "*.txt").agg(F.sum("length").alias("bytes"))


@register("sink_partitions", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders")
def sink_partitions(spark, d):
    n, total = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def add(rows):
        for row in rows:
            n.add(1)
            total.add(row[0])

    sinks.sink(t(spark, d, "orders").select("o_orderkey"), add)
    return spark.createDataFrame([(n.value, total.value)], "n long, total long")


@register("for_each_row", "SELECT count(*) AS eager, 2 * count(*) AS both FROM nation")
def for_each_row(spark, d):
    seen = spark.sparkContext.accumulator(0)
    nation = t(spark, d, "nation")
    later = compute.lazy_for_each(nation, lambda _row: seen.add(1))
    compute.for_each(nation, lambda _row: seen.add(1))
    eager = seen.value
    later()
    return spark.createDataFrame([(eager, seen.value)], "eager long, both long")


@register("custom_sink", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders")
def custom_sink(spark, d):
    """Each task's part counts once, when it is committed: only then the sums are written."""
    path = _folder("sums", spark)

    def write(_part, rows):
        n = total = 0
        for row in rows:
            n, total = n + 1, total + row[0]
        return n, total

    def commit(parts):
        fs, base = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/sums.json") as out:
            out.write(json.dumps({"n": sum(p[0] for p in parts), "total": sum(p[1] for p in parts)}).encode())

    custom.custom_sink(t(spark, d, "orders").select("o_orderkey"), "sluice_sums", write, commit)
    return spark.read.schema("n long, total long").json(path)


@register("get_data", "SELECT n_nationkey, n_name FROM nation")
def get_data(spark, d):
    stored = sinks.cache(t(spark, d, "nation").select("n_nationkey", "n_name"))
    rows = [tuple(r) for r in sinks.get_data(stored)]
    stored.unpersist()
    return spark.createDataFrame(rows, "n_nationkey int, n_name string" if dict(stored.dtypes)["n_nationkey"] == "int" else "n_nationkey bigint, n_name string")


@register("lazy_persist", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def lazy_persist(spark, d):
    later = sinks.lazy_persist(t(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n")), _folder("later", spark))
    later()
    return later()


@register("runtime_context", "SELECT count(*) AS n, true AS same FROM orders")
def runtime_context(spark, d):
    """What a task knows of itself agrees with the plan's partitions."""

    def told(frames):
        part = compute.task_context()["partition"]
        for f in frames:
            yield f.assign(told=part)

    rows = t(spark, d, "orders").select(F.spark_partition_id().alias("part")).mapInPandas(told, "part int, told int")
    return rows.agg(F.count("*").alias("n"), F.bool_and(F.col("part") == F.col("told")).alias("same"))


class _Halves(movement.Partitioner):
    """Even keys to the lower half of the destinations, odd ones to the upper half."""

    calls: list = []

    def prepare(self, sources, destinations):
        super().prepare(sources, destinations)
        self.calls = ["prepare"]

    def partition(self, df) -> Column:
        self.calls.append("partition")
        half = self.destinations // 2
        return F.col("o_orderkey") % 2 * half + F.pmod(F.xxhash64("o_orderkey"), F.lit(half))

    def commit(self):
        self.calls.append("commit")


@register("partitioner_contract", "SELECT o_orderkey, CAST(o_orderkey % 2 AS INTEGER) AS half, 'prepare partition commit' AS calls FROM orders")
def partitioner_contract(spark, d):
    own = _Halves()
    rows = movement.partition_with(t(spark, d, "orders").select("o_orderkey"), own, 4)
    return rows.select("o_orderkey", F.floor(F.spark_partition_id() / 2).cast("int").alias("half"), F.lit(" ".join(own.calls)).alias("calls"))


@register("one_to_one", "SELECT CAST(i AS BIGINT) AS id, CAST(i // 25 AS INTEGER) AS part FROM (SELECT unnest(range(100)) AS i)")
def one_to_one(spark, d):
    return movement.partition_with(files.generated(spark, 100, 4), movement.OneToOne(), 4).withColumn("part", F.spark_partition_id())


@register("table_partition", "SELECT o_custkey, count(*) AS n, 1 AS partitions FROM orders GROUP BY o_custkey")
def table_partition(spark, d):
    rows = movement.table_pipe(movement.table_partition(t(spark, d, "orders").select("o_custkey", "o_orderkey"), 0, 6))
    placed = rows.withColumn("p", F.spark_partition_id())
    return placed.groupBy("o_custkey").agg(F.count("*").alias("n"), F.countDistinct("p").cast("int").alias("partitions"))


@register("join_disk", "SELECT l_orderkey AS key, l_linenumber AS left, o_custkey AS right FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def join_disk(spark, d):
    """The join for sides beyond memory: both sorted, which spills, then merged."""
    left = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("value"))
    return joins.keyed_join(left, t(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("value")), "inner", "sort")


@register("sort_by_comparator", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey % 10 DESC, length(o_orderpriority), o_orderkey) AS rank FROM orders")
def sort_by_comparator(spark, d):
    """A comparator as derived keys."""
    keys = [F.desc(F.col("o_orderkey") % 10), F.length("o_orderpriority"), F.col("o_orderkey")]
    rows = t(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return sorting.global_rank(rows, keys).select("o_orderkey", F.col("rank").cast("long"))


@register(
    "scalar_functions",
    "SELECT o_orderkey, upper(o_orderpriority) AS u, length(o_orderpriority) AS n, substr(o_orderpriority, 3) AS rest, year(o_orderdate) AS y, month(o_orderdate) AS m, "
    "abs(o_custkey - 500) AS a, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS state, coalesce(nullif(o_orderstatus, 'O'), '-') AS s, "
    "CAST(ceil(o_totalprice / 1000) AS BIGINT) AS k, md5(o_orderpriority) AS h FROM orders",
)
def scalar_functions(spark, d):
    return t(spark, d, "orders").select(
        "o_orderkey",
        F.upper("o_orderpriority").alias("u"),
        F.length("o_orderpriority").cast("long").alias("n"),
        F.substr("o_orderpriority", F.lit(3)).alias("rest"),
        F.year("o_orderdate").cast("long").alias("y"),
        F.month("o_orderdate").cast("long").alias("m"),
        F.abs(F.col("o_custkey") - 500).alias("a"),
        F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("state"),
        F.coalesce(F.nullif("o_orderstatus", F.lit("O")), F.lit("-")).alias("s"),
        F.ceil(F.col("o_totalprice") / 1000).alias("k"),
        F.md5(F.col("o_orderpriority").cast("binary")).alias("h"),
    )


@register(
    "sql_windows",
    "SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS later, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS grade, "
    "first_value(o_orderkey) OVER w AS first, count(*) OVER w AS upto, ntile(3) OVER w AS third FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
)
def sql_windows(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return t(spark, d, "orders").select(
        "o_orderkey",
        F.lag("o_orderkey").over(w).alias("before"),
        F.lead("o_orderkey", 2).over(w).alias("later"),
        F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority")).cast("long").alias("grade"),
        F.first("o_orderkey").over(w).alias("first"),
        F.count("*").over(w).alias("upto"),
        F.ntile(3).over(w).cast("long").alias("third"),
    )


@register("table_function", "SELECT n_nationkey, CAST(i AS BIGINT) AS place, substr(n_name, i + 1, 1) AS letter FROM nation, LATERAL (SELECT unnest(range(length(n_name))) AS i)")
def table_function(spark, d):
    rows = t(spark, d, "nation").select("n_nationkey", "n_name")
    return udf.flat_map_table(rows, enumerate, "place bigint, letter string", ["n_name"], "sluice_letters").drop("n_name")


@register("task_lifecycle", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total, true AS prepared FROM orders")
def task_lifecycle(spark, d):
    import pandas as pd

    class Sums(compute.Task):
        def prepare(self, context):
            self.ready, self.n, self.total = "partition" in context, 0, 0

        def compute(self, frame):
            self.n, self.total = self.n + len(frame), self.total + int(frame["o_orderkey"].sum())

        def end(self):
            self.write(pd.DataFrame({"n": [self.n], "total": [self.total], "prepared": [self.ready]}))

    parts = compute.run_task(t(spark, d, "orders").select("o_orderkey"), Sums, "n long, total long, prepared boolean")
    return parts.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.bool_and("prepared").alias("prepared"))


@register("task_edges", "SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS edge FROM orders")
def task_edges(spark, d):
    class Split(compute.Task):
        def compute(self, frame):
            even = frame["o_custkey"] % 2 == 0
            self.write(frame.loc[even, ["o_orderkey"]], "even")
            self.write(frame.loc[~even, ["o_orderkey"]], "odd")

    out = compute.run_task(t(spark, d, "orders").select("o_orderkey", "o_custkey"), Split, "o_orderkey long", ["even", "odd"])
    result = iterate.cut(movement.union(*[f.withColumn("edge", F.lit(name)) for name, f in out.items()]))
    compute.release(out)
    return result


@register("task_typed_reduce", "SELECT max(o_totalprice) AS top FROM orders")
def task_typed_reduce(spark, d):
    import pandas as pd

    task = compute.reduce_task(lambda: None, lambda top, f: f["o_totalprice"].max() if top is None else max(top, f["o_totalprice"].max()), lambda top: pd.DataFrame({"top": [top]}))
    return compute.run_task(t(spark, d, "orders").select("o_totalprice"), task, "top double").agg(F.max("top").alias("top"))


@register("checkpoint_variables", "SELECT CAST(unnest([2, 4, 6]) AS BIGINT) AS round")
def checkpoint_variables(spark, d):
    """Three runs of one job, each of which goes on where the one before has committed."""
    path, seen = _folder("variables", spark), []
    for _ in range(3):
        state = iterate.Variables(spark, path)
        state.update("round", state.init("round", 0) + 2)
        state.commit()
        seen.append((iterate.Variables(spark, path).init("round", 0),))
    return spark.createDataFrame(seen, "round long")


@register(
    "gang_training",
    "SELECT CAST(i AS BIGINT) AS rank, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope FROM lineitem, (SELECT unnest(range(3)) AS i) GROUP BY i",
)
def gang_training(spark, d):
    """Data-parallel least squares of price over quantity: members sum up their Arrow batches, share the sums and solve alike."""
    import pyarrow as pa

    def train(gang, batches):
        sums = [0.0] * 5
        for b in batches:
            x, y = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k, v in enumerate((len(x), x.sum(), y.sum(), x @ x, x @ y)):
                sums[k] += float(v)
        n, x, y, xx, xy = (sum(v) for v in zip(*(json.loads(t) for t in gang.all_gather(json.dumps(sums))), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([gang.rank]), pa.array([int(n)]), pa.array([round((xy - x * y / n) / (xx - x * x / n), 3)])], names=["rank", "n", "slope"])

    rows = t(spark, d, "lineitem").select("l_quantity", "l_extendedprice")
    return iterate.cut(compute.run_gang(rows, train, "rank long, n long, slope double", 3))
