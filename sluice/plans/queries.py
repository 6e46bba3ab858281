"""Every operator over the test tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, udf
from ..functions.time import micros
from ..operators import aggregate as agg
from ..operators import compute, joins, movement, sorting, windows
from ..sources import custom, files, sinks
from ..streaming import flows, stateful
from . import graph, iterate, ml
from .catalog import register


def t(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(col):
    """Exact sums: two decimals, so the order of addition doesn't show."""
    return F.sum(F.col(col).cast("decimal(18,2)")).cast("double")


# --- records ------------------------------------------------------------------------------------------------------


@register(
    "scan_filter_project",
    "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem "
    "WHERE l_quantity < 10 AND l_shipdate < TIMESTAMP '1995-01-01'",
)
def scan_filter_project(spark, d):
    rows = t(spark, d, "lineitem").where((F.col("l_quantity") < 10) & (F.col("l_shipdate") < F.expr("TIMESTAMP_NTZ'1995-01-01 00:00:00'")))
    return rows.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


@register(
    "flatmap_words",
    "SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> '' GROUP BY w",
)
def flatmap_words(spark, d):
    words = compute.flat_map(t(spark, d, "documents"), F.split("text", " "), "word").where("word <> ''")
    return agg.keyed_reduce(words, ["word"], n=("count", "word"))


@register("map_to_tuple", "SELECT o_custkey AS key, o_totalprice AS value FROM orders")
def map_to_tuple(spark, d):
    return compute.map_to_tuple(t(spark, d, "orders"), F.col("o_custkey"), F.col("o_totalprice"))


@register("map_udf_vector", "SELECT o_orderkey, o_orderkey * 2 + 1 AS odd FROM orders")
def map_udf_vector(spark, d):
    odd = udf.vector_udf(lambda s: s * 2 + 1, "long")
    return t(spark, d, "orders").select("o_orderkey", odd("o_orderkey").alias("odd"))


@register("compute_partition_collector", "SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderpriority")
def compute_partition_collector(spark, d):
    def counts(frames):
        total = None
        for f in frames:
            c = f["o_orderpriority"].value_counts()
            total = c if total is None else total.add(c, fill_value=0)
        if total is not None:
            yield total.astype("int64").rename("n").rename_axis("o_orderpriority").reset_index()

    partial = compute.compute_collect(t(spark, d, "orders").select("o_orderpriority"), counts, "o_orderpriority string, n long")
    return agg.keyed_reduce(partial, ["o_orderpriority"], n=("sum", "n"))


@register("compute_partition_single", "SELECT count(*) AS n, max(o_orderkey) AS top FROM orders")
def compute_partition_single(spark, d):
    def fold(frames):
        n, top = 0, None
        for f in frames:
            n += len(f)
            if len(f):
                top = int(f["o_orderkey"].max()) if top is None else max(top, int(f["o_orderkey"].max()))
        return {"n": n, "top": top}

    parts = compute.compute(t(spark, d, "orders").select("o_orderkey"), fold, "n long, top long")
    return agg.reduce(parts, n=("sum", "n"), top=("max", "top"))


@register("partition_aggregate", "SELECT count(*) AS n, max(o_orderkey) AS top FROM orders")
def partition_aggregate(spark, d):
    parts = compute.partition_aggregate(t(spark, d, "orders"), n=F.count("*"), top=F.max("o_orderkey"))
    return agg.reduce(parts, n=("sum", "n"), top=("max", "top"))


@register(
    "side_input_broadcast",
    "SELECT l_orderkey, l_linenumber, l_quantity > a.q AS above FROM lineitem, (SELECT avg(CAST(l_quantity AS DECIMAL(18,2))) AS q FROM lineitem) a",
)
def side_input_broadcast(spark, d):
    rows = t(spark, d, "lineitem")
    mean = rows.agg(F.avg(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("q"))
    return joins.side_input(rows, mean, 1).select("l_orderkey", "l_linenumber", (F.col("l_quantity") > F.col("q")).alias("above"))


@register("schema_change", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def schema_change(spark, d):
    return compute.with_schema(t(spark, d, "nation"), spark.createDataFrame([], "n_nationkey long, n_name string").schema)


# --- sources and sinks --------------------------------------------------------------------------------------------


@register("custom_source", "SELECT CAST(p * 100 + i AS BIGINT) AS id, p AS part FROM (SELECT unnest(range(4)) AS p), (SELECT unnest(range(100)) AS i)")
def custom_source(spark, d):
    return custom.custom(spark, "sluice_numbers", 4, lambda p: ((p * 100 + i, p) for i in range(100)), "id long, part long")


@register("parallelize_list", "SELECT CAST(unnest(range(50)) AS BIGINT) AS v")
def parallelize_list(spark, d):
    return files.parallelize(spark, [(i,) for i in range(50)], "v long", 4)


@register("parallelize_map", "SELECT 'k' || i AS key, CAST(i * i AS BIGINT) AS value FROM (SELECT unnest(range(20)) AS i)")
def parallelize_map(spark, d):
    return files.parallelize_map(spark, {f"k{i}": i * i for i in range(20)}, "key string, value long", n=2)


def _folder(tag: str, spark) -> str:
    """A new folder among those that all executors share."""
    return f"{iterate.shared_folder(spark)}/sluice-{tag}-{uuid.uuid4().hex}"


@register("csv_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark, d):
    nation, path = t(spark, d, "nation"), _folder("csv", spark)
    sinks.write_csv(nation, path)
    return files.csv(spark, path, nation.schema, header=True)


@register("csv_fields", "SELECT CAST(c_custkey AS VARCHAR) AS first, 2 AS fields FROM customer")
def csv_fields(spark, d):
    path = _folder("fields", spark)
    sinks.write_csv(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), path, header=False)
    return files.csv(spark, path).select(F.get("fields", F.lit(0)).alias("first"), F.size("fields").alias("fields"))


@register("text_round_trip", "SELECT r_name AS value FROM region")
def text_round_trip(spark, d):
    path = _folder("text", spark)
    sinks.write_text(t(spark, d, "region"), path, "r_name")
    return files.text(spark, path)


@register("arrow_round_trip", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def arrow_round_trip(spark, d):
    path = _folder("arrow", spark)
    rows = t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    written = sinks.write_arrow(rows, path)
    written.write.parquet(path + "-manifest")
    names = [f"{path}/{r['file']}" for r in spark.read.parquet(path + "-manifest").collect()]
    return custom.arrow(spark, names, rows.schema)


@register("persist_reload", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def persist_reload(spark, d):
    path = _folder("persist", spark)
    sinks.persist(agg.keyed_reduce(t(spark, d, "nation"), ["n_regionkey"], n=("count", "n_nationkey")), path)
    return sinks.persist(spark.range(0).select(F.raise_error(F.lit("computed again")).alias("n_regionkey")), path)


# --- movement -----------------------------------------------------------------------------------------------------


@register("partition_custom", "SELECT o_orderkey, CAST(o_orderkey % 4 AS INTEGER) AS part FROM orders")
def partition_custom(spark, d):
    return movement.partition(t(spark, d, "orders").select("o_orderkey"), F.col("o_orderkey") % 4, 4).select(
        "o_orderkey", F.spark_partition_id().alias("part")
    )


@register("keyed_partition", "SELECT o_custkey, 1 AS partitions FROM orders GROUP BY o_custkey")
def keyed_partition(spark, d):
    rows = movement.keyed_partition(t(spark, d, "orders").select("o_custkey"), "o_custkey")
    placed = rows.withColumn("p", F.spark_partition_id())
    return placed.groupBy("o_custkey").agg(F.countDistinct("p").cast("int").alias("partitions"))


@register("partition_load_balance", "SELECT CAST(4 AS BIGINT) AS partitions, true AS even, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders")
def partition_load_balance(spark, d):
    dealt = movement.load_balance(t(spark, d, "orders").select("o_orderkey"), 4)
    parts = dealt.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("total"))
    return parts.agg(F.count("*").alias("partitions"), (F.max("n") - F.min("n") <= 8).alias("even"), F.sum("n").alias("n"), F.sum("total").alias("total"))


@register("key_modulo", "SELECT c_custkey, CAST(c_custkey % 3 AS INTEGER) AS part FROM customer")
def key_modulo(spark, d):
    return movement.key_modulo(t(spark, d, "customer").select("c_custkey"), "c_custkey", 3).select("c_custkey", F.spark_partition_id().alias("part"))


@register("gather_indexed", "SELECT CAST(i AS BIGINT) AS id, CAST(i // 25 AS INTEGER) AS source, 0 AS receiver FROM (SELECT unnest(range(100)) AS i)")
def gather_indexed(spark, d):
    return movement.gather(files.generated(spark, 100, 4)).withColumn("receiver", F.spark_partition_id())


@register(
    "all_gather",
    "SELECT CAST(i AS BIGINT) AS id, CAST(i // 25 AS INTEGER) AS source, CAST(k AS INTEGER) AS target FROM (SELECT unnest(range(100)) AS i), (SELECT unnest(range(3)) AS k)",
)
def all_gather(spark, d):
    return movement.all_gather(files.generated(spark, 100, 4), 3)


@register("replicate_n", "SELECT n_nationkey, CAST(i AS INTEGER) AS copy FROM nation, (SELECT unnest(range(3)) AS i)")
def replicate_n(spark, d):
    return movement.replicate(t(spark, d, "nation").select("n_nationkey"), 3)


@register("union_two", "SELECT s_name AS name FROM supplier UNION ALL SELECT c_name FROM customer")
def union_two(spark, d):
    return movement.union(t(spark, d, "supplier").select(F.col("s_name").alias("name")), t(spark, d, "customer").select(F.col("c_name").alias("name")))


@register("union_many", "SELECT s_name AS name FROM supplier UNION ALL SELECT c_name FROM customer UNION ALL SELECT n_name FROM nation")
def union_many(spark, d):
    return movement.union(*[t(spark, d, n).select(F.col(c).alias("name")) for n, c in (("supplier", "s_name"), ("customer", "c_name"), ("nation", "n_name"))])


# --- joins --------------------------------------------------------------------------------------------------------


def _customers_orders(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    o = t(spark, d, "orders").select((F.col("o_custkey") + 20).alias("key"), F.col("o_orderkey").alias("value"))
    return c, o


_CO = "(SELECT c_custkey AS key, c_name AS value FROM customer) c {how} JOIN (SELECT o_custkey + 20 AS key, o_orderkey AS value FROM orders) o ON c.key = o.key"
for _how in ("inner", "left", "right", "full"):
    register(
        f"join_{_how}",
        f'SELECT coalesce(c.key, o.key) AS key, c.value AS "left", o.value AS "right" FROM ' + _CO.format(how=_how),
    )(lambda spark, d, how=_how: joins.keyed_join(*_customers_orders(spark, d), how))
    register(
        f"join_hash_{_how}",
        f'SELECT coalesce(c.key, o.key) AS key, c.value AS "left", o.value AS "right" FROM ' + _CO.format(how=_how),
    )(lambda spark, d, how=_how: joins.keyed_join(*_customers_orders(spark, d), how, "hash"))

_ORDER_LINES = "SELECT o_orderkey, l_linenumber, o_orderpriority FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


def _order_lines(spark, d, algorithm):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return joins.join(lines, o, "o_orderkey", algorithm=algorithm)


@register("join_hash_hint", _ORDER_LINES)
def join_hash_hint(spark, d):
    return _order_lines(spark, d, "hash")


@register("join_merge_hint", _ORDER_LINES)
def join_merge_hint(spark, d):
    return _order_lines(spark, d, "sort")


@register("join_salted", _ORDER_LINES)
def join_salted(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return joins.salted_join(lines, o, "o_orderkey", 4)


@register("join_many_to_many", "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey")
def join_many_to_many(spark, d):
    s = t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey")
    return joins.many_to_many_join(s, t(spark, d, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey"), "k").drop("k")


@register("row_join", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def row_join(spark, d):
    n = t(spark, d, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    return joins.join(n, t(spark, d, "region"), "r_regionkey").select("n_name", "r_name")


@register("join_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def join_semi(spark, d):
    return joins.join(t(spark, d, "customer").select("c_custkey"), t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "semi")


@register("join_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_anti(spark, d):
    return joins.join(t(spark, d, "customer").select("c_custkey"), t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "anti")


# --- aggregation --------------------------------------------------------------------------------------------------


@register("reduce_sum", "SELECT CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n FROM lineitem")
def reduce_sum(spark, d):
    return agg.reduce(t(spark, d, "lineitem"), total=money("l_quantity"), n=F.count("*"))


@register("all_reduce_max", "SELECT o_orderkey, o_totalprice, max(o_totalprice) OVER () AS top FROM orders")
def all_reduce_max(spark, d):
    return agg.all_reduce(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), top=("max", "o_totalprice"))


@register(
    "keyed_reduce_sum",
    "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, "
    "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price, count(*) AS n FROM lineitem "
    "WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus",
)
def keyed_reduce_sum(spark, d):
    rows = t(spark, d, "lineitem").where(F.col("l_shipdate") <= F.expr("TIMESTAMP_NTZ'1998-09-02 00:00:00'"))
    return agg.keyed_reduce(rows, ["l_returnflag", "l_linestatus"], sum_qty=money("l_quantity"), sum_price=money("l_extendedprice"), n=F.count("*"))


@register("keyed_reduce_min_max", "SELECT event_type, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def keyed_reduce_min_max(spark, d):
    return agg.keyed_reduce(t(spark, d, "events"), ["event_type"], low=("min", "value"), high=("max", "value"))


@register("keyed_reduce_product", "SELECT n_regionkey, round(product(n_nationkey + 1), 0) AS product FROM nation GROUP BY n_regionkey")
def keyed_reduce_product(spark, d):
    rows = t(spark, d, "nation").withColumn("v", F.col("n_nationkey") + 1)
    return agg.keyed_reduce(rows, ["n_regionkey"], product=F.round(F.product("v"), 0))


@register("keyed_reduce_opaque", "SELECT o_custkey, max(o_orderkey) AS top FROM orders GROUP BY o_custkey")
def keyed_reduce_opaque(spark, d):
    return udf.keyed_tree_reduce(t(spark, d, "orders"), "o_custkey", "o_orderkey", max, "long", "top")


@register("tree_reduce_opaque", "SELECT max(o_orderkey) AS top FROM orders")
def tree_reduce_opaque(spark, d):
    return udf.tree_reduce(t(spark, d, "orders"), "o_orderkey", max, "long", "top")


@register(
    "ordered_fold",
    "SELECT l_orderkey, list_reduce(list_prepend(0::BIGINT, list(l_partkey ORDER BY l_linenumber, l_partkey)), lambda s, x: (s * 31 + x) % 1000003) AS folded FROM lineitem GROUP BY l_orderkey",
)
def ordered_fold(spark, d):
    rows = t(spark, d, "lineitem")
    return agg.ordered_fold(rows, ["l_orderkey"], ["l_linenumber", "l_partkey"], "l_partkey", F.lit(0).cast("long"), lambda s, x: (s * 31 + x) % 1000003)


@register(
    "division",
    "SELECT l_orderkey, list_reduce(list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity), lambda s, x: s / x) AS quotient FROM lineitem GROUP BY l_orderkey",
)
def division(spark, d):
    return agg.division(t(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "l_quantity")


@register(
    "array_reduce_sum",
    "SELECT label, array_to_string(list(s ORDER BY i), ',') AS sums FROM (SELECT label, i, CAST(sum(CAST(round(e * 1000) AS BIGINT)) AS BIGINT) AS s FROM "
    "(SELECT label, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label",
)
def array_reduce_sum(spark, d):
    whole = t(spark, d, "embeddings").select("label", arrays.rounded("embedding", 1000).cast("array<long>").alias("v"))
    return agg.array_reduce(whole, "v", "sum", ["label"]).select("label", F.array_join(F.col("reduced").cast("array<string>"), ",").alias("sums"))


@register(
    "array_pair_max",
    "SELECT a.vec_id, list_max(list_transform(list_zip(a.embedding, b.embedding), lambda p: greatest(p[1], p[2]))) AS top "
    "FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id + 1",
)
def array_pair_max(spark, d):
    a = t(spark, d, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("other"))
    return joins.join(a, b, "vec_id").select("vec_id", F.array_max(arrays.array_max2("embedding", "other")).alias("top"))


@register("keyed_gather_sorted", "SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS orders FROM orders GROUP BY o_custkey")
def keyed_gather_sorted(spark, d):
    out = agg.keyed_gather(t(spark, d, "orders"), ["o_custkey"], "o_orderkey", "o_orderkey", "orders")
    return out.select("o_custkey", F.array_join(F.col("orders").cast("array<string>"), ",").alias("orders"))


@register("keyed_gather_ungrouped", "SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first, true AS adjacent, true AS ordered FROM orders GROUP BY o_custkey")
def keyed_gather_ungrouped(spark, d):
    """Rows of a key stand next to each other, in order: places within the partition tell."""
    rows = agg.keyed_gather_ungrouped(t(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])

    placed = rows.withColumn("at", F.monotonically_increasing_id())
    pairs = F.array_sort(F.collect_list(F.struct("at", "o_orderkey")))["o_orderkey"]
    adjacent = (F.max("at") - F.min("at") + 1 == F.count("*")).alias("adjacent")
    return placed.groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.min_by("o_orderkey", "at").alias("first"), adjacent, (pairs == F.array_sort(pairs)).alias("ordered")
    )


@register(
    "grouping_sets",
    "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
)
def grouping_sets(spark, d):
    return t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


# --- order and sets -----------------------------------------------------------------------------------------------


@register("global_sort_rank", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank FROM orders")
def global_sort_rank(spark, d):
    return sorting.global_rank(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", F.col("rank").cast("long"))


_CHECK = "true AS sorted, count(*) AS rows, CAST(sum(CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT)) AS BIGINT) AS checksum"


@register(
    "terasort_order_check",
    "SELECT " + _CHECK.format(key="k") + " FROM (SELECT upper(substr(sha256(l_orderkey || ':' || l_linenumber), 1, 20)) AS k FROM lineitem)",
)
def terasort_order_check(spark, d):
    rows = t(spark, d, "lineitem").select(F.unhex(F.substring(F.sha2(F.concat_ws(":", "l_orderkey", "l_linenumber"), 256), 1, 20)).alias("key"))
    return ml.terasort_check(ml.terasort(rows))


@register("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark, d):
    return sorting.top_k(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), 10, F.desc("o_totalprice"), "o_orderkey")


@register(
    "top_k_by_key",
    "SELECT c_nationkey, c_custkey, rank FROM (SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank FROM customer) WHERE rank <= 3",
)
def top_k_by_key(spark, d):
    return sorting.top_k_by_key(t(spark, d, "customer"), 3, ["c_nationkey"], F.desc("c_acctbal"), F.col("c_custkey")).select("c_nationkey", "c_custkey", "rank")


@register("distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def distinct(spark, d):
    return sorting.distinct(t(spark, d, "customer").select("c_mktsegment", "c_nationkey"))


@register("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark, d):
    return sorting.intersect(t(spark, d, "customer").select(F.col("c_nationkey").alias("k")), t(spark, d, "supplier").select("s_nationkey"))


@register("difference", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def difference(spark, d):
    return sorting.difference(t(spark, d, "customer").select(F.col("c_nationkey").alias("k")), t(spark, d, "supplier").select("s_nationkey"))


# --- windows ------------------------------------------------------------------------------------------------------

_RN = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"


@register(
    "count_window_tumbling",
    f"SELECT user_id, w AS window_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM (SELECT *, (rn - 1) // 5 AS w FROM {_RN}) "
    "GROUP BY user_id, w HAVING count(*) = 5",
)
def count_window_tumbling(spark, d):
    rows = windows.tumbling_count(t(spark, d, "events"), 5, ["ts", "event_id"], ["user_id"])
    return rows.groupBy("user_id", "window_id").agg(money("value").alias("total"))


@register(
    "count_window_sliding",
    "SELECT user_id, CAST(rn // 2 AS BIGINT) AS window_id, event_id, n, CAST(total AS DOUBLE) AS total FROM (SELECT user_id, rn, event_id, "
    "count(*) OVER w AS n, sum(CAST(value AS DECIMAL(18,2))) OVER w AS total FROM " + _RN + " WINDOW w AS (PARTITION BY user_id ORDER BY rn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE rn % 2 = 0",
)
def count_window_sliding(spark, d):
    total = F.sum(F.col("value").cast("decimal(18,2)"))
    out = windows.sliding_count(t(spark, d, "events"), 5, 2, ["ts", "event_id"], {"n": F.count("*"), "total": total}, ["user_id"], ["event_id"])
    return out.withColumn("total", F.col("total").cast("double"))


_HOUR = 3_600_000_000


@register(
    "event_time_tumbling",
    f"SELECT CAST(ceil(epoch_us(ts) / {_HOUR}.0) AS BIGINT) * {_HOUR} AS window_end, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1",
)
def event_time_tumbling(spark, d):
    rows = windows.event_time(t(spark, d, "events"), "ts", "1 hour")
    return rows.groupBy(micros(rows, "window_end").alias("window_end")).agg(F.count("*").alias("n"), money("value").alias("total"))


@register(
    "event_time_sliding",
    f"SELECT (CAST(ceil(epoch_us(ts) / {_HOUR}.0) AS BIGINT) + i) * {_HOUR} AS window_end, count(*) AS n FROM events, (SELECT unnest(range(3)) AS i) GROUP BY 1",
)
def event_time_sliding(spark, d):
    rows = windows.event_time(t(spark, d, "events"), "ts", "3 hours", "1 hour")
    return rows.groupBy(micros(rows, "window_end").alias("window_end")).agg(F.count("*").alias("n"))


@register(
    "event_count_window",
    "SELECT user_id, CAST(rn // 3 AS BIGINT) AS window_id, n FROM (SELECT user_id, rn, count(*) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS n FROM "
    "(SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE ts <= TIMESTAMP '2024-02-01')) WHERE rn % 3 = 0",
)
def event_count_window(spark, d):
    mark = F.expr("TIMESTAMP_NTZ'2024-02-01 00:00:00'")  # past the last event
    return windows.event_count(t(spark, d, "events"), 5, 3, "ts", ["event_id"], {"n": F.count("*")}, mark, ["user_id"])


@register(
    "window_reduce_fold",
    f"SELECT user_id, w AS window_id, list_reduce(list_prepend(0::BIGINT, list(event_id ORDER BY ts, event_id)), lambda s, x: (s * 7 + x) % 1000003) AS folded "
    f"FROM (SELECT *, (rn - 1) // 4 AS w FROM {_RN}) GROUP BY user_id, w HAVING count(*) = 4",
)
def window_reduce_fold(spark, d):
    rows = windows.tumbling_count(t(spark, d, "events"), 4, ["ts", "event_id"], ["user_id"])
    return agg.ordered_fold(rows, ["user_id", "window_id"], ["ts", "event_id"], "event_id", F.lit(0).cast("long"), lambda s, x: (s * 7 + x) % 1000003)


@register(
    "window_process",
    f"SELECT user_id, w AS window_id, max(value) - min(value) AS spread FROM (SELECT *, (rn - 1) // 4 AS w FROM {_RN}) GROUP BY user_id, w HAVING count(*) = 4",
)
def window_process(spark, d):
    rows = windows.tumbling_count(t(spark, d, "events"), 4, ["ts", "event_id"], ["user_id"]).select("user_id", "window_id", "value")

    def spread(key, rows):
        """As in SQL: nulls don't count, and NaN is above all numbers."""
        values = [v for (v,) in rows if v is not None]
        numbers = [v for v in values if v == v]
        top = max(numbers) if len(numbers) == len(values) and values else float("nan")
        yield *key, top - min(numbers, default=top) if values else None

    return agg.keyed_process(rows, ["user_id", "window_id"], spread, "user_id long, window_id long, spread double")


_DAY = 86_400_000_000


@register(
    "window_count_by_time",
    f"WITH r AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), "
    f"e AS (SELECT DISTINCT user_id, g.w * {_DAY} AS window_end FROM (SELECT user_id, CAST(ceil(min(us) / {_DAY}.0) AS BIGINT) AS lo FROM r GROUP BY user_id) b, "
    f"LATERAL (SELECT unnest(range(b.lo, 19754)) AS w) g) "
    f"SELECT user_id, window_end, CAST(rank AS INTEGER) AS rank, event_id FROM (SELECT e.user_id, e.window_end, r.rn AS rank, r.event_id, max(r.rn) OVER (PARTITION BY e.user_id, e.window_end) AS top "
    "FROM e JOIN r ON e.user_id = r.user_id AND r.us <= e.window_end) WHERE rank > top - 3",
)
def window_count_by_time(spark, d):
    """The last three events of each user at each midnight up to the watermark, 2024-02-01 00:00."""
    return windows.length_by_count_slide_by_time(t(spark, d, "events"), 3, _DAY, "ts", ["event_id"], "event_id", 19753 * _DAY, ["user_id"])


@register(
    "window_time_by_count",
    f"WITH r AS (SELECT user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) "
    f"SELECT a.user_id, CAST(a.rn AS INTEGER) AS window_id, count(*) AS n FROM r a JOIN r b ON a.user_id = b.user_id AND b.rn <= a.rn AND b.us > a.us - {_DAY} WHERE a.rn % 3 = 0 GROUP BY a.user_id, a.rn",
)
def window_time_by_count(spark, d):
    return windows.length_by_time_slide_by_count(t(spark, d, "events"), _DAY, 3, "ts", ["event_id"], {"n": F.count("*")}, ["user_id"])


_ARRIVAL = "(SELECT *, (event_id * 7919) % 1009 * 100000 + event_id AS seq FROM events)"


@register(
    "late_events",
    f"SELECT event_id, coalesce(epoch_us(ts) < max(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {_DAY}, false) AS is_late FROM {_ARRIVAL}",
)
def late_events(spark, d):
    rows = t(spark, d, "events").withColumn("seq", F.col("event_id") * 7919 % 1009 * 100000 + F.col("event_id"))
    return windows.late_rows(rows, "ts", "seq", _DAY, ["user_id"]).select("event_id", "is_late")


@register(
    "expired_events",
    f"WITH r AS {_RN}, f AS (SELECT user_id, count(*) // 2 AS fired FROM events GROUP BY user_id), "
    "m AS (SELECT user_id, event_id, (rn + 1) // 2 AS window_id, 'new' AS kind FROM r UNION ALL SELECT user_id, event_id, (rn + 5 + 1) // 2, 'expired' FROM r) "
    "SELECT m.user_id, CAST(window_id AS BIGINT) AS window_id, kind, event_id FROM m JOIN f USING (user_id) WHERE window_id <= fired",
)
def expired_events(spark, d):
    return windows.expired_rows(t(spark, d, "events"), 5, 2, ["ts", "event_id"], "event_id", ["user_id"])


@register(
    "session_windows",
    "WITH s AS (SELECT user_id, epoch_us(ts) AS us, value, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), "
    f"g AS (SELECT *, sum(CASE WHEN p IS NULL OR us >= p + 6 * {_HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS sid FROM s) "
    f"SELECT user_id, min(us) AS session_start, max(us) + 6 * {_HOUR} AS session_end, count(*) AS n FROM g GROUP BY user_id, sid",
)
def session_windows(spark, d):
    out = windows.session_windows(t(spark, d, "events"), "ts", "6 hours", ["user_id"], n=F.count("*"))
    return out.select("user_id", micros(out, "session_start").alias("session_start"), micros(out, "session_end").alias("session_end"), "n")


# --- streams ------------------------------------------------------------------------------------------------------


def _stream(spark, d, columns):
    """The events table as a stream, drained once."""
    schema = t(spark, d, "events").schema
    return flows.files(spark, f"{d}/events.parque[t]", schema).select(*columns)


def _drained(spark, stream, tag, mode="append"):
    """Run a stream over all that is there into files or, for running results, a table."""
    where = _folder(tag, spark)
    if mode == "append":
        flows.start(stream, "parquet", where + "-state", path=where).awaitTermination()
        return spark.read.schema(stream.schema).parquet(where)

    def keep(batch, _id):
        batch.write.mode("overwrite").parquet(where)

    flows.for_each_batch(stream, keep, where + "-state", mode).awaitTermination()
    return spark.read.schema(stream.schema).parquet(where)


@register("stream_keyed_reduce", "SELECT event_type, count(*) AS n, max(value) AS top FROM events GROUP BY event_type")
def stream_keyed_reduce(spark, d):
    stream = _stream(spark, d, ["event_type", "value"])
    return _drained(spark, flows.keyed_reduce(stream, ["event_type"], n=F.count("*"), top=F.max("value")), "stream-reduce", "complete")


@register(
    "stream_count_window",
    f"SELECT user_id, CAST(w AS BIGINT) AS window_id, array_to_string(list(CAST(event_id AS BIGINT) ORDER BY rn), ',') AS ids FROM (SELECT *, (rn - 1) // 4 + 1 AS w FROM "
    "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)) GROUP BY user_id, w HAVING count(*) = 4",
)
def stream_count_window(spark, d):
    stream = _stream(spark, d, ["user_id", "event_id"]).withColumn("seq", F.col("event_id"))
    out = _drained(spark, stateful.count_windows(stream, 4, value="event_id", key="user_id"), "stream-windows")
    return out.select("user_id", "window_id", F.array_join(F.col("values").cast("array<bigint>").cast("array<string>"), ",").alias("ids"))


@register(
    "stream_late_events",
    f"SELECT event_id, coalesce(epoch_us(ts) < max(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {_DAY}, false) AS is_late FROM {_ARRIVAL}",
)
def stream_late_events(spark, d):
    stream = _stream(spark, d, ["event_id", "ts", "user_id"]).withColumn("seq", F.col("event_id") * 7919 % 1009 * 100000 + F.col("event_id"))
    out = _drained(spark, stateful.late_rows(stream, "ts", "event_id", _DAY, key="user_id"), "stream-late")
    return out.select(F.col("value").cast("long").alias("event_id"), "is_late")


def _rounds(spark, stream, tag, fold=None):
    """The rounds of three sources that don't number their rows."""
    query, found = stateful.write_rounds(stream, "source", [0, 1, 2], "event_id", _folder(tag, spark), fold=fold)
    query.awaitTermination()
    return spark.read.schema("round long, values array<long>" if fold is None else "round long, value long").parquet(found)


@register(
    "stream_rounds",
    "SELECT CAST(rn - 1 AS BIGINT) AS round, CAST(sum(event_id) AS DOUBLE) AS value FROM (SELECT *, row_number() OVER (PARTITION BY event_id % 3 ORDER BY event_id) AS rn FROM events) GROUP BY rn HAVING count(*) = 3",
)
def stream_rounds(spark, d):
    stream = _stream(spark, d, [(F.col("event_id") % 3).alias("source"), "event_id"]).withColumn("seq", F.col("event_id"))
    return _rounds(spark, stream, "stream-rounds", lambda a, b: a + b)


# --- jobs ---------------------------------------------------------------------------------------------------------


@register("word_count", "SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+')) AS w FROM documents) WHERE w <> '' GROUP BY w")
def word_count(spark, d):
    return ml.word_count(t(spark, d, "documents"), "text")


@register(
    "kmeans_step",
    "WITH p AS (SELECT vec_id, list_transform(embedding, lambda v: round(v * 1000)::DOUBLE) AS x FROM embeddings), c AS (SELECT vec_id AS cluster, x FROM p WHERE vec_id < 4), "
    "d AS (SELECT p.vec_id, c.cluster, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p, c), "
    "a AS (SELECT vec_id, arg_min(cluster, struct_pack(d := d, k := cluster)) AS cluster FROM d GROUP BY vec_id), "
    "o AS (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) AS at FROM p), "
    "m AS (SELECT a.cluster, o.at, avg(o.v) AS v FROM a JOIN o USING (vec_id) GROUP BY a.cluster, o.at) "
    "SELECT o.vec_id AS cluster, CAST(o.at - 1 AS INTEGER) AS at, round(coalesce(m.v, o.v), 6) AS v FROM o LEFT JOIN m ON m.cluster = o.vec_id AND m.at = o.at WHERE o.vec_id < 4",
)
def kmeans_step(spark, d):
    """One step over whole vectors from the first four of them; a row per cluster and dimension."""
    points = t(spark, d, "embeddings").select("vec_id", arrays.rounded("embedding", 1000).cast("array<double>").alias("x"))
    centroids = points.where("vec_id < 4").select(F.col("vec_id").alias("cluster"), F.col("x").alias("c"))
    return ml.kmeans_step(points, centroids).select("cluster", F.posexplode("c").alias("at", "v")).withColumn("v", F.round("v", 6))


def _graph(spark, d):
    """Customers (even ids) and suppliers (odd ids), linked both ways where an order brought them together."""
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    pairs = t(spark, d, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey")
    ends = pairs.select((F.col("o_custkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b"), (F.col("o_orderkey") % 7 + 1).alias("w"))
    links = ends.groupBy("a", "b").agg(F.min("w").alias("w"))
    edges = links.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "w"), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))).alias("e"))
    customers, suppliers = t(spark, d, "customer").select((F.col("c_custkey") * 2).alias("id")), t(spark, d, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("id"))
    return customers.union(suppliers), edges.select("e.src", "e.dst", F.col("e.w").alias("weight"))


_LINKS = "l AS MATERIALIZED (SELECT o_custkey * 2 AS a, l_suppkey * 2 + 1 AS b, min(o_orderkey % 7 + 1) AS w FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"
_EDGES = f"{_LINKS}, e AS MATERIALIZED (SELECT a AS src, b AS dst, w AS weight FROM l UNION ALL SELECT b, a, w FROM l)"
_VERTICES = "v AS MATERIALIZED (SELECT c_custkey * 2 AS id FROM customer UNION ALL SELECT s_suppkey * 2 + 1 FROM supplier)"


def _rank_sql(rounds: int) -> str:
    sql = f"WITH {_EDGES}, {_VERTICES}, n AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM v), g AS MATERIALIZED (SELECT src, count(*) AS deg FROM e GROUP BY src), "
    sql += "r0 AS MATERIALIZED (SELECT id, 1 / n AS rank FROM v, n)"
    for k in range(rounds):
        sql += (
            f", s{k} AS (SELECT e.dst AS id, sum(r.rank / g.deg) AS s FROM r{k} r JOIN e ON r.id = e.src JOIN g ON g.src = e.src GROUP BY e.dst)"
            f", l{k} AS (SELECT coalesce(sum(rank), 0) AS lost FROM r{k} WHERE id NOT IN (SELECT src FROM g))"
            f", r{k + 1} AS MATERIALIZED (SELECT v.id, 0.15 / n.n + 0.85 * (coalesce(s{k}.s, 0) + l{k}.lost / n.n) AS rank FROM v LEFT JOIN s{k} ON v.id = s{k}.id CROSS JOIN l{k} CROSS JOIN n)"
        )
    return sql + f" SELECT CAST(id AS BIGINT) AS id, CAST(round(rank, 9) AS DOUBLE) AS rank FROM r{rounds}"


@register("pagerank_iter_k", _rank_sql(5))
def pagerank_iter_k(spark, d):
    vertices, edges = _graph(spark, d)
    return graph.pagerank(vertices, edges, 5).select("id", F.round("rank", 9).alias("rank"))


def _paths_sql(rounds: int) -> str:
    """Relaxation in so many rounds; the graph's shortest paths have far fewer edges."""
    sql = f"WITH {_EDGES}, {_VERTICES}, p0 AS MATERIALIZED (SELECT 1::BIGINT AS id, 0::BIGINT AS d)"
    for k in range(rounds):
        sql += f", p{k + 1} AS MATERIALIZED (SELECT id, min(d) AS d FROM (SELECT * FROM p{k} UNION ALL SELECT e.dst, p.d + e.weight FROM p{k} p JOIN e ON p.id = e.src) GROUP BY id)"
    return sql + f" SELECT CAST(v.id AS BIGINT) AS id, CAST(p.d AS BIGINT) AS distance FROM v LEFT JOIN p{rounds} p ON v.id = p.id"


@register("sssp", _paths_sql(16))
def sssp(spark, d):
    """From the first supplier to everyone."""
    vertices, edges = _graph(spark, d)
    return graph.shortest_paths(vertices, edges, 1)


@register("iterate_fixed", "SELECT n_nationkey, CAST(n_nationkey * 32 AS BIGINT) AS v FROM nation")
def iterate_fixed(spark, d):
    start = t(spark, d, "nation").select("n_nationkey", F.col("n_nationkey").cast("long").alias("v"))
    return iterate.iterate(start, lambda df, _k: df.withColumn("v", F.col("v") * 2), 5, every=2)


@register("connected_dataflow", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def connected_dataflow(spark, d):
    jobs = {
        "regions": lambda _i: t(spark, d, "region"),
        "nations": lambda _i: t(spark, d, "nation").withColumnRenamed("n_regionkey", "r_regionkey"),
        "counts": lambda i: joins.join(i["nations"], i["regions"], "r_regionkey").groupBy("r_name").agg(F.count("*").alias("n")),
    }
    return iterate.connected(jobs, {"counts": ["regions", "nations"]}, parallel=2)["counts"]


@register("svm_train")
def svm_train(spark, d):
    rows = t(spark, d, "embeddings").select(F.when(F.col("label") % 2 == 0, 1.0).otherwise(-1.0).alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    return ml.svm_accuracy(rows, ml.train_svm(rows, 0.01, 3))


@register("mds_generated", "SELECT CAST(1000 AS BIGINT) AS points, true AS recovered")
def mds_generated(spark, d):
    """A thousand points of a cube, of which only the distances are told; the root mean square of what the recovered distances are off is under 4 %."""
    place = lambda i, k: F.pmod(F.xxhash64(i, F.lit(k)), F.lit(10_000)) / 10_000.0
    between = lambda i, j: F.sqrt(sum(((place(i, k) - place(j, k)) * (place(i, k) - place(j, k)) for k in range(3)), F.lit(0.0)))
    every = F.sequence(F.lit(0).cast("long"), F.lit(999).cast("long"))
    matrix = files.generated(spark, 1000, 8, i=F.col("id"), d=F.transform(every, lambda j: between(F.col("id"), j)))
    x, stress = ml.mds(matrix, rounds=100, tolerance=1e-3)
    return spark.createDataFrame([(len(x), stress[-1] < 0.04**2)], "points long, recovered boolean")


# --- more of the same operators -------------------------------------------------------------------------------------


@register("direct_pipe", "SELECT r_regionkey, r_name FROM region")
def direct_pipe(spark, d):
    return movement.pipe(movement.direct(t(spark, d, "region")))


@register("cache_reuse", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def cache_reuse(spark, d):
    return sinks.lazy_cache(agg.keyed_reduce(t(spark, d, "nation"), ["n_regionkey"], n=("count", "n_nationkey")))


@register("text_complete", "SELECT r_name AS value, CAST(i AS INTEGER) AS task FROM region, (SELECT unnest(range(2)) AS i)")
def text_complete(spark, d):
    path = _folder("complete", spark)
    sinks.write_text(t(spark, d, "region"), path, "r_name")
    return files.text(spark, path, "complete", 2)


@register("generated_source", "SELECT CAST(i AS BIGINT) AS key, CAST(i * i AS BIGINT) AS value FROM (SELECT unnest(range(100)) AS i)")
def generated_source(spark, d):
    return files.keyed(files.generated(spark, 100, 4), F.col("id"), F.col("id") * F.col("id"))


@register("multi_output", "SELECT o_orderkey, o_orderstatus = 'F' AS done FROM orders")
def multi_output(spark, d):
    def mark(frame):
        frame["tag"] = frame["o_orderstatus"].eq("F").map({True: "done", False: "open"})
        return frame[["o_orderkey", "tag"]]

    out = compute.multi_output(t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), mark, "o_orderkey long, tag string", ["done", "open"])
    return movement.union(out["done"].withColumn("done", F.lit(True)), out["open"].withColumn("done", F.lit(False)))


@register("range_partition_sorted", "SELECT " + _CHECK.format(key="CAST(o_orderkey AS VARCHAR)") + " FROM orders")
def range_partition_sorted(spark, d):
    return sorting.sort_check(movement.range_partition(t(spark, d, "orders").select("o_orderkey"), "o_orderkey", n=5, sort=True), "o_orderkey")


@register(
    "source_rounds",
    "SELECT CAST(rn - 1 AS BIGINT) AS round, max(v) AS top FROM (SELECT o_custkey % 5 AS s, o_orderkey AS v, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderkey) AS rn FROM orders) GROUP BY rn HAVING count(*) = 5",
)
def source_rounds(spark, d):
    rows = t(spark, d, "orders").select((F.col("o_custkey") % 5).alias("s"), F.col("o_orderkey").alias("v"))
    numbered = movement.source_sequence(rows, "s", "v")
    return numbered.groupBy(F.col("seq").cast("long").alias("round")).agg(F.max("v").alias("top"), F.count("*").alias("n")).where("n = 5").drop("n")


@register("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_all(spark, d):
    return sorting.intersect(t(spark, d, "customer").select(F.col("c_nationkey").alias("k")), t(spark, d, "supplier").select("s_nationkey"), bag=True)


@register("subtract", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier")
def subtract(spark, d):
    return sorting.difference(t(spark, d, "nation").select(F.col("n_nationkey").alias("k")), t(spark, d, "supplier").select("s_nationkey"), bag=False)


@register("adjacency_text", f"WITH {_EDGES} SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, CAST(weight AS INTEGER) AS weight FROM e")
def adjacency_text(spark, d):
    _, edges = _graph(spark, d)
    lines = edges.groupBy("src").agg(F.concat_ws(" ", F.first("src"), F.flatten(F.collect_list(F.array("dst", "weight")).cast("array<array<string>>"))).alias("value"))
    return graph.adjacency_text(lines.select("value"), weighted=True)[1]


@register(
    "vertex_centric_degree",
    f"WITH {_EDGES}, {_VERTICES} SELECT CAST(v.id AS BIGINT) AS id, CAST(count(e.dst) AS BIGINT) AS value FROM v LEFT JOIN e ON v.id = e.dst GROUP BY v.id",
)
def vertex_centric_degree(spark, d):
    """One round of messages: how many edges arrive at each vertex."""
    vertices, edges = _graph(spark, d)
    start = vertices.withColumn("value", F.lit(0).cast("long"))
    return graph.vertex_centric(start, edges, F.lit(1).cast("long"), F.sum("message"), F.coalesce("incoming", F.lit(0)).cast("long"), 1)


@register("stream_union", "SELECT event_id FROM events")
def stream_union(spark, d):
    stream = _stream(spark, d, ["event_id"])
    return _drained(spark, movement.union(stream.where("event_id % 3 = 0"), stream.where("event_id % 3 <> 0")), "stream-union")


@register("stream_replicate", "SELECT event_id, CAST(i AS INTEGER) AS copy FROM events, (SELECT unnest(range(2)) AS i)")
def stream_replicate(spark, d):
    return _drained(spark, movement.replicate(_stream(spark, d, ["event_id"]), 2), "stream-replicate")


@register("stream_keyed_gather", "SELECT user_id, array_to_string(list(event_id ORDER BY event_id), ',') AS ids FROM events GROUP BY user_id")
def stream_keyed_gather(spark, d):
    out = _drained(spark, flows.keyed_gather(_stream(spark, d, ["user_id", "event_id"]), ["user_id"], "event_id"), "stream-gather", "complete")
    return out.select("user_id", F.array_join(F.array_sort("values").cast("array<string>"), ",").alias("ids"))


@register(
    "stream_gather_rounds",
    "SELECT CAST(rn - 1 AS BIGINT) AS round, array_to_string(list(event_id ORDER BY event_id % 3), ',') AS ids FROM (SELECT *, row_number() OVER (PARTITION BY event_id % 3 ORDER BY event_id) AS rn FROM events) GROUP BY rn HAVING count(*) = 3",
)
def stream_gather_rounds(spark, d):
    stream = _stream(spark, d, [(F.col("event_id") % 3).alias("source"), "event_id"]).withColumn("seq", F.col("event_id"))
    out = _rounds(spark, stream, "stream-gather-rounds")
    return out.select("round", F.array_join(F.col("values").cast("array<string>"), ",").alias("ids"))


@register(
    "stream_event_time",
    f"SELECT CAST(ceil(epoch_us(ts) / {_HOUR}.0) AS BIGINT) * {_HOUR} AS window_end, count(*) AS n FROM events GROUP BY 1",
)
def stream_event_time(spark, d):
    stream = _stream(spark, d, ["ts", "value"])
    out = _drained(spark, flows.event_time_windows(stream, "ts", "1 hour", lateness="1 hour", n=F.count("*")), "stream-time", "complete")
    return out.select(micros(out, "window_end").alias("window_end"), "n")


@register(
    "stream_event_count",
    "SELECT user_id, CAST(rn // 3 AS BIGINT) AS window_id, n FROM (SELECT user_id, rn, count(*) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS n FROM "
    "(SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)) WHERE rn % 3 = 0",
)
def stream_event_count(spark, d):
    stream = _stream(spark, d, ["user_id", "ts", "event_id"]).withColumn("seq", F.col("event_id"))
    out = _drained(spark, stateful.event_windows(stream, "ts", "event_id", length=5, slide=3, key="user_id"), "stream-count")
    return out.where("kind = 'window'").select("user_id", F.col("at").alias("window_id"), F.size("values").cast("long").alias("n"))


@register(
    "stream_word_count", "SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(event_type || ' ' || props, ' ')) AS w FROM events) WHERE w <> '' GROUP BY w"
)
def stream_word_count(spark, d):
    stream = _stream(spark, d, [F.concat_ws(" ", "event_type", "props").alias("value")])
    return _drained(spark, flows.word_count(stream), "stream-words", "complete")
