"""Operators on small fixtures with known results."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sluice.functions import arrays, udf
from sluice.operators import aggregate, compute, joins, movement, sorting, windows
from sluice.plans import catalog, graph, iterate, ml
from sluice.sources import custom, files, sinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def staff(spark):
    employees = [(31, "Rafferty"), (33, "Jones"), (33, "Heisenberg"), (34, "Robinson"), (34, "Smith"), (None, "Williams")]
    departments = [(31, "Sales"), (33, "Engineering"), (34, "Clerical"), (35, "Marketing")]
    return spark.createDataFrame(employees, "key int, value string"), spark.createDataFrame(departments, "key int, value string")


INNER = [(31, "Rafferty", "Sales"), (33, "Heisenberg", "Engineering"), (33, "Jones", "Engineering"), (34, "Robinson", "Clerical"), (34, "Smith", "Clerical")]
EXTRA = {"inner": [], "left": [(None, "Williams", None)], "right": [(35, None, "Marketing")], "full": [(None, "Williams", None), (35, None, "Marketing")]}


@pytest.mark.parametrize("how", list(EXTRA))
@pytest.mark.parametrize("algorithm", [None, "sort", "hash"])
def test_joins_of_staff(staff, how, algorithm):
    assert rows(joins.keyed_join(*staff, how, algorithm)) == sorted(INNER + EXTRA[how], key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "full"])
def test_join_algorithms_agree_on_random_keys(spark, how):
    rng = random.Random(7)
    l, r = ([(rng.randrange(100), i) for i in range(1000)] for _ in "lr")  # noqa: E741
    a, b = spark.createDataFrame(l, "key int, value int"), spark.createDataFrame(r, "key int, value int")
    by_sort, by_hash = rows(joins.keyed_join(a, b, how, "sort")), rows(joins.keyed_join(a, b, how, "hash"))
    groups = defaultdict(list)
    for k, v in r:
        groups[k].append(v)
    assert by_sort == by_hash
    if how == "inner":
        assert by_sort == sorted(((k, v, w) for k, v in l for w in groups[k]), key=repr)
        assert rows(joins.salted_join(a.toDF("key", "l"), b.toDF("key", "r"), "key", 3)) == by_sort


def test_join_of_odd_and_even_keeps_all_pairs(spark):
    df = spark.range(10).select((F.col("id") % 2).alias("key"), F.col("id").alias("value"))
    assert joins.keyed_join(df, df).count() == 50


def test_salted_right_join_is_refused(staff):
    with pytest.raises(ValueError):
        joins.salted_join(*staff, "key", 2, "right")


def test_many_to_many_join_is_dealt_out_by_its_pairs(spark, tmp_path):
    left = spark.createDataFrame([(1, i) for i in range(90)] + [(2, 0), (None, 1), (3, 7)], "k long, l long")
    right = spark.createDataFrame([(1, i) for i in range(70)] + [(2, 5), (2, 6), (None, 2), (4, 8)], "k long, r long")
    out = joins.many_to_many_join(left, right, "k", block=16, pairs_per_task=500)
    assert out.columns == ["k", "l", "r"]
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, joins.join(left, right, "k").collect()))
    assert joins.many_to_many_join(left.where("false"), right, "k").count() == 0
    # One key's pairs don't stay in one task.
    spark.range(3000).select(F.col("id").alias("s_suppkey"), F.lit(5).alias("s_nationkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(3000).select(F.col("id").alias("c_custkey"), F.lit(5).alias("c_nationkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    pairs = catalog.queries()["join_many_to_many"](spark, str(tmp_path))
    shares = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == 9_000_000 and max(shares) < 6_000_000, shares


def test_side_input_checks_its_size(spark):
    with pytest.raises(ValueError):
        joins.side_input(spark.range(3), spark.range(5).toDF("x"), 4)
    assert joins.side_input(spark.range(3), spark.range(4).toDF("x"), 4).count() == 12


def test_partition_takes_nulls_and_negative_targets(spark):
    df = spark.createDataFrame([(1, 5), (2, -1), (3, None)], "id int, t int")
    got = dict(movement.partition(df, F.col("t"), 3).select("id", F.spark_partition_id()).collect())
    assert got == {1: 2, 2: 2, 3: 0}


def test_movement(spark):
    df = spark.range(10)
    assert movement.gather(df).rdd.getNumPartitions() == 1
    assert movement.all_gather(df, 3).count() == 30
    assert movement.replicate(df, 0).count() == 0
    assert movement.union(df, df, df).count() == 30
    assert movement.key_modulo(spark.createDataFrame([("a",)], "k string"), "k", 4).select(F.spark_partition_id()).first()[0] == 0
    ranged = movement.range_partition(df, "id", n=3, sort=True)
    assert sorting.is_sorted(ranged, "id").first()[0]
    assert not sorting.is_sorted(df.orderBy(F.desc("id")), "id").first()[0]


def test_array_reduction(spark):
    ones = spark.range(40).select((F.col("id") % 2).alias("k"), F.array_repeat(F.lit(1), 5).alias("v"))
    assert aggregate.array_reduce(ones, "v").first()[0] == [40] * 5
    assert rows(aggregate.array_reduce(ones, "v", "sum", ["k"])) == [(0, [20] * 5), (1, [20] * 5)]
    uneven = spark.createDataFrame([([1, 2],), ([1],)], "v array<int>")
    with pytest.raises(Exception, match="different lengths"):
        aggregate.array_reduce(uneven, "v").collect()
    with pytest.raises(Exception, match="different lengths"):
        uneven.select(arrays.array_add("v", F.array(F.lit(1)))).collect()


def test_floats_are_rounded_as_in_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(3)
    near = [[(rng.randrange(-4000, 4000) + 0.5) / 1000 for _ in range(64)] for _ in range(200)]  # times 1000, at a half or next to one
    for kind in ("float", "double"):
        where = f"{tmp_path}/{kind}"
        frame = spark.createDataFrame([(i, v, i % 10) for i, v in enumerate(near)], f"vec_id long, embedding array<{kind}>, label int")
        frame.coalesce(1).write.parquet(f"{where}/embeddings.parquet")
        with duckdb.connect() as sql:
            sql.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{where}/embeddings.parquet/*.parquet'")
            for name in ("array_reduce_sum", "kmeans_step"):
                query = catalog.queries()[name](spark, where)
                columns = ", ".join(f'"{c}"' for c in query.columns)
                want = sql.execute(f"SELECT {columns} FROM ({catalog.oracle_sql()[name]})").fetchall()
                assert rows(query) == sorted(want, key=repr), (kind, name)


def test_small_groups_reach_python_many_at_once(spark, tmp_path):
    import duckdb

    pairs = spark.createDataFrame([(k, n, f"{k}{n}") for k in ("a", "b", None) for n in range(3)] + [("c", 0, None)], "k string, n int, t string")

    def both(key, group):
        yield *key, len(group), sorted(t for _, t in group if t)
        if key[0] == "a":
            yield None, sum(n for n, _ in group), None

    out = aggregate.keyed_process(pairs.select("t", "k", "n").select("n", "t", "k"), ["k"], both, "k string, n long, ts array<string>")
    assert rows(out) == sorted([("a", 3, ["a0", "a1", "a2"]), (None, 3, None), ("b", 3, ["b0", "b1", "b2"]), (None, 3, ["None0", "None1", "None2"]), ("c", 1, [])], key=repr)
    assert rows(aggregate.keyed_process(pairs.where("false"), ["k"], both, "k string, n long, ts array<string>")) == []

    rng = random.Random(5)
    odd = [None, float("nan"), float("inf"), float("-inf")]
    events = [(i, i // 7, i % 5, odd[i // 40 % 4] if rng.random() < (1.0 if i % 5 == 4 else 0.3) else rng.random()) for i in range(3000)]
    frame = spark.createDataFrame(events, "event_id long, s long, user_id long, value double").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    frame.drop("s").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    query = catalog.queries()["window_process"](spark, str(tmp_path))
    assert "InPandas" not in query._jdf.queryExecution().toString()  # a frame of pandas for each window
    with duckdb.connect() as sql:
        sql.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        want = sql.execute(catalog.oracle_sql()["window_process"]).fetchall()
    assert sorted(map(repr, map(tuple, query.collect()))) == sorted(map(repr, want)) and len(want) == 750


def test_array_keys_compare_by_content(spark):
    df = spark.createDataFrame([([1, 2], 1), ([1, 2], 2), ([2], 3)], "k array<int>, v int")
    assert rows(aggregate.keyed_reduce(df, ["k"], s=("sum", "v"))) == [([1, 2], 3), ([2], 3)]


def test_folds(spark):
    df = spark.createDataFrame([("a", 1, 8.0), ("a", 3, 2.0), ("a", 2, 2.0), ("b", 1, 5.0)], "k string, o int, v double")
    assert rows(aggregate.division(df, ["k"], ["o"], "v")) == [("a", 2.0), ("b", 5.0)]
    assert rows(aggregate.ordered_fold(df, ["k"], ["o"], "v", F.lit(0.0), lambda s, x: s * 10 + x)) == [("a", 822.0), ("b", 5.0)]
    assert rows(aggregate.keyed_gather(df, ["k"], "v", "o")) == [("a", [8.0, 2.0, 2.0]), ("b", [5.0])]
    assert udf.tree_reduce(df, "v", lambda a, b: a + b).first()[0] == 17.0
    assert udf.tree_reduce(df.limit(0), "v", lambda a, b: a + b).count() == 0
    assert df.groupBy("k").agg(udf.reduce_udf(max)("v").alias("m")).count() == 2


def test_ungrouped_gather_keeps_keys_together(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("k"), "id")
    parts = aggregate.keyed_gather_ungrouped(df, ["k"], ["id"]).withColumn("p", F.spark_partition_id()).collect()
    assert len({(r.k, r.p) for r in parts}) == 7


def test_rank_without_one_task(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("v"))
    ranks = sorting.global_rank(df, ["v"], parts=5).orderBy("v").collect()
    assert [r["rank"] for r in ranks] == list(range(1, 1001))


def seqs(df):
    return [r[0] for r in df.collect()]


def test_count_windows(spark):
    df = spark.range(8).toDF("seq")
    sliding = windows.sliding_count(df, 5, 2, ["seq"], {"lo": F.min("seq"), "hi": F.max("seq")})
    assert rows(sliding.select("lo", "hi")) == [(0, 1), (0, 3), (1, 5), (3, 7)]
    six = windows.tumbling_count(spark.range(7).toDF("seq"), 3, ["seq"])
    assert rows(six.groupBy("window_id").agg(F.min("seq"), F.max("seq"))) == [(0, 0, 2), (1, 3, 5)]
    moved = windows.expired_rows(df, 5, 2, ["seq"], "seq").groupBy("window_id", "kind").agg(F.sort_array(F.collect_list("seq")).alias("v"))
    got = {(r.window_id, r.kind): r.v for r in moved.collect()}
    assert got == {(1, "new"): [0, 1], (2, "new"): [2, 3], (3, "new"): [4, 5], (4, "new"): [6, 7], (3, "expired"): [0], (4, "expired"): [1, 2]}


EVENTS = [603, 605, 607, 618, 626, 636, 825, 826, 827, 839]


def timed(spark, stamps):
    df = spark.createDataFrame(list(enumerate(stamps)), "seq int, ms long")
    return df.withColumn("ts", F.timestamp_millis("ms"))


def test_event_time_windows_end_inclusive(spark):
    df = windows.event_time(timed(spark, EVENTS), "ts", "20 milliseconds", "10 milliseconds")
    got = df.groupBy(F.unix_millis("window_end").alias("end")).agg(F.sort_array(F.collect_list("seq")).alias("m"))
    by_end = {r["end"]: r.m for r in got.collect()}
    for end, members in {610: [0, 1, 2], 620: [0, 1, 2, 3], 630: [3, 4], 640: [4, 5], 650: [5], 830: [6, 7, 8]}.items():
        assert by_end[end] == members
    edge = windows.event_time(timed(spark, [610]), "ts", "20 milliseconds", "10 milliseconds")
    assert sorted(r[0] for r in edge.select(F.unix_millis("window_end")).collect()) == [610, 620]


def test_mixed_windows(spark):
    df = timed(spark, [603, 605, 607, 618, 626, 636, 665, 666, 667, 679])
    out = windows.length_by_count_slide_by_time(df, 3, 10_000, "ts", ["seq"], "seq", 674_000)
    got = out.groupBy("window_end").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).orderBy("window_end").collect()
    assert [(r.lo, r.hi) for r in got] == [(0, 2), (1, 3), (2, 4), (3, 5), (3, 5), (3, 5), (6, 8)]
    df = timed(spark, [603, 605, 607, 618, 625, 626, 629])
    out = windows.length_by_time_slide_by_count(df, 20_000, 3, "ts", ["seq"], {"lo": F.min("seq"), "hi": F.max("seq")})
    assert rows(out.select("lo", "hi")) == [(0, 2), (2, 5)]


def test_event_count_windows_with_ties(spark):
    df = timed(spark, [10, 10, 11, 12, 12, 12, 12, 13, 14, 15])
    mark = F.timestamp_millis(F.lit(20))
    spans = {"lo": F.min("seq"), "hi": F.max("seq")}
    assert rows(windows.event_count(df, 2, 2, "ts", ["seq"], spans, mark).select("lo", "hi")) == [(0, 1), (2, 3), (4, 5), (6, 7), (8, 9)]
    assert rows(windows.event_count(df, 5, 2, "ts", ["seq"], spans, mark).select("lo", "hi")) == [(0, 1), (0, 3), (1, 5), (3, 7), (5, 9)]


def test_late_rows(spark):
    df = timed(spark, [100, 110, 105, 106, 115, 104])
    got = windows.late_rows(df, "ts", "seq", 5_000).orderBy("seq").collect()
    assert [r.is_late for r in got] == [False] * 5 + [True]


def test_empty_inputs(spark):
    none = timed(spark, [1]).limit(0)
    assert windows.tumbling_count(none, 2, ["seq"]).count() == 0
    assert windows.late_rows(none, "ts", "seq", 1).count() == 0
    assert aggregate.array_reduce(spark.createDataFrame([], "v array<int>"), "v").count() <= 1
    assert sorting.global_rank(none, ["seq"]).count() == 0


def test_sources_and_sinks(spark, tmp_path):
    df = files.parallelize(spark, [(1, "a,b"), (2, "c")], "i int, s string")
    sinks.write_csv(df, f"{tmp_path}/csv")
    assert rows(files.csv(spark, f"{tmp_path}/csv", df.schema, header=True)) == rows(df)
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        sinks.write_csv(df, f"{tmp_path}/csv")
    sinks.write_text(df, f"{tmp_path}/text", "s")
    assert sorted(seqs(files.text(spark, f"{tmp_path}/text"))) == ["a,b", "c"]
    assert files.text(spark, f"{tmp_path}/text", "complete", 3).count() == 6
    assert rows(files.csv(spark, f"{tmp_path}/text").select(F.size("fields"))) == [(1,), (2,)]
    (tmp_path / "fixed").write_bytes(bytes(range(30)))
    assert files.fixed_records(spark, f"{tmp_path}/fixed", 10).count() == 3
    assert sinks.write_arrow(df, f"{tmp_path}/arrow").groupBy().sum("rows").first()[0] == 2
    assert rows(custom.arrow(spark, f"{tmp_path}/arrow")) == rows(df)
    assert rows(custom.custom(spark, "two_parts", 2, lambda p: iter([(p,)]), "p int")) == [(0,), (1,)]


def test_map_source_is_sorted(spark):
    assert [r.key for r in files.parallelize_map(spark, {"b": "1", "a": "2"}).collect()] == ["a", "b"]


def test_persist_is_made_once(spark, tmp_path):
    path = f"file://{tmp_path}/set"
    sinks.persist(spark.range(3), path)
    assert sinks.persist(spark.range(9), path).count() == 3
    later = sinks.lazy_persist(spark.range(4), f"file://{tmp_path}/later")
    assert not sinks.finished(spark, f"file://{tmp_path}/later")
    assert later().count() == 4


def test_variables_survive(spark, tmp_path):
    path = f"file://{tmp_path}/vars.json"
    v = iterate.Variables(spark, path)
    assert v.init("round", 0) == 0
    v.update("round", 5)
    v.commit()
    assert iterate.Variables(spark, path).init("round", 0) == 5


def test_connected_jobs_refuse_cycles(spark):
    with pytest.raises(ValueError):
        iterate.connected({"a": lambda i: i["b"], "b": lambda i: i["a"]}, {"a": ["b"], "b": ["a"]})


def test_compute(spark):
    df = spark.range(10).repartition(2)

    def total(frames):
        return {"n": sum(len(f) for f in frames)}

    assert sum(r.n for r in compute.compute(df, total, "n long").collect()) == 10
    assert compute.map_pandas(df, lambda f: f * 2, "id long").groupBy().max("id").first()[0] == 18
    assert compute.flat_map(spark.createDataFrame([([1, 2],), ([],)], "v array<int>"), F.col("v")).count() == 2


def test_graph_text_and_paths(spark):
    lines = spark.createDataFrame([("a b c",), ("",), ("b a",), ("c",)], "value string")
    v, e = graph.adjacency_text(lines)
    assert rows(v) == [("a",), ("b",), ("c",)]
    assert rows(e.select("src", "dst")) == [("a", "b"), ("a", "c"), ("b", "a")]
    weighted = spark.createDataFrame([("s a 4 b 1",), ("b a 2",), ("a",), ("z",)], "value string")
    v, e = graph.adjacency_text(weighted, weighted=True)
    assert rows(graph.shortest_paths(v, e, "s")) == [("a", 3), ("b", 1), ("s", 0), ("z", None)]


def test_pagerank_keeps_the_mass(spark):
    v = spark.range(4).toDF("id")
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (0, 3)], "src long, dst long")
    ranks = [r["rank"] for r in graph.pagerank(v, e, 8).collect()]
    assert len(ranks) == 4 and abs(sum(ranks) - 1) < 1e-9


def test_kmeans_and_svm(spark):
    pts = spark.createDataFrame([(i, [float(i % 2) * 10 + i % 3, 0.0]) for i in range(60)], "id long, x array<double>")
    start = spark.createDataFrame([(0, [0.0, 0.0]), (1, [5.1, 0.0]), (2, [900.0, 900.0])], "cluster int, c array<double>")
    got = {r.cluster: r.c for r in ml.kmeans(pts, start, 3).collect()}
    assert got == {0: [1.0, 0.0], 1: [11.0, 0.0], 2: [900.0, 900.0]}
    data = spark.createDataFrame([(1.0 if i % 2 else -1.0, [3.0 if i % 2 else -3.0, 1.0]) for i in range(40)], "label double, x array<double>")
    assert ml.svm_accuracy(data, ml.train_svm(data, 0.01, 5)).first()[0] == 1.0


def test_terasort(spark):
    df = spark.range(500).select(F.unhex(F.substring(F.md5(F.col("id").cast("string")), 1, 20)).alias("key"))
    out = ml.terasort(df, n=4)
    assert ml.terasort_check(out).first()[0]
    assert out.count() == 500


def scan_tasks(spark, run):
    """The most tasks of any stage that ``run`` starts."""
    group = f"count-{random.random()}"
    spark.sparkContext.setJobGroup(group, "")
    run()
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return max(info.numTasks for s in stages if (info := tracker.getStageInfo(s)) is not None)


def test_folds_and_gathers_leave_the_scan_its_tasks(spark):
    numbers = spark.range(0, 800, 1, 8)
    assert scan_tasks(spark, lambda: udf.tree_reduce(numbers, "id", max, "long").collect()) == 8
    assert scan_tasks(spark, lambda: movement.gather(numbers.where("id % 2 = 0")).collect()) == 8
    assert udf.tree_reduce(numbers, "id", lambda a, b: a + b, "long").first()[0] == 319_600
    assert movement.gather(numbers).rdd.getNumPartitions() == 1


def test_keyed_folds_hold_few_keys(spark):
    rng = random.Random(5)
    data = [(rng.randrange(300), rng.randrange(1000)) for _ in range(5000)]
    want = defaultdict(int)
    for k, v in data:
        want[k] += v
    got = udf.keyed_tree_reduce(spark.createDataFrame(data, "k long, v long"), "k", "v", lambda a, b: a + b, "long", held_keys=7)
    assert {r.k: r.reduced for r in got.collect()} == want


def test_sort_checks_see_disorder(spark):
    good = spark.range(0, 100, 1, 4)
    assert tuple(sorting.sort_check(good, "id").first())[:2] == (True, 100)
    assert sorting.is_sorted(good.union(good), "id").first()[0] is False
    assert sorting.is_sorted(good.orderBy(F.desc("id")), "id").first()[0] is False
    assert tuple(sorting.sort_check(good.where("id < 0"), "id").first()) == (True, 0, 0)
    assert sorting.sort_check(good.where("id <> 7"), "id").first()["checksum"] != sorting.sort_check(good, "id").first()["checksum"]


def test_variables_survive_a_commit_that_is_cut_off(spark, tmp_path):
    path = f"{tmp_path}/vars"
    state = iterate.Variables(spark, path)
    state.update("round", 4)
    state.commit()
    (tmp_path / "vars").rename(tmp_path / "vars.old")  # as after the first of the two renames
    assert iterate.Variables(spark, path).init("round", 0) == 4


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        iterate.shared_folder(Session())


def test_arrow_files_are_read_by_ranges(spark, tmp_path):
    import pyarrow as pa

    table = pa.table({"a": list(range(1000)), "b": [str(i) for i in range(1000)]})
    for name, writer in (("f.arrow", pa.ipc.new_file), ("s.arrow", pa.ipc.new_stream)):
        with writer(f"{tmp_path}/{name}", table.schema) as out:
            out.write_table(table, max_chunksize=10)
    got = custom.arrow(spark, str(tmp_path), batches_per_task=7)
    assert sorted(r.a for r in got.collect()) == sorted([*range(1000), *range(1000)]) and got.columns == ["a", "b"]
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="no Arrow files"):
        custom.arrow(spark, str(tmp_path / "empty"))


def test_table_functions(spark):
    out = udf.flat_map_table(spark.range(4), lambda n: ((i, i * n) for i in range(n)), "i bigint, p bigint", ["id"], "sluice_test_rows")
    assert rows(out) == [(1, 0, 0), (2, 0, 0), (2, 1, 2), (3, 0, 0), (3, 1, 3), (3, 2, 6)]



def test_scaling_recovers_distances(spark):
    import numpy as np

    points = np.random.default_rng(3).random((40, 2))
    far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    frame = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(far)], "i long, d array<double>").repartition(3)
    x, stress = ml.mds(frame, dim=2, rounds=60, tolerance=1e-9, seed=5)
    assert all(a >= b - 1e-12 for a, b in zip(stress, stress[1:])) and stress[-1] < 0.02
    assert abs(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) - far).mean() < 0.1
    assert ml.mds(frame.limit(0))[0].shape == (0, 3)
    with pytest.raises(ValueError, match="at most 5"):
        ml.mds(frame, max_points=5)
