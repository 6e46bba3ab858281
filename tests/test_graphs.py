"""Built graphs, topologies, portable pipelines and tasks with a life cycle."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sluice.operators import compute, movement
from sluice.plans import dataflow, transforms


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_a_graph_checks_its_tasks(spark):
    with pytest.raises(ValueError, match="batch or stream"):
        dataflow.GraphBuilder(mode="both")
    builder = dataflow.GraphBuilder().add_source("rows", spark.range(3))
    with pytest.raises(ValueError, match="already"):
        builder.add_source("rows", spark.range(3))
    task = builder.add_compute("task")
    with pytest.raises(ValueError, match="no input"):
        builder.build()
    task.direct("nothing")
    with pytest.raises(ValueError, match="not there"):
        builder.build()
    ring = dataflow.GraphBuilder()
    ring.add_compute("a").direct("b")
    ring.add_compute("b").direct("a")
    with pytest.raises(ValueError, match="wait for each other"):
        ring.build()
    stream = dataflow.GraphBuilder(mode="stream").add_source("rows", spark.range(3))
    with pytest.raises(ValueError, match="no gather"):
        stream.add_compute("task").gather("rows")


def test_only_what_leads_to_a_task_is_made(spark):
    made = []

    def source(name):
        return lambda: made.append(name) or spark.range(4)

    builder = dataflow.GraphBuilder().add_source("a", source("a")).add_source("b", source("b"))
    builder.add_compute("of_a", lambda i: i["rows"].where("id > 1")).direct("a").via_edge("rows")
    builder.add_compute("of_b").direct("b")
    graph = builder.build()
    assert ids(graph.run_one("of_a")) == [2, 3] and made == ["a"]
    assert ids(graph.run({"b": spark.range(2)})["of_b"]) == [0, 1]


def test_edges_have_partitioners_schemas_and_disk(spark):
    builder = dataflow.GraphBuilder().add_source("rows", spark.range(0, 40, 1, 4)).add_constraint("spark.sql.shuffle.partitions", 3)
    edge = builder.add_compute("task", lambda i: i["rows"].withColumn("p", F.spark_partition_id())).partition("rows")
    edge.with_partitioner(movement.OneToOne(), 4).with_schema(spark.range(1).select(F.col("id").cast("string")).schema).use_disk().via_edge("rows")
    graph = builder.build()
    out = graph.run_one("task")
    assert {(r.id, r.p) for r in out.collect()} == {(str(i), i // 10) for i in range(40)}
    assert graph._kept and not graph.close() and not graph._kept
    before = spark.conf.get("spark.sql.shuffle.partitions")
    graph.settings(spark)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_partitioners_are_prepared_and_committed(spark):
    with pytest.raises(ValueError, match="4 sources for 3"):
        movement.partition_with(spark.range(0, 8, 1, 4), movement.OneToOne(), 3)
    with pytest.raises(NotImplementedError):
        movement.partition_with(spark.range(3), movement.Partitioner(), 2)


def test_a_topology_takes_several_groupings(spark):
    topology = dataflow.TopologyBuilder().set_spout("a", spark.range(3)).set_spout("b", spark.range(3, 5))
    topology.set_bolt("both", lambda df: df).global_grouping("a").none_grouping("b")
    assert ids(topology.build().run_one("both")) == [0, 1, 2, 3, 4]


def test_portable_steps_are_checked(spark):
    with pytest.raises(NotImplementedError, match="no transform"):
        transforms.run(spark, [("combine", [], ["x"], {})])
    with pytest.raises(ValueError, match="needs"):
        transforms.run(spark, [("flatten", ["a"], ["x"], {})])
    with pytest.raises(ValueError, match="at most 2 rows"):
        transforms.run(spark, [("read", [], ["a"], {"source": spark.range(5)}), ("view", ["a"], ["v"], {"limit": 2})])


def test_a_task_is_closed_after_a_failure(spark, tmp_path):
    class Broken(compute.Task):
        def compute(self, frame):
            raise RuntimeError("broken")

        def close(self):
            open(f"{tmp_path}/closed", "w").close()

    with pytest.raises(Exception, match="broken"):
        compute.run_task(spark.range(3), Broken, "id long").collect()
    assert (tmp_path / "closed").exists()


def test_outputs_of_one_pass_are_released(spark):
    out = compute.multi_output(spark.range(6), lambda f: f.assign(tag=["even" if i % 2 == 0 else "odd" for i in f["id"]]), "id long, tag string", ["even", "odd"])
    assert ids(out["even"]) == [0, 2, 4] and ids(out["odd"]) == [1, 3, 5]
    held = len(compute._shared)
    compute.release(out)
    assert len(compute._shared) == held - 2
