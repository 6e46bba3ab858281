"""Streams, driven batch by batch."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sluice.streaming import flows, stateful


class Feed:
    """A folder whose files are the micro-batches of a stream."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, str(path), schema, 0

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def stream(self):
        return flows.files(self.spark, f"{self.path}/in", self.schema)

    def drain(self, out):
        flows.start(out, "parquet", f"{self.path}/state", path=f"{self.path}/out").awaitTermination()
        return [tuple(r) for r in self.spark.read.schema(out.schema).parquet(f"{self.path}/out").collect()]


def spans(found):
    return sorted((int(w), [int(x) for x in v], [int(x) for x in f], [int(x) for x in e]) for w, v, f, e in found)


def test_sliding_count_windows_over_batches(spark, tmp_path):
    feed = Feed(spark, tmp_path, "value double, seq long")
    for part in ([0, 1, 2], [3, 4], [5, 6, 7]):
        feed.add([(float(i), i) for i in part])
        got = feed.drain(stateful.count_windows(feed.stream(), 5, 2))
    assert spans(got) == [
        (1, [0, 1], [0, 1], []),
        (2, [0, 1, 2, 3], [2, 3], []),
        (3, [1, 2, 3, 4, 5], [4, 5], [0]),
        (4, [3, 4, 5, 6, 7], [6, 7], [1, 2]),
    ]


def test_tumbling_count_windows(spark, tmp_path):
    feed = Feed(spark, tmp_path, "value double, seq long")
    feed.add([(float(i), i) for i in range(7)])
    assert spans(feed.drain(stateful.count_windows(feed.stream(), 3))) == [(1, [0, 1, 2], [0, 1, 2], []), (2, [3, 4, 5], [3, 4, 5], [0, 1, 2])]


def test_late_rows_by_the_strict_rule(spark, tmp_path):
    feed = Feed(spark, tmp_path, "ms long, value double, seq long")
    stamps = [100, 110, 105, 106, 115, 104]
    for k in (slice(0, 2), slice(2, 5), slice(5, 6)):
        feed.add([(ms, 0.0, i) for i, ms in list(enumerate(stamps))[k]])
        got = feed.drain(stateful.late_rows(feed.stream().withColumn("ts", F.timestamp_millis("ms")), "ts", "value", 5_000))
    assert [late for _, _, _, late in sorted(got)] == [False] * 5 + [True]


def test_watermark_needs_every_source(spark, tmp_path):
    feed = Feed(spark, tmp_path, "ms long, source string, seq long")
    stamped = lambda: feed.stream().withColumn("ts", F.timestamp_millis("ms"))
    feed.add([(100, "a", 0), (110, "a", 1)])
    assert feed.drain(stateful.watermark(stamped(), "ts", "source", ["a", "b"], 5_000)) == []
    feed.add([(95, "b", 2), (98, "b", 3)])
    got = feed.drain(stateful.watermark(stamped(), "ts", "source", ["a", "b"], 5_000))
    assert max(got) == (93_000,)


@pytest.mark.parametrize("fold", [False, True])
def test_rounds_wait_for_the_slowest_source(spark, tmp_path, fold):
    feed = Feed(spark, tmp_path, "source long, value double, seq long")
    out = lambda: stateful.rounds(feed.stream(), "source", [0, 1], "value", fold=(lambda a, b: a + b) if fold else None)
    feed.add([(0, 1.0, 0), (0, 2.0, 1), (1, 10.0, 2)])
    first = feed.drain(out())
    assert first == ([(0, 11.0)] if fold else [(0, [1.0, 10.0])])
    feed.add([(1, 20.0, 3)])
    assert sorted(feed.drain(out())) == ([(0, 11.0), (1, 22.0)] if fold else [(0, [1.0, 10.0]), (1, [2.0, 20.0])])


def test_running_word_count(spark, tmp_path):
    feed = Feed(spark, tmp_path, "value string")
    feed.add([("a b a",), ("",)])
    feed.add([("b  c",)])
    flows.start(flows.word_count(feed.stream()), "memory", f"{tmp_path}/s", "complete", name="words").awaitTermination()
    assert dict(tuple(r) for r in spark.table("words").collect()) == {"a": 2, "b": 2, "c": 1}


def test_event_time_windows_close(spark, tmp_path):
    feed = Feed(spark, tmp_path, "ms long")
    out = lambda: flows.event_time_windows(feed.stream().withColumn("ts", F.timestamp_millis("ms")), "ts", "20 milliseconds", "10 milliseconds", n=F.count("*"))
    feed.add([(ms,) for ms in (603, 605, 607, 618, 626, 636)])
    feed.add([(5_000,)])
    got = {int(e.timestamp() * 1000): n for e, n in feed.drain(out())}
    assert got == {610: 3, 620: 4, 630: 2, 640: 2, 650: 1}


def test_batches_reach_a_function(spark, tmp_path):
    feed, seen = Feed(spark, tmp_path, "v long"), []
    feed.add([(1,), (2,)])
    flows.for_each_batch(feed.stream(), lambda b, _i: seen.append(b.count()), f"{tmp_path}/s").awaitTermination()
    assert sum(seen) == 2


EVENTS = [603, 605, 607, 618, 626, 636]
LATER = [825, 826, 827, 839]


def windows_of(feed, parts, **policy):
    """Add batches of (ms, seq), with a lag that puts the watermark where each batch says; all firings in order."""
    n = 0
    for stamps in parts:
        feed.add([(ms, float(n + i), n + i) for i, ms in enumerate(stamps)])
        n += len(stamps)
        got = feed.drain(stateful.event_windows(feed.stream().withColumn("ts", F.timestamp_millis("ms")), "ts", "value", lag_us=5_000, **policy))
    return sorted((at, [int(v) for v in vs]) for kind, at, vs in got if kind == "window"), [int(vs[0]) for kind, _, vs in got if kind == "late"]


def test_event_time_policy(spark, tmp_path):
    feed = Feed(spark, tmp_path, "ms long, value double, seq long")
    got, late = windows_of(feed, [EVENTS, LATER], length_us=20_000, slide_us=10_000)
    assert [(at // 1000, m) for at, m in got] == [
        (610, [0, 1, 2]), (620, [0, 1, 2, 3]), (630, [3, 4]), (640, [4, 5]), (650, [5]), (830, [6, 7, 8]),
    ]
    assert late == []


def test_count_length_time_slide(spark, tmp_path):
    feed = Feed(spark, tmp_path, "ms long, value double, seq long")
    got, _ = windows_of(feed, [EVENTS, [665, 666, 667, 679]], length=3, slide_us=10_000)
    assert [m for _, m in got] == [[0, 1, 2], [1, 2, 3], [2, 3, 4], [3, 4, 5], [3, 4, 5], [3, 4, 5], [6, 7, 8]]


def test_time_length_count_slide(spark, tmp_path):
    feed = Feed(spark, tmp_path, "ms long, value double, seq long")
    got, _ = windows_of(feed, [[603, 605, 607, 618], [625, 626, 629, 636]], length_us=20_000, slide=3)
    assert got == [(1, [0, 1, 2]), (2, [2, 3, 4, 5])]


def test_event_count_windows_with_ties(spark, tmp_path):
    feed = Feed(spark, tmp_path, "ms long, value double, seq long")
    got, late = windows_of(feed, [[10, 10, 11, 12, 12], [12, 12, 13, 14, 15], [25], [3]], length=5, slide=2)
    assert [(m[0], m[-1]) for _, m in got] == [(0, 1), (0, 3), (1, 5), (3, 7), (5, 9)]
    assert late == [11]


def test_policies_are_named(spark):
    with pytest.raises(ValueError):
        stateful.event_windows(spark.range(1), "id", "id", length=1, length_us=1, slide=1)


def test_custom_source(spark, tmp_path):
    stream = flows.custom(spark, "squares", lambda i: (i, i * i) if i < 25 else None, "i int, square int", per_trigger=10)
    query = flows.start(stream, "memory", f"{tmp_path}/s", name="squares_table", once=False)
    query.processAllAvailable()
    query.stop()
    assert sorted(tuple(r) for r in spark.table("squares_table").collect()) == [(i, i * i) for i in range(25)]


def test_large_numbers_and_texts_keep_their_type(spark, tmp_path):
    big = 2**53
    feed = Feed(spark, tmp_path / "n", "value long, seq long")
    feed.add([(big + 1, 0), (big + 3, 1), (None, 2), (big + 5, 3)])
    assert sorted((r[1] for r in feed.drain(stateful.count_windows(feed.stream(), 2))), key=str) == sorted([[big + 1, big + 3], [None, big + 5]], key=str)
    feed = Feed(spark, tmp_path / "t", "value string, seq long")
    for part in (["a", "b", "c"], ["d"]):
        feed.add([(v, ord(v)) for v in part])
        got = feed.drain(stateful.count_windows(feed.stream(), 2))
    assert sorted(r[1] for r in got) == [["a", "b"], ["c", "d"]]
    feed = Feed(spark, tmp_path / "r", "source long, value long, seq long")
    feed.add([(0, big + 1, 0), (1, big + 3, 1)])
    assert feed.drain(stateful.rounds(feed.stream(), "source", [0, 1], "value", fold=max)) == [(0, big + 3)]


def test_numbered_rounds_run_apart(spark, tmp_path):
    feed = Feed(spark, tmp_path, "source long, number long, value string")
    out = lambda: stateful.rounds(feed.stream(), "source", [0, 1, 2], "value", number="number")
    feed.add([(0, 0, "a"), (2, 0, "c"), (1, 1, "x")])
    assert feed.drain(out()) == []
    feed.add([(1, 0, "b"), (0, 1, "w")])
    assert feed.drain(out()) == [(0, ["a", "b", "c"])]
    feed.add([(2, 1, "y")])
    assert sorted(feed.drain(out())) == [(0, ["a", "b", "c"]), (1, ["w", "x", "y"])]


@pytest.mark.parametrize("fold", [False, True])
def test_numbered_rounds_share_the_state_of_their_block(spark, tmp_path, fold):
    big, rounds = 2**53 + 1, range(-5, 3000)
    feed = Feed(spark, tmp_path, "source string, number long, value long")
    last = lambda a, b: b

    def drain():
        out = stateful.rounds(feed.stream(), "source", ["x", "y", "z"], "value", number="number", fold=last if fold else None)
        query = flows.start(out, "parquet", f"{tmp_path}/state", path=f"{tmp_path}/out")
        query.awaitTermination()
        held = query.lastProgress["stateOperators"][0]["numRowsTotal"]
        return sorted((tuple(r) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()), key=lambda r: r[0]), held

    value = lambda s, r: None if (s, r % 7) == ("z", 0) else big + r * 3 + "xyz".index(s)
    want = lambda found: [(r, value("z", r) if fold else [value(s, r) for s in "xyz"]) for r in found]
    feed.add([(s, r, value(s, r)) for s in "zx" for r in rounds])
    got, held = drain()
    assert got == [] and 1 <= held <= 4
    feed.add([("y", r, value("y", r)) for r in rounds if r % 2] + [("x", r, 0) for r in rounds])  # a source's second row of a round doesn't count
    got, held = drain()
    assert got == want(r for r in rounds if r % 2) and 1 <= held <= 4
    feed.add([("y", r, value("y", r)) for r in rounds if r % 2 == 0])
    got, held = drain()
    assert got == want(rounds) and held == 0


@pytest.mark.parametrize("fold", [False, True])
def test_unnumbered_rounds_are_numbered_over_many_tasks(spark, tmp_path, fold):
    feed = Feed(spark, tmp_path, "source string, value string, seq long")

    def drain(stream=None, **more):
        add = (lambda a, b: f"{a}{b}") if fold else None
        query, found = stateful.write_rounds(feed.stream() if stream is None else stream, "source", ["b", "a"], "value", f"{tmp_path}/rounds", fold=add, **more)
        query.awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(found).collect())

    def want(n):  # b's row r with a's
        pairs = [(f"b{r}" if r != 3 else None, f"a{r}") for r in range(n)]
        return [(r, f"{b}{a}" if fold else [b, a]) for r, (b, a) in enumerate(pairs)]

    rows = {s: [(s, None if (s, i) == ("b", 3) else f"{s}{i}", i) for i in range(500)] for s in "ab"}
    feed.add(rows["b"][:2][::-1])
    assert drain() == []
    feed.add([*rows["a"][:300][::-1], *rows["b"][2:5]])
    assert drain() == want(5)
    feed.add(rows["b"][5:500][::-1])
    parts = spark.read.parquet(f"{tmp_path}/rounds/rounds/1").count()
    assert drain() == want(300) and parts == 5
    feed.add(rows["a"][300:])
    with pytest.raises(Exception, match="no room"):
        drain(feed.stream().withColumn("value", F.when(F.col("source") == "a", F.raise_error(F.lit("no room"))).otherwise(F.col("value"))))
    assert drain() == want(500)  # the batch that failed is run again
    feed.add([("z", "?", 0)])
    with pytest.raises(Exception, match="no known source"):
        drain()


def test_all_reduce_and_all_gather_hold_blocks_of_rounds(spark, tmp_path, monkeypatch):
    from sluice.plans import catalog

    spark.range(6_000).select(F.expr("id div 2 * 3 + id % 2").alias("event_id")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")  # the third source is late
    held, start = [], flows.start
    monkeypatch.setattr(flows, "start", lambda *a, **k: held.append(start(*a, **k)) or held[-1])
    for name in ("stream_all_reduce", "stream_all_gather"):
        held.clear()
        assert catalog.queries()[name](spark, str(tmp_path)).count() == 0
        assert 1 <= held[-1].lastProgress["stateOperators"][0]["numRowsTotal"] <= 3, name


def test_queries_of_unnumbered_rounds_leave_no_task_with_a_source(spark, tmp_path):
    from sluice.plans import catalog

    spark.range(30_000).select(F.col("id").alias("event_id")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    for name in ("stream_rounds", "stream_gather_rounds"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        out = catalog.queries()[name](spark, str(tmp_path))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
        tasks = [r["count"] for r in out.groupBy(F.input_file_name()).count().collect()]
        assert sum(tasks) == 10_000 and max(tasks) < 5_000, (name, tasks)


def test_a_window_before_the_first_row_may_fill_later(spark, tmp_path):
    feed = Feed(spark, tmp_path, "ms long, seq long, v string")
    out = lambda: stateful.event_windows(feed.stream().withColumn("ts", F.timestamp_millis("ms")), "ts", "v", lag_us=20_000, length_us=10_000, slide_us=10_000)
    feed.add([(35, 0, "a")])
    assert feed.drain(out()) == []
    feed.add([(18, 1, "b"), (200, 2, "c")])
    got = feed.drain(out())
    assert sorted(got) == [("window", 20_000, ["b"]), ("window", 40_000, ["a"])]


def test_a_stream_that_fails_in_a_batch_goes_on_from_its_checkpoint(spark, tmp_path):
    feed = Feed(spark, tmp_path, "value long, seq long")
    trap = tmp_path / "trap"
    trap.touch()

    def check(frames):
        for f in frames:
            if trap.exists() and (f["value"] == 5).any():
                raise RuntimeError("lost in mid-batch")
            yield f

    out = lambda: stateful.count_windows(feed.stream().mapInPandas(check, "value long, seq long"), 3)
    feed.add([(i, i) for i in range(4)])
    assert [r[1] for r in feed.drain(out())] == [[0, 1, 2]]
    feed.add([(i, i) for i in range(4, 9)])
    with pytest.raises(Exception, match="mid-batch"):
        feed.drain(out())
    trap.unlink()
    assert sorted(r[1] for r in feed.drain(out())) == [[0, 1, 2], [3, 4, 5], [6, 7, 8]]


def test_kafka_takes_its_options():
    class Reader:
        def __init__(self):
            self.set = {}

        def format(self, name):
            self.set["format"] = name
            return self

        def option(self, key, value):
            self.set[key] = value
            return self

    class Session:
        readStream = Reader()

    got = flows.kafka_reader(Session(), "a:9092,b:9092", "t1,t2", "latest", maxOffsetsPerTrigger=100, kafka__group__id="g").set
    assert got == {
        "format": "kafka",
        "kafka.bootstrap.servers": "a:9092,b:9092",
        "subscribe": "t1,t2",
        "startingOffsets": "latest",
        "maxOffsetsPerTrigger": 100,
        "kafka.group.id": "g",
    }


def test_offsets_resume_after_the_last(spark, tmp_path):
    """The part of a log with offsets, by a source that can grow."""
    log = tmp_path / "log"
    log.write_text("a\nb\n")

    def rows(i):
        lines = log.read_text().split()
        return (i, lines[i]) if i < len(lines) else None

    def drain():
        query = flows.start(flows.custom(spark, "sluice_log", rows, "offset long, line string"), "parquet", f"{tmp_path}/s", path=f"{tmp_path}/o", once=False)
        query.processAllAvailable()
        query.stop()
        return sorted(tuple(r) for r in spark.read.schema("offset long, line string").parquet(f"{tmp_path}/o").collect())

    assert drain() == [(0, "a"), (1, "b")]
    log.write_text("a\nb\nc\n")
    assert drain() == [(0, "a"), (1, "b"), (2, "c")]


def test_parts_of_a_key_are_shed(spark, tmp_path):
    feed = Feed(spark, tmp_path, "k string, v long, seq long")
    out = lambda: stateful.keyed_gather(feed.stream(), "k", "v", 2)
    feed.add([("x", 1, 0), ("x", 2, 1), ("x", 3, 2), ("y", 9, 3)])
    assert feed.drain(out()) == [("x", 0, [1, 2])]
    feed.add([("x", 4, 4)])
    assert sorted(feed.drain(out())) == [("x", 0, [1, 2]), ("x", 1, [3, 4])]
