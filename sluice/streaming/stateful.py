"""Operators with state of their own, per key: count windows, rounds, late rows.

State is kept by ``applyInPandasWithState`` in Spark's state store and restored from the query's checkpoint. A key's
rows of a micro-batch are put in order of a sequence column, since their order of arrival is not kept by a shuffle.
Values are carried in state and results with the type of their column; a null value is carried as null.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.time import micros
from .flows import for_each_batch


#: Numbered rounds share a state with the others of their block, 2 to this power: a call of Python and a state each would cost far more than a round.
_BLOCK_BITS = 10


def _ordered(frames, order: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(order, kind="stable")


def _plain(values) -> list:
    """The values as Python objects of their own type."""
    return [None if x is None or x is pd.NaT or x is pd.NA else x.item() if hasattr(x, "item") else x for x in values]


def _typed(df: DataFrame, value: str, seq: str | None = None) -> tuple[DataFrame, str]:
    """``df`` with the value as __value, whole numbers in a form that pandas takes along with nulls without turning them into
    doubles, and the order as __seq; and the value's type."""
    kind = df.schema[value].dataType.simpleString()
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    out = df.withColumn("__value", F.col(value).cast("string") if whole else F.col(value))
    return (out if seq is None else out.withColumn("__seq", F.col(seq))), kind


def _values(kind: str) -> Callable:
    """From a column as ``_typed`` sends it to Python values of type ``kind``."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return lambda column: [None if x is None else int(x) for x in _plain(column)]
    if kind in ("double", "float"):
        return lambda column: [None if x is None or x != x else float(x) for x in _plain(column)]
    return _plain


def _keyed(df: DataFrame, key: str | None) -> tuple[DataFrame, str, str]:
    """A frame with a key; without one a single sequence, one task's work by definition."""
    if key is not None:
        return df, key, df.schema[key].dataType.simpleString()
    return df.withColumn("__all", F.lit(0)), "__all", "int"


def count_windows(df: DataFrame, length: int, slide: int | None = None, value: str = "value", seq: str = "seq", key: str | None = None) -> DataFrame:
    """A row per firing: (key, window_id, values, fresh, expired), the values in order.

    A window fires on every ``slide``-th row of its key with the last ``length`` values at most; ``fresh`` are those since
    the last firing, ``expired`` those of the last window that have left.
    """
    slide = slide or length
    df, name, kind = _keyed(df, key)
    df, of = _typed(df, value, seq)
    read = _values(of)

    def step(k, frames, state):
        seen, held, before = state.get if state.exists else (0, [], [])
        held, before, out = _plain(held), _plain(before), []
        for x in read(_ordered(frames, ["__seq"])["__value"]):
            seen, held = seen + 1, [*held, x][-(length + slide) :]
            if seen % slide == 0:
                now = held[-min(length, seen) :]
                # ``before`` holds the last window; what is not among the values still in reach has expired.
                kept = max(0, len(now) - slide) if seen > slide else 0
                out.append((k[0], seen // slide, now, held[-min(slide, length) :], before[: len(before) - kept]))
                before = now
        state.update((seen, held, before))
        yield pd.DataFrame(out, columns=[name, "window_id", "values", "fresh", "expired"])

    out = df.select(name, "__value", "__seq").groupBy(name).applyInPandasWithState(
        step,
        f"`{name}` {kind}, window_id long, values array<{of}>, fresh array<{of}>, expired array<{of}>",
        f"seen long, held array<{of}>, before array<{of}>",
        "append",
        GroupStateTimeout.NoTimeout,
    )
    return out if key is not None else out.drop(name)


def late_rows(df: DataFrame, ts: str, value: str, lag_us: int, seq: str = "seq", key: str | None = None) -> DataFrame:
    """(key, seq, value, us, is_late): a row is late if it is behind the greatest timestamp before it minus the lag."""
    df, name, kind = _keyed(df.withColumn("__us", micros(df, ts)), key)
    df, of = _typed(df, value)
    read = _values(of)

    def step(k, frames, state):
        top = state.get[0] if state.exists else None
        rows = _ordered(frames, [seq])
        out = []
        for s, v, us in zip(rows[seq], read(rows["__value"]), rows["__us"], strict=True):
            out.append((k[0], int(s), v, int(us), top is not None and us < top - lag_us))
            top = int(us) if top is None else max(top, int(us))
        state.update((top,))
        yield pd.DataFrame(out, columns=[name, "seq", "value", "us", "is_late"])

    out = df.select(name, "__value", F.col(seq).alias(seq), "__us").groupBy(name).applyInPandasWithState(
        step, f"`{name}` {kind}, seq long, value {of}, us long, is_late boolean", "top long", "append", GroupStateTimeout.NoTimeout
    )
    return out if key is not None else out.drop(name)


def watermark(df: DataFrame, ts: str, source: str, sources: list, lag_us: int, seq: str = "seq") -> DataFrame:
    """(watermark): the least over all sources of their greatest timestamp, minus the lag; emitted when it grows.

    Nothing is emitted until every source has had a row.
    """

    def step(k, frames, state):
        tops, sent = state.get if state.exists else ([None] * len(sources), None)
        tops, out = list(tops), []
        rows = _ordered(frames, [seq])
        for s, us in zip(rows[source], rows["__us"], strict=True):
            at = sources.index(s)
            tops[at] = int(us) if tops[at] is None or pd.isna(tops[at]) else max(int(tops[at]), int(us))
            if all(t is not None and not pd.isna(t) for t in tops):
                mark = int(min(tops)) - lag_us
                if sent is None or mark > sent:
                    out.append((mark,))
                    sent = mark
        state.update((tops, sent))
        yield pd.DataFrame(out, columns=["watermark"])

    rows = df.select(F.lit(0).alias("__all"), source, seq, micros(df, ts).alias("__us"))
    return rows.groupBy("__all").applyInPandasWithState(step, "watermark long", "tops array<long>, sent long", "append", GroupStateTimeout.NoTimeout)


def rounds(
    df: DataFrame, source: str, sources: list, value: str, seq: str = "seq", fold: Callable | None = None, copies: int = 1, number: str | None = None
) -> DataFrame:
    """Lock-step rounds: round r takes the r-th row of every source.

    Without ``fold`` a gather, (round, values) with the values in the order of ``sources``; with it a reduction,
    (round, value). ``copies`` > 1 sends each round to that many receivers, as the all- forms do. Where the sources number
    their own rows, name that column in ``number``: blocks of 1024 rounds are then handled apart, by as many tasks as there are
    partitions, and a round's part of the state ends with it. Without it one task sees the stream, and holds each batch: ``write_rounds`` deals that out.
    """
    df, of = _typed(df, value)
    read = _values(of)
    schema = f"round long, values array<{of}>" if fold is None else f"round long, value {of}"

    def result(at, first):
        if fold is None:
            return at, first
        total = first[0]
        for x in first[1:]:
            total = fold(total, x)
        return at, total

    columns = ["round", "values" if fold is None else "value"]
    if number is not None:

        def block_of_rounds(k, frames, state):
            held = state.get if state.exists else ([], [], [])
            rows = pd.concat(list(frames))
            at = np.array([*_plain(held[0]), *map(int, rows["__round"])], dtype="int64")
            place = np.array([*_plain(held[1]), *(places[s] for s in rows[source])], dtype="int64")
            got = [*_plain(held[2]), *read(rows["__value"])]
            order = np.lexsort((place, at))  # stable: of a source's rows of a round the one that came first counts
            by_at, by_place = at[order], place[order]
            first = np.r_[True, (by_at[1:] != by_at[:-1]) | (by_place[1:] != by_place[:-1])]
            numbers, counts = np.unique(by_at[first], return_counts=True)
            whole = numbers[counts == len(sources)]
            taken = order[first][np.isin(by_at[first], whole)].reshape(-1, len(sources))
            rest = np.flatnonzero(~np.isin(at, whole))
            if len(rest):
                state.update((at[rest].tolist(), place[rest].tolist(), [got[i] for i in rest]))
            elif state.exists:
                state.remove()
            yield pd.DataFrame([result(int(n), [got[i] for i in of_round]) for n, of_round in zip(whole, taken, strict=True)], columns=columns, dtype=object)

        places = {s: i for i, s in enumerate(sources)}
        rows = df.select(F.col(number).cast("long").alias("__round"), source, "__value").withColumn("__block", F.shiftright("__round", _BLOCK_BITS)).groupBy("__block")
        out = rows.applyInPandasWithState(block_of_rounds, schema, f"at array<long>, place array<int>, got array<{of}>", "append", GroupStateTimeout.NoTimeout)
    else:

        def step(k, frames, state):
            done, queues = state.get if state.exists else (0, [])
            waiting = [_plain(q) for q in queues] or [[] for _ in sources]
            rows = _ordered(frames, ["__seq"])
            for s, v in zip(rows[source], read(rows["__value"]), strict=True):
                waiting[sources.index(s)].append(v)
            ready = min(map(len, waiting))
            out = [result(done + r, [q[r] for q in waiting]) for r in range(ready)]
            state.update((done + ready, [q[ready:] for q in waiting]))
            yield pd.DataFrame(out, columns=columns)

        rows = df.select(F.lit(0).alias("__all"), source, F.col(seq).alias("__seq"), "__value").groupBy("__all")
        out = rows.applyInPandasWithState(step, schema, f"done long, waiting array<array<{of}>>", "append", GroupStateTimeout.NoTimeout)
    return out if copies == 1 else out.withColumn("receiver", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))


def write_rounds(
    df: DataFrame, source: str, sources: list, value: str, where: str, seq: str = "seq", fold: Callable | None = None, copies: int = 1, once: bool = True
) -> tuple[StreamingQuery, str]:
    """``rounds`` of sources that don't number their rows, written batch by batch under ``where``: the query, and the glob of its files.

    A batch is range-partitioned by (source, ``seq``) and written once with each row's place in its partition; a row of counts
    per partition and source turns places into rounds, which go on from the batch before. No task sees a whole source, and
    Python, which only folds, holds an Arrow batch. Between batches there are a count per source, which is how far complete
    rounds go, and the rows beyond. A batch that is run again after a failure replaces its own folders.
    """
    kind = df.schema[value].dataType.simpleString()
    schema = (f"round long, values array<{kind}>" if fold is None else f"round long, value {kind}") + (", receiver int" if copies > 1 else "")
    known = F.array_position(F.array(*[F.lit(s).cast(df.schema[source].dataType) for s in sources]), F.col(source))
    place = F.when(known > 0, known - 1).otherwise(F.raise_error(F.concat(F.lit("a row of no known source: "), F.coalesce(F.col(source).cast("string"), F.lit("null")))))
    got = [f"__{i}" for i in range(len(sources))]

    def folded(batches):
        for batch in batches:
            totals = []
            for first, *others in zip(*[batch.column(name).to_pylist() for name in got], strict=True):
                for x in others:
                    first = fold(first, x)
                totals.append(first)
            yield pa.RecordBatch.from_arrays([batch.column("round"), pa.array(totals, batch.column(got[0]).type)], ["round", "value"])

    def step(batch, at):
        spark = batch.sparkSession
        waiting = f"place int, round long, value {kind}"
        before, rows = [0] * len(sources), None
        if at > 0:
            before = spark.read.schema("counts array<long>").parquet(f"{where}/counts/{at - 1}").first()[0]
            rows = spark.read.schema(waiting).parquet(f"{where}/waiting/{at - 1}")
        order = [F.col("place"), F.col("seq").asc_nulls_last()]
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        placed = batch.select(place.cast("int").alias("place"), F.col(seq).alias("seq"), F.col(value).alias("value"))
        placed = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
        placed.drop("seq").write.mode("overwrite").parquet(f"{where}/placed/{at}")
        placed = spark.read.schema(f"place int, value {kind}, id long").parquet(f"{where}/placed/{at}").withColumn("part", F.shiftright("id", 33))
        shifts, counts = [], list(before)
        for i, part, first, n in sorted(map(tuple, placed.groupBy("place", "part").agg(F.min("id"), F.count("*")).collect())):
            shifts.append((i, part, counts[i] - first))
            counts[i] += n
        numbered = placed.join(F.broadcast(spark.createDataFrame(shifts, "place int, part long, shift long")), ["place", "part"])
        numbered = numbered.select("place", (F.col("id") + F.col("shift")).alias("round"), "value")
        rows, done = numbered if rows is None else rows.unionAll(numbered), min(counts)
        by_round = rows.where(F.col("round") < done).groupBy("round").agg(*[F.first(F.when(F.col("place") == i, F.col("value")), True).alias(name) for i, name in enumerate(got)])
        out = by_round.select("round", F.array(*got).alias("values")) if fold is None else by_round.mapInArrow(folded, f"round long, value {kind}")
        out = out if copies == 1 else out.withColumn("receiver", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        out.write.mode("overwrite").parquet(f"{where}/rounds/{at}")
        rows.where(F.col("round") >= done).write.mode("overwrite").parquet(f"{where}/waiting/{at}")
        spark.createDataFrame([(counts,)], "counts array<long>").write.mode("overwrite").parquet(f"{where}/counts/{at}")
        shed(spark, f"placed/{at}", f"waiting/{at - 2}", f"counts/{at - 2}")

    def shed(spark, *folders):
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{where}/{folder}")
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    df.sparkSession.createDataFrame([], schema).write.mode("overwrite").parquet(f"{where}/rounds/none")  # a stream without rows has no batch
    return for_each_batch(df, step, f"{where}/state", once=once), f"{where}/rounds/*"


def keyed_gather(df: DataFrame, key: str, value: str, limit: int, seq: str = "seq") -> DataFrame:
    """(key, part, values): a key's values in order, handed on whenever there are ``limit`` of them, so state stays below that."""
    df, of = _typed(df, value, seq)
    read, kind = _values(of), df.schema[key].dataType.simpleString()

    def step(k, frames, state):
        part, held = state.get if state.exists else (0, [])
        held, out = _plain(held) + read(_ordered(frames, ["__seq"])["__value"]), []
        at = 0
        while len(held) - at >= limit:
            out.append((k[0], part, held[at : at + limit]))
            part, at = part + 1, at + limit
        state.update((part, held[at:]))
        yield pd.DataFrame(out, columns=[key, "part", "values"])

    rows = df.select(key, "__value", "__seq").groupBy(key)
    return rows.applyInPandasWithState(step, f"`{key}` {kind}, part long, values array<{of}>", f"part long, held array<{of}>", "append", GroupStateTimeout.NoTimeout)


def global_windows(df: DataFrame, key: str, value: str, every: int, seq: str = "seq") -> DataFrame:
    """One window per key over all its rows, which never closes: (key, firing, n, last) at every ``every``-th row."""
    df, of = _typed(df, value, seq)
    read, kind = _values(of), df.schema[key].dataType.simpleString()

    def step(k, frames, state):
        seen, out = state.get[0] if state.exists else 0, []
        for x in read(_ordered(frames, ["__seq"])["__value"]):
            seen += 1
            if seen % every == 0:
                out.append((k[0], seen // every, seen, x))
        state.update((seen,))
        yield pd.DataFrame(out, columns=[key, "firing", "n", "last"])

    rows = df.select(key, "__value", "__seq").groupBy(key)
    return rows.applyInPandasWithState(step, f"`{key}` {kind}, firing long, n long, last {of}", "seen long", "append", GroupStateTimeout.NoTimeout)


@dataclass(frozen=True)
class WindowParams:
    """A window's length and slide, each as a number of rows or as microseconds, and its lag, for ``windows_by``."""

    length: int | None = None
    length_us: int | None = None
    slide: int | None = None
    slide_us: int | None = None
    lag_us: int = 0

    @classmethod
    def tumbling_count(cls, n: int) -> WindowParams:
        return cls(length=n, slide=n)

    @classmethod
    def sliding_count(cls, n: int, slide: int) -> WindowParams:
        return cls(length=n, slide=slide)

    @classmethod
    def tumbling_time(cls, us: int, lag_us: int = 0) -> WindowParams:
        return cls(length_us=us, slide_us=us, lag_us=lag_us)

    @classmethod
    def sliding_time(cls, us: int, slide_us: int, lag_us: int = 0) -> WindowParams:
        return cls(length_us=us, slide_us=slide_us, lag_us=lag_us)


def windows_by(df: DataFrame, params: WindowParams, ts: str, value: str, seq: str = "seq", key: str | None = None) -> DataFrame:
    """``event_windows`` with its policies as one value."""
    return event_windows(df, ts, value, params.lag_us, params.length, params.length_us, params.slide, params.slide_us, seq, key)


def custom(df: DataFrame, keys: list[str], step, out_schema, state_schema, mode: str = "append", timeout: str = GroupStateTimeout.NoTimeout) -> DataFrame:
    """A window or operator of the user's own: ``step(key, frames, state)`` yields frames."""
    return df.groupBy(*keys).applyInPandasWithState(step, out_schema, state_schema, mode, timeout)


def event_windows(
    df: DataFrame,
    ts: str,
    value: str,
    lag_us: int = 0,
    length: int | None = None,
    length_us: int | None = None,
    slide: int | None = None,
    slide_us: int | None = None,
    seq: str = "seq",
    key: str | None = None,
) -> DataFrame:
    """Event-time windows by any mix of policies: (key, kind, at, values).

    The window's length is a number of rows or a time, and so is the slide between firings. The watermark is the
    key's greatest timestamp minus the lag. Rows behind it when they arrive come out at once with kind ``late``; the
    others wait until the watermark reaches them and are handled in order of (timestamp, ``seq``):

    * a time slide fires at its multiples up to the watermark, ``at`` being that end, with the rows in ``(end -
      length_us, end]``, where empty windows are skipped, or with the last ``length`` rows up to the end;
    * a row slide fires at every ``slide``-th row, ``at`` being the number of the firing, with the last ``length``
      rows, or those after the row's time minus ``length_us``.
    """
    if (length is None) == (length_us is None) or (slide is None) == (slide_us is None):
        raise ValueError("name one length and one slide, each as rows or as a time")
    df, name, kind = _keyed(df.withColumn("__us", micros(df, ts)), key)
    df, of = _typed(df, value)
    read = _values(of)

    def step(k, frames, state):
        top, passed, fired, us, order, values = state.get if state.exists else (None, 0, None, [], [], [])
        rows, out = list(zip(_plain(us), _plain(order), _plain(values), strict=True)), []  # rows[:passed] are behind the watermark
        mark = None if top is None else top - lag_us
        frame = _ordered(frames, [seq])
        for s, v, t in zip(frame[seq], read(frame["__value"]), frame["__us"], strict=True):
            if mark is not None and t < mark:
                out.append((k[0], "late", int(t), [v]))
            else:
                rows.append((int(t), int(s), v))
                top = int(t) if top is None else max(top, int(t))
                mark = top - lag_us
        rows = rows[:passed] + sorted(rows[passed:], key=lambda r: r[:2])
        stamps = [r[0] for r in rows]  # in order; members are found by bisection, so a firing costs no more than its members

        def upto(end_us):
            return bisect_right(stamps, end_us)

        def members(end_us, stop):
            return rows[max(0, stop - length) : stop] if length is not None else rows[upto(end_us - length_us) : stop]

        ready = max(passed, upto(mark)) if mark is not None else passed
        if slide is not None:
            seen = fired or 0
            for i in range(passed, ready):
                seen += 1
                if seen % slide == 0:
                    out.append((k[0], "window", seen // slide, [r[2] for r in members(stamps[i], i + 1)]))
            fired, keep_us = seen, stamps[ready - 1] if ready else None
        else:
            if fired is None and rows:
                # Rows may yet come before the first one, but not behind the watermark.
                fired = min(-(-stamps[0] // slide_us) * slide_us - slide_us, mark // slide_us * slide_us)
            while rows and fired + slide_us <= mark:
                fired += slide_us
                inside = members(fired, upto(fired))
                if inside:
                    out.append((k[0], "window", fired, [r[2] for r in inside]))
                else:
                    # On to just before the next row's window, but not past the watermark: rows may yet come between.
                    after = upto(fired)
                    following = -(-stamps[after] // slide_us) * slide_us - slide_us if after < len(rows) else mark
                    fired = max(fired, min(following, mark // slide_us * slide_us))
            keep_us = fired
        need = max(0, ready - length) if length is not None else 0 if keep_us is None else min(ready, upto(keep_us - length_us))
        if slide_us is not None and length is not None:
            need = max(0, (upto(fired) if fired is not None else 0) - length)
        rows = rows[need:]
        state.update((top, ready - need, fired, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]))
        yield pd.DataFrame(out, columns=[name, "kind", "at", "values"])

    out = df.select(name, "__value", F.col(seq).alias(seq), "__us").groupBy(name).applyInPandasWithState(
        step,
        f"`{name}` {kind}, kind string, at long, values array<{of}>",
        f"top long, passed long, fired long, us array<long>, seq array<long>, v array<{of}>",
        "append",
        GroupStateTimeout.NoTimeout,
    )
    return out if key is not None else out.drop(name)
