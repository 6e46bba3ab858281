"""Stream windows over bounded data, with the same results as the streaming form.

Count windows need an order, and a key unless one global sequence is meant. Event-time windows are ``(end - length,
end]`` with ends at multiples of the slide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import micros

def _sequence(df: DataFrame, order: list, keys: list[str]) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def tumbling_count(df: DataFrame, n: int, order: list, keys: list[str] | None = None, name: str = "window_id") -> DataFrame:
    """Rows with the number of their window of ``n``, from 0. Rows of a last, partial window are not in the result."""
    keys = keys or []
    rows = _sequence(df, order, keys).withColumn(name, F.floor((F.col("__rn") - 1) / n))
    full = F.count("*").over(Window.partitionBy(*keys, name))
    return rows.withColumn("__full", full).where(F.col("__full") == n).drop("__rn", "__full")


def sliding_count(df: DataFrame, length: int, slide: int, order: list, measures: dict[str, Column], keys: list[str] | None = None, last: list[str] | None = None) -> DataFrame:
    """A row per firing, every ``slide`` rows, over the last ``length`` rows; the first windows are shorter.

    ``measures`` are aggregates over the window; ``last`` names columns of the row that fired it.
    """
    keys = keys or []
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(length - 1), 0)
    rows = df.withColumns({"__rn": F.row_number().over(Window.partitionBy(*keys).orderBy(*order)), **{n: m.over(frame) for n, m in measures.items()}})
    fired = rows.where(F.col("__rn") % slide == 0)
    return fired.select(*keys, (F.col("__rn") / slide).cast("long").alias("window_id"), *(last or []), *measures)


def event_time(df: DataFrame, ts: str, length: str, slide: str | None = None) -> DataFrame:
    """A row per row and window it is in, with ``window_end``. A timestamp on an edge belongs to the window it ends.

    Spark's windows are [start, end); shifting by the smallest tick, one microsecond, makes them (start, end].
    """
    tick = F.expr("INTERVAL 1 MICROSECOND")
    return df.withColumn("__w", F.window(F.col(ts) - tick, length, slide or length)).withColumn("window_end", F.col("__w.end")).drop("__w")


def event_count(df: DataFrame, length: int, slide: int, ts: str, order: list[str], measures: dict[str, Column], watermark: Column | None = None, keys: list[str] | None = None) -> DataFrame:
    """Count windows in event-time order over the rows that the watermark has passed."""
    ready = df if watermark is None else df.where(F.col(ts) <= watermark)
    return sliding_count(ready, length, slide, [ts, *order], measures, keys)


def length_by_count_slide_by_time(df: DataFrame, length: int, slide_us: int, ts: str, order: list[str], value: str, watermark_us: int, keys: list[str] | None = None) -> DataFrame:
    """At each multiple of the slide up to the watermark, the last ``length`` rows with ``ts`` at or before it.

    Fires once per slide boundary from the first row's on; each firing looks rows up by rank, not by a range join.
    """
    keys = keys or []
    rows = _sequence(df.withColumn("__us", micros(df, ts)), ["__us", *order], keys)
    end = (F.ceil(F.col("__us") / slide_us) * slide_us).cast("long")
    by_end = rows.groupBy(*keys, end.alias("end")).agg(F.max("__rn").alias("upto"))
    span = Window.partitionBy(*keys).orderBy("end")
    gaps = by_end.withColumn("next", F.coalesce(F.lead("end").over(span), F.lit(watermark_us // slide_us * slide_us + slide_us)))
    ends = F.sequence(F.col("end"), F.greatest(F.col("end"), F.col("next") - slide_us), F.lit(slide_us))
    fired = gaps.select(*keys, F.explode(ends).alias("window_end"), "upto").where(F.col("window_end") <= watermark_us)
    # The window's rows have ranks upto - length + 1 .. upto: an equi-join on exploded ranks.
    ranks = fired.select(*keys, "window_end", F.explode(F.sequence(F.greatest(F.col("upto") - length + 1, F.lit(1)), F.col("upto"))).alias("__rn"))
    return ranks.join(rows.select(*keys, "__rn", value), [*keys, "__rn"]).withColumnRenamed("__rn", "rank")


def length_by_time_slide_by_count(df: DataFrame, length_us: int, slide: int, ts: str, order: list[str], measures: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """At every ``slide``-th row in event-time order, the rows less than ``length_us`` before it, itself included."""
    keys = keys or []
    rows = _sequence(df.withColumn("__us", micros(df, ts)), [ts, *order], keys)
    frame = Window.partitionBy(*keys).orderBy("__us").rangeBetween(-(length_us - 1), 0)
    # Rows that tie with the one that fires but come after it are not yet in the window, so members go by rank.
    marked = rows.withColumn("__first", F.min("__rn").over(frame)).where(F.col("__rn") % slide == 0)
    fired = marked.select(*keys, F.col("__rn").alias("window_id"), F.explode(F.sequence("__first", "__rn")).alias("__rn"))
    return fired.join(rows, [*keys, "__rn"]).groupBy(*keys, "window_id").agg(*[m.alias(n) for n, m in measures.items()])


def late_rows(df: DataFrame, ts: str, order: str, lag_us: int, keys: list[str] | None = None, name: str = "is_late") -> DataFrame:
    """Whether each row, in arrival order, came behind the watermark: the greatest earlier timestamp minus the lag."""
    before = Window.partitionBy(*(keys or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    mark = F.max(micros(df, ts)).over(before) - lag_us
    return df.withColumn(name, F.coalesce(micros(df, ts) < mark, F.lit(False)))


def expired_rows(df: DataFrame, length: int, slide: int, order: list, value: str, keys: list[str] | None = None) -> DataFrame:
    """For each sliding count window the values that are new in it and those that left since the one before.

    A row is new in the window that fires at or after it and expires in the first window that no longer holds it.
    """
    keys = keys or []
    rows = _sequence(df, order, keys)
    total = rows.groupBy(*keys).agg(F.floor(F.count("*") / slide).alias("__fired"))
    new = F.ceil(F.col("__rn") / slide)
    gone = F.ceil((F.col("__rn") + length) / slide)
    marks = rows.select(
        *keys,
        value,
        "__rn",
        F.explode(F.array(F.struct(new.alias("window_id"), F.lit("new").alias("kind")), F.struct(gone.alias("window_id"), F.lit("expired").alias("kind")))).alias("__m"),
    )
    marks = marks.join(total, keys) if keys else marks.crossJoin(F.broadcast(total))
    return marks.where(F.col("__m.window_id") <= F.col("__fired")).select(*keys, "__m.window_id", "__m.kind", value)


def global_windows(df: DataFrame, every: int, order: list, value: str, keys: list[str]) -> DataFrame:
    """One window per key over all its rows, which never closes: (keys, firing, n, last) at every ``every``-th row."""
    rows = _sequence(df, order, keys).where(F.col("__rn") % every == 0)
    return rows.select(*keys, (F.col("__rn") / every).cast("long").alias("firing"), F.col("__rn").cast("long").alias("n"), F.col(value).alias("last"))


def session_windows(df: DataFrame, ts: str, gap: str, keys: list[str], **measures: Column) -> DataFrame:
    """Sessions that end after ``gap`` without a row."""
    return df.groupBy(*keys, F.session_window(ts, gap).alias("__s")).agg(*[m.alias(n) for n, m in measures.items()]).select(
        *keys, F.col("__s.start").alias("session_start"), F.col("__s.end").alias("session_end"), *measures
    )
