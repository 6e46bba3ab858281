"""Keyed equi-joins with a choice of type and algorithm. Null keys match nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}
#: "sort" and "hash" shuffle both sides; None leaves the choice to the optimiser, which broadcasts by its own size limit.
HINTS = {"sort": "merge", "hash": "shuffle_hash"}


def join(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner", algorithm: str | None = None) -> DataFrame:
    """``left`` and ``right`` by equal named columns, all matches per key."""
    if algorithm is not None:
        right = right.hint(HINTS[algorithm])
    return left.join(right, on, TYPES[how])


def keyed_join(left: DataFrame, right: DataFrame, how: str = "inner", algorithm: str | None = None, key: str = "key", value: str = "value") -> DataFrame:
    """(key, value) frames to (key, left, right)."""
    return join(left.select(key, F.col(value).alias("left")), right.select(key, F.col(value).alias("right")), key, how, algorithm)


def salted_join(left: DataFrame, right: DataFrame, on: str, salts: int, how: str = "inner") -> DataFrame:
    """Split each key of a skewed left side over ``salts`` partitions; the right side is repeated that often.

    Only for types that keep no unmatched right rows. Adaptive execution splits sort-merge joins by itself; this is for
    plans where it can't.
    """
    if how not in ("inner", "left", "semi", "anti"):
        raise ValueError(f"a salted {how} join would repeat unmatched rows of the right side")
    l = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))  # noqa: E741
    r = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return l.join(r, [on, "__salt"], TYPES[how]).drop("__salt")


def many_to_many_join(left: DataFrame, right: DataFrame, on: list[str] | str, block: int = 1024, pairs_per_task: int = 4_000_000) -> DataFrame:
    """An inner join of keys with many rows on both sides, dealt out by its pairs: a key is a grid of blocks, of about ``block`` rows of either side.

    Adaptive execution sizes partitions by what goes into a join, and so may leave few tasks with all that comes out of it.
    Each row is sent once per block of the other side, so the shuffle has two rows for ``block`` pairs. The rows of each key
    are counted first, and their pairs' number, one row, sets how many tasks there are. Equal rows of a side share a block.
    """
    on = [on] if isinstance(on, str) else on
    sides = [df.select(*on, F.lit(k == 0).cast("long").alias("__l"), F.lit(k == 1).cast("long").alias("__r")) for k, df in enumerate((left, right))]
    sizes = sides[0].unionAll(sides[1]).dropna(subset=on).groupBy(*on).agg(F.sum("__l").alias("__l"), F.sum("__r").alias("__r")).where("__l > 0 AND __r > 0")
    pairs = sizes.agg(F.sum(F.col("__l").cast("double") * F.col("__r"))).first()[0] or 0
    tasks = int(min(max(pairs / pairs_per_task, left.sparkSession.sparkContext.defaultParallelism), 10_000))
    grid = sizes.select(*on, F.ceil(F.col("__l") / block).alias("__down"), F.ceil(F.col("__r") / block).alias("__across"))

    def dealt(df, own, others, own_blocks, other_blocks):
        placed = df.join(grid, on).withColumn(own, F.pmod(F.xxhash64(*df.columns), own_blocks))
        sent = placed.withColumn(others, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other_blocks) - 1))).drop("__down", "__across")
        return sent.repartition(tasks, *on, "__row", "__column")

    l = dealt(left, "__row", "__column", F.col("__down"), "__across")  # noqa: E741
    r = dealt(right, "__column", "__row", F.col("__across"), "__down")
    return l.join(r, [*on, "__row", "__column"]).drop("__row", "__column")


def side_input(df: DataFrame, small: DataFrame, limit_rows: int = 100_000) -> DataFrame:
    """Every row of ``df`` with every row of a side input, whose size is checked before it is broadcast."""
    n = small.limit(limit_rows + 1).count()
    if n > limit_rows:
        raise ValueError(f"a side input has at most {limit_rows} rows; join it by a key instead")
    return df.crossJoin(F.broadcast(small))
