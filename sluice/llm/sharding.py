"""Sharding by best-fit-decreasing bin packing of indivisible groups.

A group is all rows with one text. Groups are packed in order of falling size,
each into the bin with the tightest remaining capacity that still holds it; the
remaining capacities stand in a balanced search tree (a treap). ``pack`` is the
plain algorithm for a given capacity; ``level_pack`` gives each item above the average
of what remains a bin of its own and searches the least capacity (to 1/65536) at which the
other bins suffice for the other items, which makes the sizes of these near equal.

At scale the groups are too many for one task, so the packing has levels
and no data-dependent switch: with ``total`` the bytes of the groups that get no
shard of their own and ``shards`` the number of shards left for them, groups above
``total / (shards * fine)`` bytes (fewer than ``shards * fine`` of them, besides those
with a shard of their own) are packed as they are; smaller groups are
first packed, in cells dealt out by hash, into pallets of that capacity. A cell has at
most one pallet that is not half full, so there are at most ``2 * shards * fine`` pallets and
one per cell; while they are more than ``3 * shards * fine``, they are dealt into cells
and packed again. At most ``4 * shards * fine`` items, whatever the corpus, are
then packed into the shards on the driver.

Defined results: null text is a text of its own value of 0 bytes, in the group
of the empty text, with crc 0; rows that repeat go with their group; null ids
are allowed; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, spread, table


class CapacityTree:
    """A treap of (remaining capacity, bin) with insert, delete and ceiling in logarithmic time."""

    def __init__(self):
        self.root, self._state = None, 0x9E3779B9

    def _priority(self) -> int:
        self._state = (self._state * 1103515245 + 12345) & 0x7FFFFFFF
        return self._state

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            node[2], right = self._split(node[2], key)
            return node, right
        left, node[1] = self._split(node[1], key)
        return left, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[3] > b[3]:
            a[2] = self._merge(a[2], b)
            return a
        b[1] = self._merge(a, b[1])
        return b

    def insert(self, key) -> None:
        left, right = self._split(self.root, key)
        self.root = self._merge(self._merge(left, [key, None, None, self._priority()]), right)

    def delete(self, key) -> None:
        left, rest = self._split(self.root, key)
        _, right = self._split(rest, (key[0], key[1] + 1))
        self.root = self._merge(left, right)

    def ceiling(self, room: int):
        """The least key whose capacity is at least ``room``, or None."""
        node, best = self.root, None
        while node is not None:
            if node[0][0] >= room:
                best, node = node[0], node[1]
            else:
                node = node[2]
        return best


def pack(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """Best-fit-decreasing: (bin of each item, number of bins). An item above the capacity has a bin alone."""
    tree, bins, place = CapacityTree(), 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        size = sizes[i]
        found = tree.ceiling(size)
        if found is None:
            place[i] = bins
            tree.insert((max(0, capacity - size), bins))
            bins += 1
        else:
            place[i] = found[1]
            tree.delete(found)
            tree.insert((found[0] - size, found[1]))
    return place, bins


def own_bins(sizes: list[int], total: int, bins: int) -> tuple[int, int, int]:
    """(how many of the largest items get a bin of their own, bytes and bins left for all others).

    ``sizes`` fall and hold the ``bins - 1`` largest items at least, or all; ``total`` is of all items.
    """
    for k, size in enumerate(sizes):
        if size * bins <= total:
            return k, total, bins
        total, bins = total - size, bins - 1
    return len(sizes), total, bins


def level_pack(sizes: list[int], bins: int) -> list[int]:
    """Items above the average of what remains have a bin each; the others go by best-fit-decreasing at the least
    capacity found by bisection for which the other bins are enough."""
    order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
    alone, total, left = own_bins([sizes[k] for k in order], sum(sizes), bins)
    place = [0] * len(sizes)
    for k in range(alone):
        place[order[k]] = k
    rest = sorted(order[alone:])
    if not rest:
        return place
    items = [sizes[k] for k in rest]
    low = max(max(items), -(-total // left))
    high, best = low, None
    while best is None:
        found, used = pack(items, high)
        if used <= left:
            best = found
        else:
            low, high = high + 1, high + max(1, high // 64)
    while high - low > low >> 16:
        mid = (low + high) // 2
        found, used = pack(items, mid)
        if used <= left:
            best, high = found, mid
        else:
            low = mid + 1
    for k, p in zip(rest, best, strict=True):
        place[k] = alone + p
    return place


def _into_pallets(items: DataFrame, kind: str, capacity: int, cells: int) -> DataFrame:
    """(item, bytes) to (item, bytes, pallet): packed in cells dealt out by hash; no cell shares a pallet with another."""

    def pack_cell(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bytes", "item"], ascending=[False, True], ignore_index=True)
        place, _ = pack(frame["bytes"].tolist(), capacity)
        return pd.DataFrame({"item": frame["item"], "bytes": frame["bytes"], "pallet": [int(c) << 32 | p for c, p in zip(frame["cell"], place, strict=True)]})

    dealt = items.withColumn("cell", F.pmod(F.xxhash64("item"), F.lit(cells)).cast("int"))
    return materialize(dealt.groupBy("cell").applyInPandas(pack_cell, f"item {kind}, bytes long, pallet long"), "shard-pallets")


def pallets_of(groups: DataFrame, n: int, unit: int, limit: int, cell_groups: int) -> tuple[DataFrame, list]:
    """(item, bytes) of groups to (item, pallet), and [(pallet, bytes)] of some ``limit`` pallets at most, by the levels it takes."""
    cells = max(1, math.ceil(n / cell_groups))
    level = _into_pallets(groups, "binary", unit, cells)
    of_item = level.select("item", "pallet")
    while True:
        pallets = level.groupBy("pallet").agg(F.sum("bytes").alias("bytes"))
        n = pallets.count()
        if n <= limit or cells == 1:
            return of_item, [tuple(r) for r in pallets.orderBy("pallet").collect()]
        cells = min(cells - 1, math.ceil(n / cell_groups))
        level = _into_pallets(pallets.select(F.col("pallet").alias("item"), "bytes"), "long", unit, cells)
        higher = level.select(F.col("item").alias("pallet"), F.col("pallet").alias("higher"))
        of_item = of_item.join(higher, "pallet").select("item", F.col("higher").alias("pallet"))


def shard_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 8,
    fine: int = 1024,
    cell_groups: int = 50_000,
    slot_rows: int = 20_000,
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null)."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(
        spread(df.select(id_col, text_col)).select(
            F.col(id_col).cast("long").alias("id"),
            F.unhex(F.sha2(text, 256)).alias("key"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
        ),
        "shard-rows",
    )
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    totals = groups.agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).first()
    total, n_groups = totals["b"] or 0, totals["n"]
    top = [r["bytes"] for r in groups.select("bytes").orderBy(F.desc("bytes")).limit(shards).collect()]
    _, rest, left = own_bins(top, total, shards)
    unit = max(1, rest // (left * fine))
    large = groups.where(F.col("bytes") > unit)  # fewer than shards * fine rows, as the sizes of all but the own bins' add up to rest
    small = groups.where(F.col("bytes") <= unit).select(F.col("key").alias("item"), "bytes")
    of_item, pallets = pallets_of(small, n_groups, unit, 3 * left * fine, cell_groups)
    singles = [(bytes(r["key"]), r["bytes"]) for r in large.orderBy("key").collect()]
    place = level_pack([x[1] for x in singles + pallets], shards)
    of_large = spark.createDataFrame([(x[0], p) for x, p in zip(singles, place)], "key binary, shard int")
    of_pallet = spark.createDataFrame([(x[0], p) for x, p in zip(pallets, place[len(singles) :], strict=True)], "pallet long, shard int")

    # Both maps are bounded by shards * fine, see above: only these sides are broadcast. A hot text is a large group, so
    # the shuffled join below sees small groups only.
    hot = rows.join(F.broadcast(of_large), "key").select("id", "size", "crc", "shard")
    cold = (
        rows.join(F.broadcast(of_large), "key", "left_anti")
        .join(of_item.withColumnRenamed("item", "key"), "key")
        .join(F.broadcast(of_pallet), "pallet")
        .select("id", "size", "crc", "shard")
    )
    placed = materialize(hot.unionByName(cold), "shard-placed")
    return _slots(placed, max(1, math.ceil(placed.count() / (shards * slot_rows))))


def _slots(placed: DataFrame, parts: int) -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in ``parts`` pieces a shard so that none is one task's work."""
    cut = placed.withColumn("part", F.pmod(F.xxhash64("id", "crc", "size"), F.lit(parts)).cast("int"))
    counts = cut.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.select(
        "shard",
        "part",
        (F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"),
    )
    within = Window.partitionBy("shard", "part").orderBy("id", "crc")
    return (
        cut.withColumn("at", F.row_number().over(within))
        .join(before, ["shard", "part"])
        .select(
            F.col("id").alias("doc_id"),
            "size",
            F.col("crc").alias("text_crc32"),
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("before") + F.col("at") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op3_shard_groups(spark, sf_dir: str) -> DataFrame:
    return shard_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op3_shard_groups": op3_shard_groups}
ORACLE_SQL: dict[str, str] = {}  # the packing is an algorithm; tests compare with a brute-force version
