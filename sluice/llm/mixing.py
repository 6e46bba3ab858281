"""Mixing sources to target weights with hash-threshold histograms.

Sources in code-point order (null last) weigh 1, 2, 3, repeating. Together they
share 100 % of all words; a target stops at ``cap`` times its source's size and
the excess is shared again by weight. That is a water level: the target is
``least(cap * size, level * weight)``, and with the sources in order of
``cap * size / weight`` the level is the largest of ``(all words - caps before) /
weights from here on``.

A source takes every document ``floor(target / size)`` times, and once more the
documents whose hash lies under a threshold. The threshold comes from
histograms: sizes summed by source and leading hash bits, the bucket found in
which the rest of the budget runs out, and only that bucket refined by the next
bits, until it holds a single hash. Documents are then filtered; none is sorted.
A document on the threshold is taken if that brings the source nearer to its
target. Hashes are those of the id alone, so runs agree.

Defined results: null or empty text has size 0 and takes 0; a null source is a
source of its own; a source without words has target 0; rows with one id share
their hash and are taken together; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, materialize, spread, table

BITS, STEP = 48, 12
#: Per-source tables are broadcast up to so many sources (under 10 MB); beyond, they are shuffled.
BROADCAST_SOURCES = 50_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """(skey, source_size) to (skey, source_size, target). The windows hold one row per source."""
    every = Window.orderBy("skey")
    level = Window.orderBy("full", "skey")
    kinds = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("w", F.get(kinds, (F.row_number().over(every) - 1) % len(weights)).cast("long"))
    ranked = ranked.withColumn("full", F.col("source_size") * cap / F.col("w"))
    caps, shares = F.col("source_size") * cap, F.col("w")
    stepped = ranked.withColumns(
        {
            "used": F.sum(caps).over(level.rowsBetween(Window.unboundedPreceding, 0)) - caps,
            "left": F.sum(shares).over(level.rowsBetween(0, Window.unboundedFollowing)),
            "total": F.sum("source_size").over(Window.partitionBy()),
        }
    )
    stepped = stepped.withColumn("level", (F.col("total") - F.col("used")).cast("double") / F.col("left"))
    return stepped.select(
        "skey",
        "source_size",
        F.least(caps.cast("double"), F.max("level").over(Window.partitionBy()) * F.col("w")).alias("target"),
    )


def _hash48(col):
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit("null")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _skey(source_col: str):
    """Sorts as the source does by code point, with null last."""
    source = F.col(source_col).cast("string")
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def _few(plan: DataFrame):
    return F.broadcast if plan.count() <= BROADCAST_SOURCES else (lambda x: x)


def mix_bounds(rows: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """From (skey, size, h) per document: a row per source, (skey, source_size, target, base, edge).

    A document is taken ``base`` times, and once more if its hash is under ``edge``.
    """
    sizes = rows.groupBy("skey").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes, weights, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("base", whole)
    plan = materialize(plan.withColumn("budget", F.col("target") - F.col("base") * F.col("source_size")), "mix-plan")
    side = _few(plan)

    # (skey, prefix, before): the bucket in which the budget runs out, and the words under it.
    edge = plan.select("skey", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for used in range(STEP, BITS + 1, STEP):
        inside = rows.select("skey", "size", "h").join(side(edge), "skey").where(
            F.shiftright("h", BITS - used + STEP) == F.col("prefix")
        )
        bucket = F.shiftright("h", BITS - used)
        sums = inside.groupBy("skey", "budget", "before", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
        order = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        run = sums.withColumn("upto", F.col("before") + F.sum("n").over(order))
        # Half of the bucket's words beyond the budget decides, so the last level, a single hash, rounds to the nearest.
        over = F.col("upto") - (F.col("n") / 2 if used == BITS else 0) > F.col("budget")
        first = run.where(over).groupBy("skey", "budget").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("b"))).alias("m"))
        # Where no bucket is over, all of the refined bucket fits: the edge is its end.
        edge = materialize(
            edge.join(first.select("skey", "m"), "skey", "left").select(
                "skey",
                "budget",
                F.coalesce("m.bucket", F.shiftleft(F.col("prefix") + 1, STEP)).alias("prefix"),
                F.coalesce("m.b", "before").alias("before"),
            ),
            "mix-edge",
        )
    return plan.join(edge.select("skey", F.when(F.col("budget") > 0, F.col("prefix")).otherwise(0).alias("edge")), "skey").drop("budget")


def _sized(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return materialize(
        spread(df.select(id_col, text_col, source_col)).select(
            F.col(id_col).alias("id"),
            _skey(source_col).alias("skey"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            _hash48(F.col(id_col)).alias("h"),
        ),
        "mix-rows",
    )


def _times():
    return F.col("base") + F.when(F.col("h") < F.col("edge"), 1).otherwise(0)


def mix_sources(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken."""
    rows = _sized(df, id_col, text_col, source_col)
    bounds = mix_bounds(rows, weights, cap)
    return rows.join(_few(bounds)(bounds), "skey").select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * _times()).alias("taken")
    )


def take_mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3
) -> DataFrame:
    """The rows of ``df``, with all their columns, as often as the mix takes them."""
    bounds = mix_bounds(_sized(df, id_col, text_col, source_col), weights, cap)
    names = {c: f"mixed_{k}" for k, c in enumerate(df.columns)}  # any column of the input may share a name with ours
    marked = df.select(*[F.col(c).alias(n) for c, n in names.items()], _skey(source_col).alias("skey"), _hash48(F.col(id_col)).alias("h"))
    taken = marked.join(_few(bounds)(bounds), "skey").withColumn("copy", F.explode(F.array_repeat(F.lit(0), _times().cast("int"))))
    return taken.select(*[F.col(n).alias(c) for c, n in names.items()])


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


QUERIES = {"op8_mix_sources": op8_mix_sources}

MIX_SQL = """
r AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         CAST(len(regexp_extract_all(coalesce({text}, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS h
  FROM {docs}
), s AS (
  SELECT skey, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY encode(skey)) - 1) % 3 + 1 AS BIGINT) AS w
  FROM r GROUP BY skey
), v AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
         CAST(sum(source_size * 3) OVER (ORDER BY source_size * 3 / w, encode(skey) ROWS UNBOUNDED PRECEDING) - source_size * 3 AS BIGINT) AS used,
         CAST(sum(w) OVER (ORDER BY source_size * 3 / w, encode(skey) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest
  FROM s
), t AS (
  SELECT skey, source_size, least(CAST(source_size * 3 AS DOUBLE), max(CAST(total - used AS DOUBLE) / rest) OVER () * w) AS target FROM v
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS base FROM t
), c AS (
  SELECT r.doc_id, r.size, r.h, r.skey, b.source_size, b.target, b.base, b.target - b.base * b.source_size AS budget,
         CAST(sum(r.size) OVER (PARTITION BY r.skey ORDER BY r.h) AS BIGINT) AS upto,
         CAST(sum(r.size) OVER (PARTITION BY r.skey, r.h) AS BIGINT) AS peers
  FROM r JOIN b ON r.skey = b.skey
), m AS (
  SELECT doc_id, size, source_size, target,
         CAST(size * (base + CASE WHEN budget > 0 AND upto - peers / 2 <= budget THEN 1 ELSE 0 END) AS BIGINT) AS taken
  FROM c
)
"""

ORACLE_SQL = {
    "op8_mix_sources": "WITH " + MIX_SQL.format(docs="documents", text="text") + " SELECT doc_id, size, source_size, target, taken FROM m"
}
