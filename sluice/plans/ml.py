"""Iterative learners and sorts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sorting
from .iterate import iterate


def assign(points: DataFrame, centroids: DataFrame, features: str = "x") -> DataFrame:
    """points (.., x) with the ``cluster`` of the nearest of centroids (cluster, c); the least cluster wins ties.

    Centroids are gathered into one row of at most k * d numbers; points are not shuffled.
    """
    all_of = F.broadcast(centroids.agg(F.array_sort(F.collect_list(F.struct("cluster", "c"))).alias("__all")))
    distance = lambda k: F.aggregate(F.zip_with(F.col(features), k["c"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    best = F.array_min(F.transform("__all", lambda k: F.struct(distance(k).alias("d"), k["cluster"].alias("cluster"))))
    return points.crossJoin(all_of).withColumn("cluster", best["cluster"]).drop("__all")


def kmeans_step(points: DataFrame, centroids: DataFrame, features: str = "x") -> DataFrame:
    """New (cluster, c). A cluster without points keeps its centroid."""
    opened = assign(points, centroids, features).select("cluster", F.posexplode(features).alias("at", "v"))
    means = opened.groupBy("cluster", "at").agg(F.avg("v").alias("v"))
    moved = means.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda p: p["v"]).alias("__new"))
    return centroids.join(moved, "cluster", "left").select("cluster", F.coalesce("__new", "c").alias("c"))


def kmeans(points: DataFrame, centroids: DataFrame, rounds: int, features: str = "x") -> DataFrame:
    points = points.persist()
    try:
        return iterate(centroids, lambda c, _k: kmeans_step(points, c, features), rounds, every=1)  # every round is written, so points are done with
    finally:
        points.unpersist()


def train_svm(rows: DataFrame, alpha: float = 0.001, rounds: int = 1, label: str = "label", features: str = "x") -> DataFrame:
    """Linear SVM by sub-gradient steps within each partition, weights averaged: one row (w)."""

    def fit(frames):
        w = None
        held = [(f[label].to_numpy(), np.stack(f[features].to_numpy())) for f in frames if len(f)]
        for _ in range(rounds):
            for ys, xs in held:
                for y, x in zip(ys, xs, strict=True):
                    w = np.zeros(len(x)) if w is None else w
                    w = w - alpha * (w - y * x) if y * (w @ x) < 1 else w - alpha * w
        if w is not None:
            yield pd.DataFrame({"at": range(len(w)), "v": w})

    parts = rows.select(label, features).mapInPandas(fit, "at int, v double")
    means = parts.groupBy("at").agg(F.avg("v").alias("v"))
    return means.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda p: p["v"]).alias("w"))


def svm_accuracy(rows: DataFrame, model: DataFrame, label: str = "label", features: str = "x") -> DataFrame:
    margin = F.aggregate(F.zip_with(features, "w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    right = F.when(margin >= 0, 1.0).otherwise(-1.0) == F.col(label)
    return rows.crossJoin(F.broadcast(model)).agg(F.avg(right.cast("double")).alias("accuracy"))


def terasort(rows: DataFrame, key: str = "key", n: int | None = None) -> DataFrame:
    """Range-partitioned, each partition sorted by unsigned bytes."""
    out = rows.repartitionByRange(key) if n is None else rows.repartitionByRange(n, key)
    return out.sortWithinPartitions(key)


def terasort_check(rows: DataFrame, key: str = "key") -> DataFrame:
    return sorting.sort_check(rows, key)


def word_count(lines: DataFrame, column: str = "value") -> DataFrame:
    """Words between white space; map-side combined before the shuffle."""
    words = lines.select(F.explode(F.split(column, r"\s+")).alias("word")).where("word != ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))


def mds(distances: DataFrame, dim: int = 3, rounds: int = 100, tolerance: float = 1e-6, seed: int = 1, max_points: int = 200_000) -> tuple[np.ndarray, list[float]]:
    """Multidimensional scaling by majorisation: (point's coordinates by row number, stress of each round).

    ``distances`` is (i, d): for each point its distances to all points, in order. The matrix stays on the executors; a round
    sends them the coordinates, ``dim`` numbers for each of at most ``max_points`` points, and gets as many back.
    """
    n = distances.count()
    if n > max_points:
        raise ValueError(f"{n} points, where at most {max_points} may meet on the driver")
    if n == 0:
        return np.zeros((0, dim)), []
    spark, matrix = distances.sparkSession, distances.select("i", "d").persist()
    x = np.random.default_rng(seed).normal(size=(n, dim))
    stress: list[float] = []

    def moved(sent):
        def run(frames):
            at = sent.value
            for frame in frames:
                own, wanted = at[frame["i"].to_numpy()], np.stack(frame["d"].to_numpy())
                between = np.sqrt(np.maximum(((own**2).sum(1)[:, None] + (at**2).sum(1)[None, :] - 2 * own @ at.T), 0))
                pull = np.divide(wanted, between, out=np.zeros_like(wanted), where=between > 1e-12)
                new = (own * pull.sum(1)[:, None] - pull @ at) / len(at)
                yield pd.DataFrame({"i": frame["i"], "x": list(new), "off": ((between - wanted) ** 2).sum(1), "whole": (wanted**2).sum(1)})

        return run

    try:
        for _ in range(rounds):
            x = x - x.mean(axis=0)
            sent = spark.sparkContext.broadcast(x)
            got = matrix.mapInPandas(moved(sent), "i long, x array<double>, off double, whole double").toPandas()
            sent.unpersist()
            stress.append(float(got["off"].sum() / max(got["whole"].sum(), 1e-300)))
            x[got["i"].to_numpy()] = np.stack(got["x"].to_numpy())
            if len(stress) > 1 and stress[-2] - stress[-1] < tolerance * stress[-2] or stress[-1] < tolerance:
                break
    finally:
        matrix.unpersist()
    return x, stress
