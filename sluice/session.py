"""Sessions and the runtime context that functions can ask for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that every session of the library should have. Sizes of partitions are left to adaptive execution.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(name: str = "sluice", master: str | None = None, **conf) -> SparkSession:
    """A session with the library's settings; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def runtime_context(spark: SparkSession) -> dict:
    """What a job may ask of its surroundings on the driver: name, id, parallelism and settings."""
    sc = spark.sparkContext
    return {
        "application_id": sc.applicationId,
        "name": sc.appName,
        "parallelism": sc.defaultParallelism,
        "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
        "config": dict(sc.getConf().getAll()),
    }
