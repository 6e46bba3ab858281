"""Iterative execution and restartable jobs."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``. Only a local master may do without: it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sluice-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder that all executors share, and read again: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def iterate(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], rounds: int, every: int = 5, until: Callable[[DataFrame, DataFrame], bool] | None = None) -> DataFrame:
    """Feed ``step``'s output back into it. Lineage is cut every few rounds, and each round if ``until`` compares them."""
    for k in range(rounds):
        new = step(state, k)
        if until is not None or (k + 1) % every == 0:
            new = cut(new)
        done = until is not None and until(state, new)
        state = new
        if done:
            break
    return state


class Variables:
    """Checkpointed driver variables: a small JSON file through Spark's file systems, committed as a whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.values = spark, path, {}
        found = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = found.getFileSystem(spark._jsc.hadoopConfiguration())
        spare = spark._jvm.org.apache.hadoop.fs.Path(path + ".old")
        if not self._fs.exists(found) and self._fs.exists(spare):
            found = spare  # a commit was cut off between its two renames
        if self._fs.exists(found):
            stream = self._fs.open(found)
            try:
                text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            self.values = json.loads(text)

    def init(self, name: str, value):
        """The committed value, or ``value`` at the first run."""
        return self.values.setdefault(name, value)

    def update(self, name: str, value) -> None:
        self.values[name] = value

    def commit(self) -> None:
        new, own, spare = (self.spark._jvm.org.apache.hadoop.fs.Path(self.path + x) for x in (".new", "", ".old"))
        stream = self._fs.create(new, True)
        stream.write(bytearray(json.dumps(self.values).encode()))
        stream.close()
        # The values of the commit before stay readable until the new ones are in place.
        if self._fs.exists(own):
            self._fs.delete(spare, False)
            self._fs.rename(own, spare)
        self._fs.rename(new, own)
        self._fs.delete(spare, False)


def connected(jobs: dict[str, Callable[[dict[str, DataFrame]], DataFrame]], inputs: dict[str, list[str]], parallel: int = 1) -> dict[str, DataFrame]:
    """Several dataflows that pass results by name, in order of their inputs; independent ones side by side."""
    done: dict[str, DataFrame] = {}
    left = dict(jobs)
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        while left:
            ready = [n for n in left if all(i in done for i in inputs.get(n, []))]
            if not ready:
                raise ValueError(f"jobs wait for each other or for nothing: {sorted(left)}")
            for n, df in zip(ready, pool.map(lambda n: cut(left[n]({i: done[i] for i in inputs.get(n, [])})), ready), strict=True):
                done[n] = df
                del left[n]
    return done
