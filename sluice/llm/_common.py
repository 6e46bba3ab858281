"""Helpers shared by the operators of this subpackage.

Scratch tables: lineage is cut by writing Parquet below ``spark.checkpoint.dir``
(the folder every executor shares) and reading it back. A table of ours never
goes to a machine-local folder on a cluster; only where that setting is unset,
as in tests, is a temporary folder used.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.iterate import shared_folder

#: The white space of the contracts: \x20 and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for scratch tables, as a URI or path without a trailing slash; an error on a cluster without one."""
    return shared_folder(spark)


_written: list[str] = []


def clean_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables of this process, once no result that reads them is needed; returns their number.

    They can't go by themselves: a lazy result reads them whenever it runs, also again after an executor is lost.
    """
    n = len(_written)
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: a restart point for lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Inputs of up to so many bytes are dealt out if they come in few files.
SPREAD_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out over the cluster if it is small and comes in fewer files than there are cores.

    Such a file often has one row group, which a single task reads and then works on alone. Larger inputs are left as they are:
    they have row groups for every core, and no shuffle is worth its cost. Rows and results are the same either way.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    cores = df.sparkSession.sparkContext.defaultParallelism
    if size > SPREAD_BYTES or not 0 < len(df.inputFiles()) < cores:
        return df
    return df.repartition(min(cores, max(2, size >> 20)))


def ascii_lower(col):
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches of this session have ``rows`` rows, unless the session has a number of its own.

    With Spark's default of 10,000 a batch of documents takes tens of MB on both sides of each worker.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def slices(batch: pa.RecordBatch, column: int, limit: int = 2 << 20):
    """Cut a batch into runs of rows whose text in ``column`` has about ``limit`` bytes; a longer row stands alone.

    Keeps a Python worker's memory in proportion to ``limit`` and the longest single text.
    """
    n = batch.num_rows
    if n == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        before = ends[at] - sizes[at]
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def lower_ascii(texts: pa.Array) -> pa.Array:
    """A-Z lower-cased (bytes above 0x7F are left alone), nulls as empty texts."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    raw = np.frombuffer(data, dtype=np.uint8).copy() if data is not None else np.zeros(0, np.uint8)
    upper = (raw >= 65) & (raw <= 90)
    raw[upper] += 32
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(raw)], offset=texts.offset)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Split texts into maximal runs of non-space characters.

    Returns (number of words of each text, the word's index in the vocabulary for each word, vocabulary).
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat = lists.flatten()
    owner = pc.list_parent_indices(lists).to_numpy()
    real = pc.not_equal(pc.binary_length(flat), 0)
    coded = flat.filter(real).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    counts = np.bincount(owner[real.to_numpy(zero_copy_only=False)], minlength=len(texts)).astype(np.int64)
    return counts, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def hash_strings(values: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes (uint64) of the strings of an Arrow array, the same in every process."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(v, seed) for v in values.cast(pa.large_binary()).to_pylist()), dtype=np.uint64, count=len(values))


def starts_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)))[:-1] if len(counts) else np.zeros(0, np.int64)


def binary_words(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


