"""What the operators of this subpackage have in common: tables, checkpoints, words and hashes."""

from __future__ import annotations

import atexit
import ctypes
import functools
import shutil
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Functions of this package travel to the executors by value, so that a worker needs no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only where it is unset, one of our own."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not there:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            there = tempfile.mkdtemp(prefix="tidemark-")
            atexit.register(shutil.rmtree, there, ignore_errors=True)
        sc.setCheckpointDir(there)
    return there or sc.getCheckpointDir()


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tidemark-{what}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows go to the shared folder, where any executor can read them again.

    What was shuffled for them is then not needed any more, and deleted.
    """
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    rdd = df._jdf.queryExecution().toRdd()
    rdd.toDebugString()  # only dependencies that something has asked for are cleaned
    rdd.cleanShuffleDependencies(True)
    return out


def running_start(df: DataFrame, group: str, order: list[str], size: str, out: str, per_bucket: int = 2_000) -> DataFrame:
    """df has no columns whose names begin with _. Adds `out`, the sum of `size` over the rows of the same group that come before, by bucket and then by `order`.

    A group may hold any share of the rows: its rows are dealt to hash buckets of about `per_bucket` rows, the buckets'
    sums are accumulated (one small row a bucket), and each bucket is accumulated by itself.
    """
    buckets = max(1, -(-df.count() // per_bucket))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("long"))
    sums = df.groupBy(group, "_bucket").agg(F.sum(size).alias("_sum"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    joined = df.join(base, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn(out, F.col("_base") + F.col("_inside")).drop("_bucket", "_inside", "_g", "_b", "_base")


# ---- words and hashes, over the bytes of a whole Arrow column at once

ODD = np.uint64(0x9E3779B97F4A7C15)
PIECE = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rows_up_to(batch: pa.RecordBatch, column: str, most: int = 2 << 20):
    """Slices of a batch with about `most` bytes of text each; a longer text is a slice by itself."""
    texts = batch.column(batch.schema.get_field_index(column))
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at), pc.fill_null(texts.slice(at, to - at).cast(pa.large_string()), "")
        at = to


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a column of texts: start and end of each, and the first word of each text."""

    def __init__(self, text: pa.Array):
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = text.buffers()[2]
        self.bytes = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        at = offsets - offsets[0]
        inside = (self.bytes != 32) & ((self.bytes < 9) | (self.bytes > 13))
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        before[at[:-1][at[:-1] < len(inside)]] = False
        after = np.zeros(len(inside), bool)
        after[:-1] = inside[1:]
        after[at[1:][at[1:] > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, at)

    def lowered(self) -> np.ndarray:
        capital = (self.bytes >= 65) & (self.bytes <= 90)
        return self.bytes + (capital.view(np.uint8) << 5)

    def hashes(self, most_bytes: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, A-Z lower-cased; of its first bytes only if `most_bytes` is given."""
        low = self.lowered()
        ends = np.minimum(self.ends, self.starts + most_bytes) if most_bytes else self.ends
        out = np.empty(len(self.starts), np.uint64)
        a = 0
        while a < len(out):
            b = max(a + 1, int(np.searchsorted(self.ends, self.starts[a] + PIECE, side="right")))
            base = self.starts[a]
            part = low[base : self.ends[b - 1]].astype(np.uint64) + np.uint64(1)
            up, down = powers(len(part))
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * up[: len(part)], out=sums[1:])
            s, e = self.starts[a:b] - base, ends[a:b] - base
            out[a:b] = (sums[e] - sums[s]) * down[s]
            a = b
        return mix64(out ^ ((ends - self.starts).astype(np.uint64) * ODD))


def process_cache() -> dict:
    """What a Python worker keeps from task to task."""
    return sys.__dict__.setdefault("_tidemark_cache", {})


def give_back() -> None:
    """Returns to the system what this process has freed but holds: Arrow's pool and, where there is glibc, the C heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run):
    """A function of Arrow batches whose worker holds no freed memory once its task is over; workers live on between tasks."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    n, cache = max(n, PIECE + 64), process_cache()
    if "powers" not in cache or len(cache["powers"][0]) < n:
        base = 0x5851F42D4C957F2D
        pair = [np.full(n, np.uint64(x), np.uint64) for x in (base, pow(base, -1, 1 << 64))]
        for x in pair:
            x[0] = 1
        cache["powers"] = tuple(np.cumprod(x, dtype=np.uint64) for x in pair)
    return cache["powers"]


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each window of n consecutive word hashes."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        out += words[j : j + len(out)] * np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1) + 2 * j * j) & 0xFFFFFFFFFFFFFFFF | 1)
        out ^= out >> np.uint64(29)
    return mix64(out)
