"""Helpers shared by the corpus operators: tables, staged intermediates, prefix sums, text batches."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SPACE = r"[^\x20\x09-\x0D]+"
_OWN: dict[str, str] = {}
_STAGED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one of our own only on a local master, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN[key] = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, _OWN[key], ignore_errors=True)
    return f"file://{_OWN[key]}"


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder, removed with all that it still holds when the driver ends."""
    path = f"{shared_dir(spark)}/textloom/{spark.sparkContext.applicationId}"
    if path not in _STAGED:
        _STAGED.add(path)
        atexit.register(_removed, spark, path)
    return path


def _removed(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended before
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Frees shuffle files of finished steps now, instead of at the driver's next chance collection.

    The first collection ends the Python handles of finished plans, the second the plans and their shuffles.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def stage(df: DataFrame, heavy: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors.

    heavy: its plan shuffled a share of the whole input, which is freed at once.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    df.write.parquet(path)
    if heavy:
        release(spark)
    out = spark.read.schema(schema).parquet(path)
    out.staged_at = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Removes staged tables that no later plan reads."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_total(df: DataFrame, key: str, bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Exclusive running sum of value within key in the order (bucket, *order).

    Two levels, so that no task sorts a whole hot key: sums per (key, bucket) first, their running sum over
    the few buckets of a key, then a running sum inside each (key, bucket).
    """
    sums = df.groupBy(key, bucket).agg(F.sum(value).alias("_in_bucket"))
    upto = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col(key).alias("_k"), F.col(bucket).alias("_b"), F.coalesce(F.sum("_in_bucket").over(upto), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_here", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(before, F.col(key).eqNullSafe(F.col("_k")) & (F.col(bucket) == F.col("_b")))
        .withColumn(out, (F.col("_before") + F.col("_here")).cast("long"))
        .drop("_k", "_b", "_before", "_here")
    )


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a batch's texts end to end (null: empty), and the offset of each text, one more at the end."""
    column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 22):
    """(first, end) runs of texts of about `most` bytes in all; a longer text makes a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, end
        first = end


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """64-bit hash of each word; hashes of the most recent words are kept, at most a million."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


UPPER_TO_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
