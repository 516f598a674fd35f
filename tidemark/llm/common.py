"""What several corpus operators share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.  A local session without one (tests) gets a temporary folder; on a cluster it must be set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.match(r"local(\[|$)", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the cluster's checkpoint folder and go on from the copy."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Folders of written tables that are still there.
_left: set[tuple[SparkSession, str]] = set()


def written(df: DataFrame) -> DataFrame:
    """Like cut(), as a Parquet table, which is a fraction of a checkpoint's size for many narrow rows.

    It stays until discard(), or until the application ends.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    _left.add((spark, folder))
    return spark.read.parquet(folder)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete the folders of written() tables that nothing will read again; tables that came from elsewhere are left alone."""
    for df in tables:
        files = df.inputFiles()
        for spark, folder in list(_left):
            if any(f"/{folder.rsplit('/', 1)[1]}/" in f for f in files):
                remove(spark, folder)
                _left.discard((spark, folder))


@atexit.register
def _discard_all() -> None:
    for spark, folder in list(_left):
        with contextlib.suppress(Exception):  # the application may be gone already
            remove(spark, folder)


def release(spark: SparkSession, times: int = 1) -> None:
    """Let Spark delete the shuffle files of frames that nothing refers to any more; else they stay until the driver happens to collect.

    What Python lets go of reaches the JVM a moment later, so what must be gone before the next step takes two times.
    """
    for k in range(times):
        if k:
            time.sleep(0.1)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(run: Run) -> Run:
    """run, for mapInArrow, with what it let go of given back to the system after each task.

    Python workers stay for later tasks and stages; allocators keep freed memory, which no other process can use meanwhile.
    """

    def ran(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return ran


#: A key with over one in HOT of all rows, and over HOT_ROWS, is dealt out over several tasks; there are fewer than HOT such keys.
HOT, HOT_ROWS = 1024, 4096


def join_dealt(left: DataFrame, right: DataFrame, keys: list[str], *, count: str, total: int, by: list[str]) -> DataFrame:
    """left joined with right, which has each key once and in `count` its rows in left; total: the sum of these, or more.

    Rows of a hot key are dealt out by a hash of the columns `by`, and right's row is
    repeated for each share.  The hot keys are broadcast: there are fewer than HOT.
    """
    limit = max(HOT_ROWS, total // HOT)
    shares = F.ceil(F.col(count) / limit).cast("int")
    hot = right.where(F.col(count) > limit).select(*keys, shares.alias("_shares"))
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("_share", F.coalesce(F.pmod(F.xxhash64(*by), F.col("_shares")).cast("int"), F.lit(0))).drop("_shares")
    repeated = right.withColumn("_share", F.explode(F.sequence(F.lit(0), F.greatest(shares, F.lit(1)) - 1)))
    return dealt.join(repeated, [*keys, "_share"]).drop("_share")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, f) -> Column:
    """f(value), with value evaluated once however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def text_of(column: str = "text") -> Column:
    """The text, a null one being empty."""
    return F.coalesce(F.col(column), F.lit(""))


def text_key(column: str = "text") -> Column:
    """With doc_id, tells rows apart; rows alike in both have one result."""
    return F.xxhash64(text_of(column))


def hex_of(column: Column) -> Column:
    """16 lower-case hex digits of a long, as unsigned."""
    return F.lpad(F.lower(F.hex(column)), 16, "0")


#: Bits of a bitmap for each value, and the most longs that it has (8 MB).
FILTER_BITS, FILTER_MOST = 32, 1 << 20


def bitmap(hashes: DataFrame, n: int) -> tuple[Column, int]:
    """A scalar: an array of longs with a bit set for each of the n values of h, FILTER_BITS for each of them up to FILTER_MOST longs; and how many longs."""
    longs = min(FILTER_MOST, 1 << max(4, (n * FILTER_BITS // 64).bit_length()))
    word = F.shiftrightunsigned("h", 6).bitwiseAND(longs - 1).alias("i")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(63).cast("int"))
    held = hashes.select(word, bit.alias("b"))
    every = hashes.sparkSession.range(0, longs, 1, 1).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("b"))
    filled = held.unionByName(every).groupBy("i").agg(F.bit_or("b").alias("b"))
    row = filled.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "b"))), lambda x: x["b"]).alias("bits"))
    return row.select("bits").scalar(), longs


def maybe(bits: Column, longs: int, h: Column) -> Column:
    """Whether h's bit is set: true for all values of the bitmap, and for few others unless there are very many values."""
    word = F.get(bits, F.shiftrightunsigned(h, 6).bitwiseAND(longs - 1).cast("int"))
    return F.call_function("shiftrightunsigned", word, h.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
