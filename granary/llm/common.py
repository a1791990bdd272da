"""What the corpus operators share: input tables, the shared folder, staged tables."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local session without the setting (tests) gets a temporary folder of its own.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(spark, "_granary_shared", None)
    if own is None:
        own = spark._granary_shared = "file://" + tempfile.mkdtemp(prefix="granary-")
    return own


def lean(spark: SparkSession) -> None:
    """Send texts to Python a thousand rows at once where the session has the default of ten thousand; tens of MB less in every worker and executor."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def release() -> None:
    """Give freed memory back to the system, as a Python worker lives on after its task (glibc only)."""
    gc.collect()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/granary/{name}-{uuid.uuid4().hex}"


def forget(spark: SparkSession) -> None:
    """Let shuffle files of finished steps go: they do when the JVM finds that nothing refers to them any more.

    Called before a step too, as a step's end is still referred to by the listeners right after it.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage is cut, and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    forget(spark)
    df.write.parquet(path)
    forget(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._granary_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again: what was made of them has been written."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._granary_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, order, name: str, label: str) -> DataFrame:
    """df with a column ``name`` that counts its rows from 0 in this order; a written table.

    The sorted partitions are written with their own counts; the driver adds one offset for each partition.
    """
    rows = staged(df.orderBy(order).withColumn("__own", F.monotonically_increasing_id()), label)
    counts = {r[0]: r[1] for r in rows.groupBy(F.shiftright("__own", 33)).count().collect()}
    at, offsets = 0, []
    for part in sorted(counts):
        offsets.append((part, at))
        at += counts[part]
    offset = rows.sparkSession.createDataFrame(offsets, "__part long, __offset long")
    low = F.col("__own").bitwiseAND(F.lit((1 << 33) - 1))
    found = rows.join(F.broadcast(offset), F.shiftright("__own", 33) == F.col("__part"))
    return found.withColumn(name, F.col("__offset") + low).drop("__own", "__part", "__offset")


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply), elementwise on uint64."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def as_long(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def slices(batches, column: int, most: int = 1 << 20):
    """The record batches in pieces whose texts or binaries in this column sum up to few MB (a single value may be larger)."""
    import pyarrow.compute as pc

    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < b.num_rows:
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield b.slice(begin, end - begin)
            begin = end
    release()
