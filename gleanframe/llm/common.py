"""What the text operators share: the shared folder, cutting lineage, size-checked broadcasts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of (mostly) one or two longs that may be broadcast; beyond it, joins shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows of an Arrow batch of texts, where the session leaves Spark's default; rows and bytes worked on at a time in it.
BATCH_ROWS, PART_ROWS, PART_BYTES = 2000, 512, 1 << 20
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; a cluster without one is an error, since a folder of
    one machine would lose data there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder and read it back: its plan ends there, and a lost executor loses nothing."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete what cut() wrote for exactly this frame: only where nothing that reads it is still to run."""
    spark, path = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_or_not(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has few rows, and for a merge join otherwise: of files, Spark only knows how large
    they are on disk. Give it a df that is cheap to count, such as a cut one."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def in_batches(docs: DataFrame) -> DataFrame:
    """docs, whose texts go to Python in batches of BATCH_ROWS, unless the session says how large batches are."""
    if docs.sparkSession.conf.get(_BATCH) == "10000":
        docs.sparkSession.conf.set(_BATCH, str(BATCH_ROWS))
    return docs


def parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of texts that are worked on at a time: so many rows and bytes at most; a text that is longer
    is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        limit = (ends[start - 1] if start else 0) + PART_BYTES
        stop = max(start + 1, min(start + PART_ROWS, int(np.searchsorted(ends, limit, side="right"))))
        yield start, stop
        start = stop


def give_back() -> None:
    """At the end of a task: memory that is free in this Python worker goes back to the system. A worker that waits for
    other tasks lives on for a minute, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
