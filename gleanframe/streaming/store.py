"""Tables that stream batches keep: rows by key in folders by hash of the key, and a log of the steps of each batch.

Both are plain Parquet. A merge reads and rewrites only the folders that its keys fall into.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of a table. A batch of n keys rewrites n / BUCKETS of it at most.
BUCKETS = 4096


def _children(spark: SparkSession, path: str) -> list[str]:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []


def _delete(spark: SparkSession, path: str) -> None:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


class Buckets:
    """One row for each key, in `buckets` folders by hash of the key.

    A merge first writes the new contents of the folders that it touches beside the table, then puts them in place by an
    overwrite of just these partitions. What was cut short in between is put in place by the next merge or read.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _load(self, path: str, folders: list[str] | None = None) -> DataFrame:
        there = [c for c in _children(self.spark, path) if c.startswith("bucket=")]
        found = sorted(there if folders is None else set(there) & set(folders))
        if not found:
            return self.spark.createDataFrame([], f"{self.schema}, bucket int")
        paths = [path] if folders is None else [f"{path}/{f}" for f in found]
        return self.spark.read.schema(f"{self.schema}, bucket int").option("basePath", path).parquet(*paths)

    def _put(self) -> None:
        """Put in place what a merge has written as a whole; drop what it hasn't."""
        new = f"{self.path}/_new"
        if "_SUCCESS" in _children(self.spark, new):
            self._load(new).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        _delete(self.spark, new)

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """The table, or the folders that hold the given keys."""
        self._put()
        return self._load(self.path, None if keys is None else self._folders(keys)).drop("bucket")

    def _folders(self, keys: DataFrame) -> list[str]:
        # as many numbers as there are folders at most
        return [f"bucket={r[0]}" for r in keys.select(self._bucket()).distinct().collect()]

    def merge(self, rows: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Replace the folders of the rows' keys by merged(what they hold, rows); their number. merged keeps all keys, so
        that running it again on the same rows is all that a rerun needs."""
        folders = self._folders(rows)
        if folders:
            past = self.read(rows)
            out = merged(past, rows).withColumn("bucket", self._bucket())
            out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/_new")
            self._put()
        return len(folders)


class Steps:
    """What a batch has done so far: each step's rows in a folder of its own. A batch that runs again reads the steps that
    ended and goes on from there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def has(self, name: str) -> bool:
        return "_SUCCESS" in _children(self.spark, f"{self.path}/{name}")

    def step(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if not self.has(name):
            make().write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def mark(self, name: str) -> None:
        self.spark.createDataFrame([], "done boolean").write.mode("overwrite").parquet(f"{self.path}/{name}")
