"""Packages for a downstream downloader: one job for each package, or one entry for each link with its file name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import job_safe
from .dedupe import first_of, identified


def packages(links: DataFrame, order: str, root: str = "", auto_start: bool = True) -> DataFrame:
    """package, and the six fields of its job: enabled, text (canonical urls, each file once, in order), packageName,
    downloadFolder, autoStart, autoConfirm; files. Packages without a usable link don't occur."""
    usable = first_of(identified(links).where("file_key is not null"), ["package", "file_key"], [order])
    listed = usable.groupBy("package").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "file_key", "canonical"))).alias("l"))
    return listed.select("package", F.array_join("l.canonical", "\n").alias("text"), *_fields(root, auto_start), F.size("l").alias("files"))


def _fields(root: str, auto_start: bool) -> list:
    name, yes = job_safe(F.col("package")), lambda c: F.lit("TRUE" if c else "FALSE")
    return [yes(True).alias("enabled"), name.alias("packageName"), F.concat(F.lit(root.rstrip("/") + "/"), name).alias("downloadFolder"), yes(auto_start).alias("autoStart"), yes(True).alias("autoConfirm")]


def named_entries(links: DataFrame, names: DataFrame, order: str, root: str = "", auto_start: bool = True) -> DataFrame:
    """A job for each link, with its file's name: package, its order, text (the url), the other fields, filename (null:
    none). names (url, filename) by canonical url."""
    usable = first_of(identified(links).where("file_key is not null"), ["package", "file_key"], [order])
    rows = usable.select("package", order, F.col("canonical").alias("text")).join(names.withColumnRenamed("url", "text"), "text", "left")
    return rows.select("package", order, "text", *_fields(root, auto_start), "filename")


def rejected(links: DataFrame) -> DataFrame:
    return identified(links).where("file_key is null")


def write_packages(jobs: DataFrame, path: str) -> None:
    """One folder of JSON for each package."""
    jobs.write.mode("append").partitionBy("package").json(path)
