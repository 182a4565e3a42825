"""Readers by name. Exports of content systems and release lists are data sources of Spark;
HTML families, feeds and these give items of one shape, counted on the way."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.urls import find_urls, normalise
from ..operators.items import READERS as FAMILIES
from . import tables

POSTS = "id long, date string, link string, title string, content string, categories array<long>, file string"
RELEASES = "label string, pos int, id string, name string, artists array<string>, catalog_number string, publish_date string, track_count int, url string, file string"
#: What every reader gives.
ITEMS = ("reader", "id", "name", "url", "published", "summary", "links")


#: Files and bytes of a partition at most; fewer files while there are few partitions.
FILES, BYTES, PARTITIONS = 256, 64 << 20, 64


def packed(sizes: list[tuple[str, int]], files: int = FILES, most: int = BYTES, partitions: int = PARTITIONS) -> list[list[str]]:
    """(path, bytes) of files -> the paths of each partition."""
    out: list[list[str]] = []
    held, files = 0, max(1, min(files, len(sizes) // partitions))
    for path, size in sizes:
        if not out or len(out[-1]) == files or held + size > most:
            out.append([])
            held = 0
        out[-1].append(path)
        held += size
    return out


class _Files(DataSourceReader):
    """Files of the folder, many small ones in one partition. What isn't JSON of the right shape gives no rows."""

    def __init__(self, path: str, rows: Callable[[object, str], Iterator[tuple]]):
        self.path, self.rows = path, rows

    def partitions(self):
        system, root = fs.FileSystem.from_uri(self.path if ":" in self.path else f"file://{self.path}")
        info = system.get_file_info(root)
        every = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        return [InputPartition(p) for p in packed([(f.path, f.size or 0) for f in every if f.is_file and f.base_name[0] not in "._"])]

    def read(self, partition):
        if partition is None:  # an empty folder
            return
        system, _ = fs.FileSystem.from_uri(self.path if ":" in self.path else f"file://{self.path}")
        for path in partition.value:
            with system.open_input_stream(path) as f:
                text = f.read().decode("utf-8", "replace")
            try:
                yield from self.rows(json.loads(text), path)
            except ValueError:
                continue


def _text(value) -> str | None:
    """A field that the system gives as it is or as {rendered: ...}."""
    value = value.get("rendered") if isinstance(value, dict) else value
    return value if isinstance(value, str) else None


def _posts(page, file: str) -> Iterator[tuple]:
    for p in page if isinstance(page, list) else [page]:
        if isinstance(p, dict) and isinstance(p.get("id"), int):
            groups = [c for c in p.get("categories") or [] if isinstance(c, int)]
            yield p["id"], _text(p.get("date")), _text(p.get("link")), _text(p.get("title")), _text(p.get("content")), groups, file


def _releases(found, file: str) -> Iterator[tuple]:
    """Those of a list that are revealed."""
    for one in found if isinstance(found, list) else [found]:
        if not isinstance(one, dict):
            continue
        rows = [r for r in one.get("releases") or [] if isinstance(r, dict)]
        shown = one.get("revealed")
        for i, r in enumerate(rows[: shown if isinstance(shown, int) else None]):
            number = r.get("track_count")
            yield one.get("label"), i, str(r.get("id")), _text(r.get("name")), [a for a in r.get("artists") or [] if isinstance(a, str)], _text(r.get("catalog_number")), _text(r.get("publish_date")), number if isinstance(number, int) else None, _text(r.get("url")), file


class CmsPosts(DataSource):
    """Pages of a content system's posts, as JSON files: spark.read.format("cms_posts").load(folder)."""

    @classmethod
    def name(cls) -> str:
        return "cms_posts"

    def schema(self) -> str:
        return POSTS

    def reader(self, schema) -> DataSourceReader:
        return _Files(self.options["path"], _posts)


class ReleaseLists(DataSource):
    """Lists of releases, as JSON files: spark.read.format("release_lists").load(folder)."""

    @classmethod
    def name(cls) -> str:
        return "release_lists"

    def schema(self) -> str:
        return RELEASES

    def reader(self, schema) -> DataSourceReader:
        return _Files(self.options["path"], _releases)


def registered(spark: SparkSession) -> SparkSession:
    for source in (CmsPosts, ReleaseLists):
        spark.dataSource.register(source)
    return spark


def _said(html):
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]*>", " "), r"\s+", " "))


def _links(url, html):
    return F.array_distinct(F.array_compact(F.transform(F.concat(F.array(url), find_urls(html)), normalise)))


def _items(df: DataFrame, reader: str, id, name, url, published, summary, links) -> DataFrame:
    return df.select(F.lit(reader).alias("reader"), id.cast("string").alias("id"), name.alias("name"), url.alias("url"), published.alias("published"), summary.alias("summary"), links.alias("links"))


def _cms(spark: SparkSession, path: str) -> DataFrame:
    p = registered(spark).read.format("cms_posts").load(path)
    return _items(p, "cms", F.col("id"), F.col("title"), F.col("link"), F.col("date"), F.left(_said(F.col("content")), F.lit(400)), _links(F.col("link"), F.col("content")))


def _lists(spark: SparkSession, path: str) -> DataFrame:
    r = registered(spark).read.format("release_lists").load(path)
    title = F.concat_ws(" - ", F.nullif(F.array_join("artists", ", "), F.lit("")), "name")
    return _items(r, "list", F.col("id"), title, F.col("url"), F.col("publish_date"), F.coalesce("catalog_number", F.lit("")), _links(F.col("url"), F.lit("")))


def _feeds(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("feed_url"), F.col("value").alias("xml"))
    e = tables.feed_entries(files)
    return _items(e, "feed", F.col("id"), F.col("name"), F.col("url"), F.col("published"), F.col("summary"), F.col("links"))


def _pages(family: str) -> Callable[[SparkSession, str], DataFrame]:
    def read(spark: SparkSession, path: str) -> DataFrame:
        found = FAMILIES[family](tables.read_pages(spark, path))
        none = F.lit(None).cast("string")
        return _items(found, family, F.concat_ws(":", "page_id", "item"), F.col("title"), none, none, F.col("summary"), F.col("urls"))

    return read


#: Readers by name: (spark, path) -> items. A reader of one's own is one more entry.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"cms": _cms, "list": _lists, "feed": _feeds} | {f: _pages(f) for f in FAMILIES}


class Watched:
    """Items of a reader, and what can be said of them once they have been used: no second scan."""

    def __init__(self, spark: SparkSession, reader: str, path: str):
        self.spark, self.reader, self.seen = spark, reader, Observation()
        empty = lambda c: F.coalesce(F.count_if(F.coalesce(F.col(c), F.lit("")) == ""), F.lit(0))
        counts = (F.count(F.lit(1)).alias("items"), empty("name").alias("without name"), empty("id").alias("without id"), F.coalesce(F.count_if(F.size("links") == 0), F.lit(0)).alias("without link"))
        self.items = READERS[reader](spark, path).observe(self.seen, *counts)

    def report(self) -> DataFrame:
        """reader, name, ok, detail. Only after an action on `items`, which it waits for."""
        found = self.seen.get
        rows = [(self.reader, name, bool(n) if name == "items" else not n, str(n)) for name, n in found.items()]
        return self.spark.createDataFrame(rows, "reader string, name string, ok boolean, detail string")
