"""Other inputs: stored pages, feeds, content-system JSON, release lists, list archives."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import find_urls, normalise

PAGES = "page_id long, url string, html string"
POSTS = "id long, date string, link string, title struct<rendered:string>, content struct<rendered:string>, categories array<long>"
MEDIA = "id long, post long, source_url string, mime_type string"
CATEGORIES = "id long, name string, parent long"
RELEASES = "label string, revealed int, releases array<struct<id:string,name:string,artists:array<string>,catalog_number:string,publish_date:string,track_count:int,url:string>>"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGES).parquet(path)


def stream_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(PAGES).parquet(path)


def feed_entries(feeds: DataFrame) -> DataFrame:
    """feeds (feed_url, xml) -> entries of RSS, RDF and Atom: id, name, url, author, published, summary (400 characters),
    links (its own url, then those in its text)."""
    item = "struct<guid:string,title:string,link:string,author:string,pubDate:string,description:string>"
    entry = "struct<id:string,title:string,link:array<struct<_href:string,_rel:string>>,author:struct<name:string>,published:string,updated:string,summary:string,content:string>"
    clean = F.regexp_replace("xml", r"(?s)^\s*<\?xml.*?\?>", "")
    rss = feeds.where(F.col("xml").rlike("(?i)<rss|<rdf")).withColumn("r", F.from_xml(clean, f"channel struct<item:array<{item}>>, item array<{item}>")).select("feed_url", F.posexplode(F.coalesce("r.channel.item", "r.item")).alias("pos", "e"))
    rss = rss.select("feed_url", "pos", F.coalesce("e.guid", "e.link").alias("id"), F.col("e.title").alias("name"), F.col("e.link").alias("url"), F.col("e.author").alias("author"), F.col("e.pubDate").alias("published"), F.col("e.description").alias("summary"))
    atom = feeds.where(F.col("xml").rlike("(?i)<feed")).withColumn("r", F.from_xml(clean, f"entry array<{entry}>")).select("feed_url", F.posexplode("r.entry").alias("pos", "e"))
    href = F.get(F.filter("e.link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]
    atom = atom.select("feed_url", "pos", F.coalesce(F.col("e.id"), href).alias("id"), F.col("e.title").alias("name"), href.alias("url"), F.col("e.author.name").alias("author"), F.coalesce("e.published", "e.updated").alias("published"), F.coalesce("e.summary", "e.content").alias("summary"))
    text = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("summary", F.lit("")), "<[^>]*>", " "), r"\s+", " "))
    said = F.regexp_replace(F.coalesce("summary", F.lit("")), "<[^>]*>", " ")
    links = F.array_distinct(F.array_compact(F.transform(F.concat(F.array("url"), find_urls(said)), normalise)))
    return rss.union(atom).withColumns({"links": links, "summary": F.left(text, F.lit(400))})


def read_cms(spark: SparkSession, posts: str, media: str, categories: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Posts; images by post; categories."""
    images = spark.read.schema(MEDIA).json(media, multiLine=True).where(F.col("mime_type").startswith("image/"))
    return spark.read.schema(POSTS).json(posts, multiLine=True), images, spark.read.schema(CATEGORIES).json(categories, multiLine=True)


def read_releases(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """The first `revealed` releases of each list, `most` at most."""
    lists = spark.read.schema(RELEASES).json(path, multiLine=True)
    rows = lists.select("label", F.coalesce("revealed", F.size("releases")).alias("revealed"), F.posexplode("releases").alias("pos", "r")).where(F.col("pos") < F.col("revealed"))
    return (rows if most is None else rows.where(F.col("pos") < most)).select("label", "pos", "r.*")


#: Kinds of archives, by the beginnings of their names.
ARCHIVES = ("linkcollector", "downloadList")


def newest_archives(paths: DataFrame, kinds: tuple[str, ...] = ARCHIVES) -> DataFrame:
    """kind, path: of each kind the archive with the highest number in its name; of equal ones the last by path. Contents
    are not looked at."""
    name = F.element_at(F.split("path", "/"), -1)
    number = F.regexp_extract(name, r"(\d+)\.zip$", 1)
    rows = paths.select("path", F.regexp_extract(name, "^([A-Za-z]+)", 1).alias("kind"), F.when(number != "", number.cast("decimal(38,0)")).alias("number"))
    return rows.where(F.col("kind").isin(*kinds)).groupBy("kind").agg(F.max_by("path", F.struct("number", "path")).alias("path"))


def _walk(value, out: list[str]):
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            out += [x for k, x in v.items() if k == "url" and isinstance(x, str)]
            stack += reversed(list(v.values()))
        elif isinstance(v, list):
            stack += reversed(v)


def _members(path: str, content: bytes) -> Iterator[tuple]:
    archive = zipfile.ZipFile(io.BytesIO(content))
    for member in archive.namelist():
        if member.startswith("extraInfo"):
            continue
        data = json.loads(archive.read(member))
        found: list[str] = []
        _walk(data, found)
        yield from ((path, member, u, None, None) for u in found)
        if "_" not in member and isinstance(data, dict) and data.get("name"):
            yield path, member, None, data["name"], data.get("downloadFolder")


def archive_rows(files: DataFrame) -> DataFrame:
    """files (path, content) -> path, member, url, name, folder: each url at any depth, and package rows of members
    without a suffix. What isn't a zip of JSON has no rows from there on."""
    columns = ["path", "member", "url", "name", "folder"]

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.path, batch.content):
                rows: list[tuple] = []
                try:
                    for row in _members(path, content):
                        rows.append(row)
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                except (zipfile.BadZipFile, ValueError, OSError):
                    pass
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(run, "path string, member string, url string, name string, folder string")


def read_archives(spark: SparkSession, folder: str, kinds: tuple[str, ...] = ARCHIVES) -> DataFrame:
    """Rows of the newest archive of each kind. Names alone are compared; only what is chosen is read, where it lies."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder)
    chosen = newest_archives(files.select("path"), kinds)  # a row for each of the kinds
    return archive_rows(files.select("path", "content").join(F.broadcast(chosen.select("path")), "path", "left_semi"))
