"""Roll-ups over links, histories and crawls; partial aggregation takes care of hosts that hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls


def per(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def per_bucket(links: DataFrame) -> DataFrame:
    """item_id and a count for each kind of link."""
    rows = links.withColumn("bucket", urls.bucket(urls.host_only(F.col("url"))))
    return rows.groupBy("item_id").agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in ("source", "build", "video", "forum", "other")])


def per_host(links: DataFrame, most: int) -> DataFrame:
    """host, links, downloads of the most frequent hosts."""
    found = links.groupBy(urls.host_only(F.col("url")).alias("host")).agg(F.count("*").alias("links"), F.count("file_key").alias("downloads"))
    return found.orderBy(F.desc("links"), "host").limit(most)


def crawl_records(seen: DataFrame) -> DataFrame:
    """crawl, pages, items, total, fresh, already_sent from annotated links (crawl, page_id, item_id, seen_before)."""
    return seen.groupBy("crawl").agg(F.count_distinct("page_id").alias("pages"), F.count_distinct("item_id").alias("items"), F.count("*").alias("total"), F.count_if(~F.col("seen_before")).alias("fresh"), F.count_if("seen_before").alias("already_sent"))


def job_rollup(crawls: DataFrame) -> DataFrame:
    """Of crawls (job, url, pages, links, fresh, already_sent, caught_up, error) one row for each job: sums, whether any
    has caught up, and the errors."""
    sums = [F.sum(c).alias(c) for c in ("pages", "links", "fresh", "already_sent")]
    errors = F.array_sort(F.collect_list(F.when(F.coalesce("error", F.lit("")) != "", F.concat_ws(": ", "url", "error"))))
    return crawls.groupBy("job").agg(*sums, F.bool_or("caught_up").alias("caught_up"), F.array_join(errors, "\n").alias("errors"))


def files_per(media: DataFrame, by: str, url: str = "url") -> DataFrame:
    return media.groupBy(by).agg(F.count_distinct(url).alias("files"))


def distinct_files(links: DataFrame) -> DataFrame:
    """files, hosts: how many different ones there are."""
    return links.agg(F.count_distinct("file_key").alias("files"), F.count_distinct(urls.host_only(F.col("url"))).alias("hosts"))


def file_sketches(links: DataFrame, by: str, batch: Column, bits: int = 14) -> DataFrame:
    """by, batch, sketch of the distinct files: a row that can be stored for each batch and merged later, of a size that
    the number of files doesn't change."""
    return links.groupBy(by, batch.alias("batch")).agg(F.hll_sketch_agg("file_key", F.lit(bits)).alias("sketch"))


def merged_files(sketches: DataFrame, by: str) -> DataFrame:
    """by, estimate: distinct files over all batches, each counted once."""
    return sketches.groupBy(by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
