"""Which pages of a listing or thread are read: ordered windows over narrow columns, never over page contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def listing_window(pages: DataFrame, by: str, order: str, newest: str, since) -> DataFrame:
    """Newest first, up to the first page that is older than the window (without it). Unknown dates don't stop."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    stop = F.coalesce((F.col(newest) < since).cast("int"), F.lit(0))
    return pages.withColumn("_stop", F.max(stop).over(before)).where("_stop = 0").drop("_stop")


def thread_window(pages: DataFrame, by: str, at: str, has_old: str, marks: DataFrame | None = None, most: int = 500) -> DataFrame:
    """From the last page backwards, up to the first that holds an old post or lies at the mark (with it).

    A mark beyond the newest page is ignored.
    """
    back = Window.partitionBy(by).orderBy(F.desc(at))
    before = back.rowsBetween(Window.unboundedPreceding, -1)
    met = pages if marks is None else pages.join(marks.select(by, F.col("mark").alias("_mark")), by, "left")
    newest = F.max(at).over(Window.partitionBy(by))
    ends = F.col(has_old).cast("int")
    if marks is not None:
        met = met.withColumn("_newest", newest)
        ends = F.greatest(ends, F.coalesce(((F.col(at) <= F.col("_mark")) & (F.col("_mark") <= F.col("_newest"))).cast("int"), F.lit(0)))
    met = met.withColumn("_ends", ends).withColumn("_before", F.coalesce(F.max("_ends").over(before), F.lit(0))).withColumn("_n", F.row_number().over(back))
    return met.where((F.col("_before") == 0) & (F.col("_n") <= most)).select(pages.columns)


def thread_walks(pages: DataFrame, marks: DataFrame | None = None, pager: str | None = None, most: int = 500) -> DataFrame:
    """topic_id, offs, newest, resumed_from, complete: the pages that a walk through each topic reads, from its newest page
    backwards, and whether the walk comes to an end.

    pages: topic_id, offs, has_old, and a column with the offsets in the page's pager, if named. A topic's page size is the
    smallest offset above zero (15 where there is none). A walk ends at the first page, at one that holds an old post, at
    the topic's mark (marks: topic_id, mark) or after `most` pages, each of them read. A page that isn't there cuts it
    short. A mark behind the newest page is that of a thread that was pruned, and is ignored.
    """
    topic, back = Window.partitionBy("topic_id"), Window.partitionBy("topic_id").orderBy(F.desc("offs"))
    told = F.array_append(F.coalesce(F.col(pager), F.array().cast("array<bigint>")), F.col("offs")) if pager else F.array("offs")
    rows = pages.select("topic_id", "offs", F.col("has_old").alias("_old"), F.array_min(F.filter(told, lambda o: o > 0)).alias("_least"), F.array_max(told).alias("_most"))
    rows = rows.groupBy("topic_id", "offs").agg(F.bool_or("_old").alias("_old"), F.min("_least").alias("_least"), F.max("_most").alias("_most"))
    if marks is not None:
        rows = rows.join(marks.select("topic_id", F.col("mark").alias("_mark")), "topic_id", "left")
    else:
        rows = rows.withColumn("_mark", F.lit(None).cast("long"))
    rows = rows.withColumn("_size", F.coalesce(F.min("_least").over(topic), F.lit(15))).withColumn("newest", F.floor(F.max("_most").over(topic) / F.col("_size")) * F.col("_size"))
    rows = rows.withColumn("resumed_from", F.when(F.col("_mark") <= F.col("newest"), F.col("_mark"))).where("offs % _size = 0")
    rows = rows.withColumn("_n", F.row_number().over(back)).where((F.col("offs") == F.col("newest") - (F.col("_n") - 1) * F.col("_size")) & (F.col("_n") <= most))
    ends = (F.col("offs") == 0) | F.coalesce("_old", F.lit(False)) | F.coalesce(F.col("offs") <= F.col("resumed_from"), F.lit(False)) | (F.col("_n") == most)
    rows = rows.withColumn("_ends", ends).withColumn("complete", F.bool_or("_ends").over(topic))
    rows = rows.withColumn("_over", F.coalesce(F.bool_or("_ends").over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))).where("not _over")
    return rows.select("topic_id", "offs", "newest", "resumed_from", "complete")


def high_water(read: DataFrame, by: str, at: str, page_size: int = 15) -> DataFrame:
    """by, mark: the newest offset read, floored to a page."""
    return read.groupBy(by).agg((F.floor(F.max(at) / page_size) * page_size).alias("mark"))


def bot_floods(rows: DataFrame, least: int = 6) -> DataFrame:
    """rows (page, starter, replies) without the unanswered ones of starters who have so many on a page. Rows
    whose starter isn't known stay."""
    flood = F.col("starter").isNotNull() & (F.count_if(F.col("replies") == 0).over(Window.partitionBy("page", "starter")) >= least)
    return rows.withColumn("_flood", flood).where(~(F.col("_flood") & F.col("replies").eqNullSafe(0))).drop("_flood")


def posts_in_window(posts: DataFrame, by: list[str], day: str, since) -> DataFrame:
    """by, kept, oldest, newest: posts of each page that aren't known to be older than the window, and its dates."""
    return posts.groupBy(*by).agg(F.count_if(~F.coalesce(F.col(day) < since, F.lit(False))).alias("kept"), F.min(day).alias("oldest"), F.max(day).alias("newest"))
