"""Posts of a content system: shared files, event categories, running numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import naming, recase, urls
from ..plans.cuts import cut
from ..sources.html import absolute, stored_nodes
from . import pages as P
from .dedupe import first_of, stepwise

#: Categories and group ids that are broadcast at most.
SMALL = 100_000


def own_shared_files(media: DataFrame) -> DataFrame:
    """media (post, ordinal, dir, url) with every file in one post only, and new running numbers.

    A file stays with the post that has most files of its folder, the first on a tie; weights are taken before any file
    is dropped.
    """
    once = media.groupBy("post", "dir", "url").agg(F.min("ordinal").alias("ordinal"))
    weight = once.groupBy("post", "dir").agg(F.count("*").alias("weight"))
    first = once.groupBy("post").agg(F.min("ordinal").alias("post_at"))
    met = once.join(weight, ["post", "dir"]).join(first, "post")
    kept = met.groupBy("url").agg(F.max_by(F.struct("post", "dir", "ordinal"), F.struct("weight", -F.col("post_at"))).alias("k")).select("url", "k.*")
    n = F.row_number().over(Window.partitionBy("post").orderBy("ordinal", "url"))
    return kept.withColumn("track", n).withColumn("total", F.count("*").over(Window.partitionBy("post")))


def event_category(posts: DataFrame, categories: DataFrame, roots: str) -> DataFrame:
    """id, event: of a post's categories below an event group, the one named earliest in its title, then by name.

    posts: id, title, category_ids. categories (a small dimension): id, name, parent. roots: a pattern of group names.
    """
    groups = categories.where(F.col("name").rlike(roots)).select(F.col("id").alias("parent"))
    small = F.broadcast if categories.limit(SMALL + 1).count() <= SMALL else lambda df: df
    events = categories.join(small(groups), "parent", "left_semi").select(F.col("id").alias("category"), F.col("name").alias("event"))
    met = posts.select("id", "title", F.explode("category_ids").alias("category")).join(small(events), "category")
    place = F.expr("locate(lower(event), lower(title))")
    rank = F.struct(F.when(place > 0, place).otherwise(1_000_000_000).alias("at"), "event")
    return met.groupBy("id").agg(F.min(rank).alias("r")).select("id", "r.event")


def add_library_images(shown: DataFrame, attached: DataFrame) -> DataFrame:
    """post, images: those shown in a post, then those attached to it but not shown."""
    both = shown.join(attached, "post", "full_outer")
    none = F.array().cast("array<string>")
    s, a = F.coalesce("shown", none), F.coalesce("attached", none)
    return both.select("post", F.array_distinct(F.concat(s, F.array_except(a, s))).alias("images"))


def named_entries(posts: DataFrame, attached: DataFrame | None = None, prefix: str | None = None) -> DataFrame:
    """post, role (track or image), n, url, caption, filename, folder, check: what each post offers, under its names.

    posts: id, link, title, content (html), and a column named by prefix with a nested folder, if given. attached: post,
    url of images in the library. Tracks are the post's players and links to files, in order, each file in one post only
    (own_shared_files); the first image is the cover, a thumbnail's link counts in its place, attached ones come last.
    Posts without a track of their own have no entries. check tells what a caption and an upload name disagree in.
    """
    pages = posts.select(F.col("id").alias("page_id"), F.col("link").alias("url"), F.col("content").alias("html"))
    nodes = stored_nodes(pages)
    base = pages.select("page_id", F.col("url").alias("base"))
    media = P.captions(nodes).join(base, "page_id").withColumn("url", absolute(F.col("base"), F.trim("url"))).where(urls.is_media(F.col("url")))
    media = first_of(media, ["page_id", "url"], ["pre"]).select(F.col("page_id").alias("post"), F.col("pre").alias("ordinal"), F.lower(F.regexp_replace(urls.path(F.col("url")), "/[^/]*$", "")).alias("dir"), "url", "caption")
    media = cut(media, "media")
    tracks = own_shared_files(media).join(media.select("post", "url", "caption"), ["post", "url"])

    links = nodes.where("tag = 'a'").select("page_id", F.col("pre").alias("parent"), F.col("attrs")["href"].alias("_to"))
    shown = nodes.where("tag = 'img'").join(links, ["page_id", "parent"], "left").join(base, "page_id")
    src = F.when(urls.is_image(F.coalesce("_to", F.lit(""))), F.col("_to")).otherwise(F.col("attrs")["src"])
    images = shown.select(F.col("page_id").alias("post"), F.lit(0).alias("turn"), "pre", absolute(F.col("base"), F.trim(src)).alias("url"))
    if attached is not None:
        images = images.union(attached.select("post", F.lit(1), F.xxhash64("url"), "url"))
    images = first_of(images.where(urls.is_image(F.coalesce("url", F.lit("")))), ["post", "url"], ["turn", "pre"])
    images = images.withColumn("j", F.row_number().over(Window.partitionBy("post").orderBy("turn", "pre", "url")) - 1)
    images = images.join(tracks.select("post").distinct(), "post", "left_semi")

    year = P.texts(nodes, nodes.where("parent is null").select("page_id", "pre", "end")).groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("item", "t")))["t"], " ").alias("t"))
    heads = posts.select(F.col("id").alias("post"), "title", *([F.col(prefix).alias("_prefix")] if prefix else [])).join(year.select(F.col("page_id").alias("post"), "t"), "post", "left")
    name = recase.folder_name(F.col("title"), naming.labelled_year(F.col("t")))
    parts = F.transform(F.filter(F.split(F.coalesce("_prefix", F.lit("")), "/"), lambda x: x != ""), naming.safe_component) if prefix else F.array().cast("array<string>")
    folders = heads.select("post", F.array_join(F.array_append(parts, name), "/").alias("folder"))

    u, said = F.col("url"), F.col("caption")
    titled = stepwise(tracks, recase.TITLE, "title", caption="caption", url="url")
    files = titled.select("post", F.lit("track").alias("role"), F.col("track").cast("long").alias("n"), "url", "caption", naming.file_name(F.col("track"), F.col("total"), F.col("title"), urls.extension(u)).alias("filename"), recase.disagreement(said, u).alias("check"))
    art = images.select("post", F.lit("image").alias("role"), F.col("j").cast("long").alias("n"), "url", F.lit("").alias("caption"), naming.cover_name(F.col("j"), u).alias("filename"), F.lit("").alias("check"))
    return files.union(art).join(folders, "post").select("post", "role", "n", "url", "caption", "filename", "folder", "check")
