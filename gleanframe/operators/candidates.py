"""Follow-up pages: which topics of a listing are opened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import formats, urls
from .dedupe import first_of, item_limit

# Parts of paths that lead to releases, and those of a site's furniture.
FOLLOWABLE = ("/download/", "/node/", "/release", "/album", "/threads/", "/topic")
FURNITURE = ("/genre/", "/tags/", "/taxonomy/", "/user", "/comment", "/search", "/rss", "/feed", "/collections", "/requests", "/privacy", "/contact", "/admin", "/misc/", "/sites/", "/modules/", "/themes/", "/files/")
BOARD_FURNITURE = r"^/(?:u\d+|f\d+(?:p\d+)?-)"
STATIC = r"\.(?:css|js|png|jpe?g|gif|svg|ico|woff2?|xml|zip|rar)$"
FURNITURE_EXACT = ("", "/", "/reuploads", "/collections", "/requests")


def topic(url: Column) -> Column:
    """The first page of a board's topic in one spelling, or null for all other urls."""
    smf = urls.board_id(url)
    return F.coalesce(urls.board_topic(url), F.when(smf["kind"] == "topic", F.concat(F.substring_index(url, "/", 3), F.lit("/index.php?topic="), smf["id"].cast("string"), F.lit(".0"))))


def _tier(url: Column) -> Column:
    """0: leads to a release; 1: may do so; null: a site's furniture or a file of its design."""
    path = F.lower(urls.path(url))
    follow, plain = topic(url).isNotNull(), ~F.rtrim(path, F.lit("/")).isin(*FURNITURE_EXACT)
    for p in FOLLOWABLE:
        follow = follow | F.contains(path, F.lit(p))
    for p in FURNITURE:
        plain = plain & ~F.contains(path, F.lit(p))
    return F.when(follow, 0).when(plain & ~path.rlike(BOARD_FURNITURE) & ~path.rlike(STATIC) & (F.length(F.trim(path, F.lit("/"))) > 3), 1)


def candidates(links: DataFrame, site: str, most: int = 40, lossless: bool = False, order: str = "item_id", base_url: str | None = None) -> DataFrame:
    """Of links (base_id, item_id, name, url) those to open, `most` for each base page, each topic once.

    Paths that lead to releases come first; only a base page that has none of these gets plausible ones. With lossless,
    titles that say so come before all that don't say lossy. The tier is decided for each base page on its own.
    base_url: a column with the base page's url, so that its links to itself are left out.
    """
    rows = links.where((urls.host_only(F.col("url")) == site) & ~urls.is_action(F.col("url")) & ~urls.is_known_file_host(F.col("url")))
    rows = rows.withColumn("url", F.substring_index("url", "#", 1)).withColumn("tier", _tier(F.col("url"))).withColumn("url", F.coalesce(topic(F.col("url")), "url"))
    rows = rows.withColumn("key", F.lower(F.rtrim("url", F.lit("/"))))
    if base_url is not None:
        here = F.lower(F.rtrim(urls.path(F.col(base_url)), F.lit("/")))
        rows = rows.where((here == "") | ~F.endswith("key", here))
    title = F.concat_ws(" ", "name", urls.path(F.col("url")))
    if lossless:
        rows = rows.withColumn("tier", F.when(formats.looks_lossless(title), F.col("tier")).when(~formats.looks_lossy(title), F.col("tier") + 2))
    rows = rows.where("tier is not null")
    rows = rows.withColumn("_best", F.min("tier").over(Window.partitionBy("base_id"))).where("tier = _best").drop("_best")
    return item_limit(first_of(rows, ["base_id", "key"], [order]), ["base_id"], [order], most)
