"""Items of pages: candidates with title, summary, date and links; filtered, scored, deduplicated; with a fallback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls
from ..sources.fold import Rules, page_items
from ..sources.html import ABSOLUTE
from . import pages as P
from .dedupe import identified, normalised, stepwise
from .windows import bot_floods

# What the items of each kind of board are. A selector is (tag, attribute, how it compares, value), or two
# of these: an item, and what it lies in.
_c = lambda value, tag="": (tag, "class", "is", value)
SELECTORS = {
    "vBulletin": (("", "id", "starts", "post_message_"), _c("post_message"), _c("postbody"), _c("postcontent"), _c("postbit"), _c("postcontainer"), ("li", "id", "starts", "thread_"), _c("threadbit"), _c("discussion"), _c("tborder"), ("", "id", "is", "posts")),
    "XenForo": (_c("structItem"), _c("structItemContainer"), _c("message--post"), _c("block--messages"), _c("message-cell--main"), _c("p-body-content")),
    "MyBB": (_c("post_body"), _c("post_content"), _c("postbit-box"), _c("inline_row"), _c("forumdisplay_regular")),
    "Forumotion": (_c("post"), _c("postbody"), (_c("row", "li"), _c("topiclist", "ul"))),
    "phpBB": (_c("topiclist"), _c("topiclist_topics"), _c("post"), _c("postbody"), _c("forabg"), _c("forumbg")),
    "SMF": (_c("post", "div"), _c("list_posts", "div")),
    "SMF-board": ((("tr", "", "", ""), ("", "id", "is", "messageindex")), (("tr", "", "", ""), _c("table_grid", "table")), (("tr", "", "", ""), _c("bordercolor", "table"))),
    "Invision Community": (_c("ipsDataItem"), _c("ipsComment"), _c("ipsType_richText"), _c("ipsLayout_container"), _c("cTopic"), _c("ipsAreaBackground_light")),
    "web": (("article", "", "", ""), _c("post"), _c("entry"), _c("hentry")),
}
# Parts of paths of a board's threads.
THREADS = ("/thread", "/threads/", "/showthread", "/viewtopic", "/topic/")
DATA_LINKS = ("data-href", "data-url", "data-link", "data-download-url")


def _rules(family: str) -> Rules:
    return Rules(SELECTORS[family], P.FURNITURE_TAGS, P.SIGNATURE_CLASSES, P.TITLE_CLASSES, P.UI_WORDS, P.QUOTE_CLASSES, P.DISCOGS, DATA_LINKS, family == "SMF-board", P.PROFILE, r"topic[=,]\d+\.\d+")


def _links(rows: DataFrame) -> DataFrame:
    """Items as they are, each followed by rows of its links: (page_id, item, url, thread, file_key), dealt by page_id."""
    what = [c for c in rows.columns if c not in ("page_id", "base", "item", "hrefs")]
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in what]
    item = F.struct(F.lit(None).cast("string").alias("href"), *what)
    parts = rows.select("page_id", "base", "item", F.inline(F.concat(F.array(item), F.transform(F.array_distinct("hrefs"), lambda h: F.struct(h.alias("href"), *none)))))
    # a given number: rows that are small and dear to work on aren't gathered in fewer tasks
    parts = parts.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "page_id")
    # generators of one row, so that later steps and filters repeat nothing
    once = lambda df, *new: df.select("*", F.inline(F.array(F.struct(*new))))
    parts = stepwise(parts.withColumn("_href", F.trim("href")), ABSOLUTE, "url", base="base", href="_href").drop("_href")
    parts = normalised(parts, "url")
    parts = parts.where(F.col("href").isNull() | (F.col("url").isNotNull() & ~urls.truncated(F.col("url"))))
    parts = once(parts, F.lower(urls.path(F.col("url"))).alias("_path"), urls.board_id(F.col("url"))["kind"].alias("_kind"), urls.same_site(F.col("url"), F.col("base")).alias("_same"))
    path, thread = F.col("_path"), F.col("_kind").eqNullSafe("topic")
    for part in THREADS:
        thread = thread | F.contains(path, F.lit(part))
    thread = thread | (F.when(path.rlike("^/t[0-9]+(p[0-9]+)?-"), urls.board_topic(F.col("url"))).isNotNull())
    return identified(parts.withColumn("thread", F.col("_same") & thread).drop("_path", "_kind", "_same"))


def score(chars: Column, links: Column, preferred: Column) -> Column:
    return F.least(chars, F.lit(10_000)) + 1000 * links + F.when(preferred, 5000).otherwise(0)


def read_items(pages: DataFrame, family: str = "web", most: int = 100, least_chars: int = 30) -> DataFrame:
    """page_id, item, title, summary, links, downloads, threads, score, place, main, urls of each page's items, best first
    by `place`.

    Of a board, kept are items with a file or a thread of the site; of other pages, items with a link or a text of some
    length. Items with the same title and links are one. A page without a kept item is one item (main): its main part, if
    that has a link (on other pages than boards: or a text). A page is parsed once, where it is; its items and links meet
    in one exchange by page.
    """
    found = page_items(pages, _rules(family))
    title = F.coalesce("title", "page_title")
    if family == "SMF":
        title = F.coalesce(P.post_title(F.col("slug"), F.col("words")), title)
    hrefs = F.concat("hrefs", F.flatten(F.transform("said", urls.find_urls)))
    found = found.select("page_id", F.col("url").alias("base"), "item", "main", title.alias("title"), "chars", "summary", "starter", "replies", hrefs.alias("hrefs"))
    parts = _links(found).drop("base", "href")
    link = F.when(F.col("main").isNull(), F.struct("url", F.col("file_key").isNotNull().alias("file"), "thread", urls.plain_key(F.col("url")).alias("plain")))
    first = [F.max(c).alias(c) for c in ("main", "title", "chars", "summary", "starter", "replies")]
    each = parts.groupBy("page_id", "item").agg(*first, F.collect_set(link).alias("l"))
    number = lambda which: F.size(F.filter("l", which) if which else F.col("l")).cast("long")
    each = each.select("page_id", "item", "main", "title", "chars", "summary", "starter", "replies", number(None).alias("links"), number(lambda x: x["file"]).alias("downloads"), number(lambda x: F.coalesce(x["thread"], F.lit(False))).alias("threads"), F.array_sort(F.array_distinct("l.plain")).alias("urls"))
    if family == "SMF-board":
        each = bot_floods(each.withColumn("page", F.col("page_id"))).drop("page")
    useful = (F.col("downloads") > 0) | (F.col("threads") > 0) if family != "web" else (F.col("links") > 0) | (F.col("chars") >= least_chars)
    fallback = useful if family == "web" else F.col("links") > 0
    by_page = Window.partitionBy("page_id")
    each = each.withColumn("_any", F.bool_or(~F.col("main") & useful).over(by_page)).where(F.when(F.col("main"), ~F.col("_any") & fallback).otherwise(useful))
    each = each.withColumn("score", score(F.col("chars"), F.col("links"), F.col("downloads") > 0))
    same = Window.partitionBy("page_id", F.lower("title"), "urls").orderBy("item")
    once = each.withColumn("_n", F.row_number().over(same)).where("_n = 1")
    place = F.row_number().over(by_page.orderBy(F.desc("score"), "item"))
    return once.withColumn("place", place).where(F.col("place") <= most).select("page_id", "item", "title", "summary", "links", "downloads", "threads", "score", "place", "main", "urls")


#: Readers by name: pages -> items. A reader of one's own is one more entry.
READERS: dict[str, Callable[[DataFrame], DataFrame]] = {family: (lambda pages, f=family: read_items(pages, f)) for family in SELECTORS}


def preflight(pages: DataFrame) -> DataFrame:
    """name, ok, detail: what can be said of stored pages before they are read; never an error."""
    n = pages.agg(F.count("*").alias("n"), F.count_if(F.col("url").isNull()).alias("no_url"), F.count_if(F.coalesce(F.length("html"), F.lit(0)) == 0).alias("empty"), F.count_if(~F.coalesce(F.col("url"), F.lit("")).rlike("(?i)^https?://")).alias("odd"))
    check = lambda name, ok, detail: F.struct(F.lit(name).alias("name"), ok.alias("ok"), detail.cast("string").alias("detail"))
    rows = F.array(check("pages", F.col("n") > 0, F.col("n")), check("urls", F.col("no_url") == 0, F.col("no_url")), check("contents", F.col("empty") == 0, F.col("empty")), check("schemes", F.col("odd") == 0, F.col("odd")))
    return n.select(F.inline(rows))
