"""Links, candidates, dates and next pages out of node tables. Windows are by page; containment is by intervals.

Joins are merges: their sides are as long as the pages, and none is sent to all tasks. Of nodes that are dealt by page
(html.stored_nodes) they need no exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates, urls
from ..sources.html import ABSOLUTE, absolute
from .dedupe import first_of, identified, normalised, stepwise
from .detect import guest_wall

# Tags that hold no release; signatures under posts; holders of a post's date; labels of next pages.
FURNITURE_TAGS = ("nav", "header", "footer", "aside", "script", "style", "noscript", "template", "svg")
SIGNATURE_CLASSES = ("signature", "signaturecontainer", "postbit_signature", "sig", "signature-container", "message-signature", "cAuthorPane_signature", "ipsComment_signature")
DATE_CLASSES = ("keyinfo", "post_date", "postdate", "author", "postdetails", "message-attribution", "date")
DATE_BEFORE = r"keyinfo|postdetails|post_date|postdate|author"
DATE_WITH_TIME = r"(?iu)\b\d{1,2}[/.-]\d{1,2}[/.-](?:\d{4}|\d{2}),?\s+\d{1,2}:\d\d|\b(?:hoy|ayer|today|yesterday)\b[^0-9]{0,12}\d{1,2}:\d\d|\b(?:19|20)\d\d-\d\d-\d\dT\d\d:\d\d"
NEXT_TEXT = r"(?iu)^(?:next(?:\s*page)?|siguiente|suivant|weiter|volgende|próxima|›|>|→)\s*[›»>→]?$"
NEXT_CLASS = r"(?i)(?:^|[-_ ])next(?:$|[-_ ])"
TITLE_CLASSES = ("structItem-title", "p-title-value", "ipsType_pageTitle", "topic-title", "topictitle", "threadtitle")
UI_WORDS = ("reply", "quote", "edit", "login")
DISCOGS = r"discogs\.com/(?:\w\w/)?(?:release|master)/\d+-([^\s/?#\"'<>]+)"
QUOTE_HEAD = r"(?iu)(?:Cita de|Quote from|Citation de|Zitat von):? .+? (?:en|on|le|am) \d\d?/\d\d?/\d\d(?:\d\d)?,? \d\d?:\d\d(?::\d\d)?(?: ?[ap]m)?"
QUOTE_CLASSES = ("quoteheader", "quotefooter", "topslice_quote", "botslice_quote")
PATH_OFFSET = r"^/([ft]\d+)(?:p(\d+))?-"
PROFILE = r"(?i)action=profile;u=(\d+)|/profile/|member\.php\?u=|/members/"
FEED_TYPES = ("application/rss+xml", "application/atom+xml", "application/rdf+xml")


def _page(first: int, last: int):
    """A frame of rows around a node of a page, in document order."""
    return Window.partitionBy("page_id").orderBy("pre").rowsBetween(first, last)


def outside(nodes: DataFrame, banned: Column) -> DataFrame:
    """nodes without the subtrees of banned ones: a running maximum of their ends, no join."""
    end = F.max(F.when(banned, F.col("end"))).over(_page(Window.unboundedPreceding, 0))
    return nodes.withColumn("_end", F.coalesce(end, F.lit(-1))).where(F.col("_end") < F.col("pre")).drop("_end")


def _classes(*names: str) -> Column:
    return F.arrays_overlap("classes", F.array(*map(F.lit, names)))


def inside(nodes: DataFrame, holders: Column, name: str) -> DataFrame:
    """nodes with `name`: whether a node is a holder or lies in one."""
    end = F.max(F.when(holders, F.col("end"))).over(_page(Window.unboundedPreceding, 0))
    return nodes.withColumn(name, F.coalesce(end >= F.col("pre"), F.lit(False)))


def without_furniture(nodes: DataFrame, kept: list | None = None) -> DataFrame:
    """nodes without navigation, scripts, signatures, and forms for a login or a search; kept: the columns to go on with,
    with page_id, pre and end (None: all).

    Other forms stay: some boards wrap each post in one. What tells furniture is worked out before the windows, so that
    these sort narrow rows.
    """
    a = F.col("attrs")
    form, kept = F.col("tag") == "form", kept or nodes.columns
    said = F.lower(F.concat_ws(" ", F.array_join("classes", " "), a["action"]))
    search = form & ((F.coalesce(a["role"], F.lit("")) == "search") | F.contains(said, F.lit("search")))
    signature = _classes(*SIGNATURE_CLASSES) | F.coalesce(F.col("id").rlike("^msg_.*_signature$"), F.lit(False))
    password = F.when((F.col("tag") == "input") & (F.lower(a["type"]) == "password"), F.col("pre"))
    rows = nodes.select(*kept, (F.col("tag").isin(*FURNITURE_TAGS) | search | signature).alias("_banned"), form.alias("_form"), password.alias("_password"))
    names = [c for c in rows.columns if c not in ("_banned", "_form", "_password")]
    rows = rows.withColumn("_passwords", F.collect_list("_password").over(Window.partitionBy("page_id")))
    login = F.col("_form") & F.exists("_passwords", lambda p: (p > F.col("pre")) & (p <= F.col("end")))
    return outside(rows, F.col("_banned") | login).select(*names)


def outermost(nodes: DataFrame, matches: Column) -> DataFrame:
    """Matching nodes that lie in no other matching one."""
    found = nodes.where(matches)
    before = F.max("end").over(_page(Window.unboundedPreceding, -1))
    return found.withColumn("_end", F.coalesce(before, F.lit(-1))).where(F.col("_end") < F.col("pre")).drop("_end")


def _owners(nodes: DataFrame, candidates: DataFrame) -> DataFrame:
    """nodes with `item`, the candidate that they lie in; candidates don't overlap."""
    marks = candidates.select("page_id", "pre", F.struct(F.col("pre").alias("item"), F.col("end").alias("till")).alias("_c"))
    met = nodes.join(marks.hint("merge"), ["page_id", "pre"], "left")
    held = F.last("_c", ignorenulls=True).over(_page(Window.unboundedPreceding, 0))
    return met.withColumn("_h", held).where(F.col("_h").isNotNull() & (F.col("pre") <= F.col("_h.till"))).withColumn("item", F.col("_h.item")).drop("_h", "_c")


def _with_posts(nodes: DataFrame, posts: DataFrame | Column) -> tuple[DataFrame, Column]:
    """nodes, and which of them are posts. Posts by a condition need no join; rows of posts are met with their nodes."""
    if isinstance(posts, Column):
        return nodes, posts
    marks = posts.select("page_id", "pre", F.lit(True).alias("_is_post"))
    return nodes.join(marks.hint("merge"), ["page_id", "pre"], "left"), F.coalesce("_is_post", F.lit(False))


def _holder(matches: Column) -> Column:
    """pre of the outermost matching node that a node is or lies in: of those begun so far, the one with the farthest end."""
    far = F.max(F.when(matches, F.struct("end", (-F.col("pre")).alias("less")))).over(_page(Window.unboundedPreceding, 0))
    return F.when(far["end"] >= F.col("pre"), -far["less"])


def _ended(matches: Column) -> Column:
    """Whether a node is or lies in a matching one."""
    end = F.max(F.when(matches, F.col("end"))).over(_page(Window.unboundedPreceding, 0))
    return F.coalesce(end >= F.col("pre"), F.lit(False))


def summaries(nodes: DataFrame, candidates: DataFrame, most: int = 400) -> DataFrame:
    """page_id, item, chars, summary: the text of each candidate in document order, without scripts."""
    parts = _owners(nodes, candidates).where(~F.col("tag").isin("script", "style", "template"))
    text = F.array_join(F.array_sort(F.collect_list(F.struct("pre", "text")))["text"], " ")
    whole = F.trim(F.regexp_replace(text, r"\s+", " "))
    return parts.groupBy("page_id", "item").agg(whole.alias("t")).select("page_id", "item", F.length("t").alias("chars"), F.left("t", F.lit(most)).alias("summary"))


def texts(nodes: DataFrame, holders: DataFrame) -> DataFrame:
    """page_id, item, t: the whole text of each holder (which don't overlap), in document order, single-spaced."""
    parts = _owners(nodes, holders).where(~F.col("tag").isin("script", "style", "template"))
    text = F.array_join(F.array_sort(F.collect_list(F.struct("pre", "text")))["text"], " ")
    return parts.groupBy("page_id", "item").agg(F.trim(F.regexp_replace(text, r"\s+", " ")).alias("t"))


def titles(nodes: DataFrame, candidates: DataFrame, page: DataFrame | None = None) -> DataFrame:
    """page_id, item, title: of the first heading or title class with three characters, else of the first anchor with
    five that isn't a button, else the page's title. page: page_id, page_title, if it is to be spelled otherwise than the
    nodes have it, such as in the letters of the source."""
    rank = F.when(F.col("tag").isin("h1", "h2", "h3"), F.substring("tag", 2, 1).cast("int")).when(_classes(*TITLE_CLASSES), 4).when(F.col("tag") == "a", 5)
    inner = _owners(nodes, candidates).withColumn("_r", rank)
    marks = outermost(inner, F.col("_r").isNotNull())
    said = texts(nodes, marks.select("page_id", "pre", "end")).withColumnRenamed("item", "pre")
    fits = F.when(F.col("_r") < 5, F.length("t") >= 3).otherwise((F.length("t") >= 5) & ~F.lower("t").isin(*UI_WORDS))
    first = marks.select("page_id", "item", "pre", "_r").join(said.hint("merge"), ["page_id", "pre"]).where(fits).groupBy("page_id", "item").agg(F.min_by("t", F.struct("_r", "pre")).alias("title"))
    if page is None:
        page = nodes.where("tag = 'title'").groupBy("page_id").agg(F.trim(F.regexp_replace(F.min_by("text", "pre"), r"\s+", " ")).alias("page_title"))
    every = candidates.select("page_id", F.col("pre").alias("item")).join(first.hint("merge"), ["page_id", "item"], "left").join(page.hint("merge"), "page_id", "left")
    return every.select("page_id", "item", F.coalesce("title", "page_title").alias("title"))


def post_titles(nodes: DataFrame, posts: DataFrame | Column, furniture: bool = True) -> DataFrame:
    """page_id, item, title: the release that a post links in a catalogue, else its first own words; quotes, labels of
    links and urls left out. posts: rows of posts, or which nodes are posts; furniture: False leaves it out first.

    Every part of a post is told on narrow rows before they are dealt by page, once: all windows share one sort."""
    nodes, post = _with_posts(nodes, posts)
    said = F.concat_ws(" ", F.map_values("attrs"), F.col("text"))
    slug = F.when(F.contains(said, F.lit("discogs.com/")), F.nullif(F.regexp_extract(said, DISCOGS, 1), F.lit("")))
    quote = (F.col("tag") == "blockquote") | _classes(*QUOTE_CLASSES)
    parts = [F.col("page_id"), F.col("pre"), F.col("end"), F.col("text"), slug.alias("slug"), quote.alias("_quote"), (F.col("tag") == "a").alias("_link"), post.alias("_post")]
    rows = nodes.select(*parts) if furniture else without_furniture(nodes, parts)
    rows = rows.withColumn("item", _holder(F.col("_post"))).where("item is not null")
    rows = rows.withColumns({"_quoted": _ended(F.col("_quote")), "_linked": _ended(F.col("_link"))})
    own = ~F.col("_quoted")
    words = F.collect_list(F.when(own & ~F.col("_linked") & (F.col("text") != ""), F.struct("pre", "text")))
    met = rows.groupBy("page_id", "item").agg(F.min_by("slug", F.when(own & F.col("slug").isNotNull(), F.col("pre"))).alias("slug"), F.array_join(F.array_sort(words)["text"], " ").alias("t"))
    return met.select("page_id", "item", post_title(F.col("slug"), F.col("t")).alias("title"))


def post_title(slug: Column, words: Column) -> Column:
    """A post's title from the name in a catalogue's url, else from its own words: 100 characters, null if there is none."""
    one = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    said = F.trim(one(F.substring_index(F.substring_index(F.regexp_replace(one(words), QUOTE_HEAD, " "), "http://", 1), "https://", 1)), F.lit(" .:-"))
    named = one(F.replace(urls.decoded(slug), F.lit("-"), F.lit(" ")))
    return F.nullif(F.left(F.coalesce(named, said), F.lit(100)), F.lit(""))


def row_starters(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """page_id, item, starter, replies of a board's rows: the member of the first cell that links a profile and no topic,
    and the first number in a later cell; null where there is none."""
    tops = rows.select("page_id", F.col("pre").alias("item"))
    cells = nodes.where("tag = 'td'").join(tops.withColumnRenamed("item", "parent"), ["page_id", "parent"]).select("page_id", "parent", "pre", "end")
    said = texts(nodes, cells).withColumnRenamed("item", "pre")
    href = F.coalesce(F.col("attrs")["href"], F.lit(""))
    member = F.when(href.rlike(PROFILE), F.struct(F.trim("text").alias("name"), href.alias("href")))
    found = _owners(nodes, cells).where("tag = 'a'").groupBy("page_id", F.col("item").alias("pre")).agg(F.min_by(member, F.when(href.rlike(PROFILE), F.col("pre"))).alias("m"), F.bool_or(href.rlike(r"topic[=,]\d+")).alias("topic"))
    every = cells.join(said.hint("merge"), ["page_id", "pre"], "left").join(found.hint("merge"), ["page_id", "pre"], "left")
    starts = F.col("m").isNotNull() & ~F.coalesce("topic", F.lit(False))
    in_row = Window.partitionBy("page_id", "parent")
    every = every.withColumn("_at", F.min(F.when(starts, F.col("pre"))).over(in_row))
    number = F.regexp_replace("t", "[.,]", "")
    number = F.when((F.col("pre") > F.col("_at")) & number.rlike(r"^\d{1,9}$"), number.cast("int"))
    name = F.coalesce(F.nullif(F.col("m.name"), F.lit("")), F.col("m.href"))
    by_row = every.groupBy("page_id", F.col("parent").alias("item")).agg(F.min_by(name, F.when(F.col("pre") == F.col("_at"), F.col("pre"))).alias("starter"), F.min_by(number, F.when(number.isNotNull(), F.col("pre"))).alias("replies"))
    return tops.join(by_row.hint("merge"), ["page_id", "item"], "left")


def page_links(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """page_id, pos, url: hrefs, then urls in text outside anchors, in scripts, in other attributes, then decoded twins;
    normalised, without truncated ones, first wins by case and closing slash.

    Each node gives one array of what it holds, so that pages are parsed once."""
    at = pages.select("page_id", F.col("url").alias("base"))
    raw = F.col("tag").isin("script", "style", "template")
    others = F.array_join(F.map_values(F.map_filter("attrs", lambda k, v: k != "href")), " ")
    listed = lambda turn, text: F.transform(urls.find_urls(text), lambda u, i: F.struct(F.lit(turn).alias("turn"), i.alias("i"), u.alias("url")))
    none = F.array().cast("array<struct<turn:int,i:int,url:string>>")
    text = F.when(raw, listed(2, F.col("text"))).when(F.col("tag") != "a", listed(1, F.col("text")))
    kept = nodes.where(F.col("attrs")["href"].isNotNull() | F.contains("text", F.lit("//")) | F.contains(others, F.lit("//")))
    met = stepwise(kept.join(at.hint("merge"), "page_id").withColumn("_href", F.trim(F.col("attrs")["href"])), ABSOLUTE, "_to", base="base", href="_href")
    href = F.when(F.col("_href").isNotNull(), F.array(F.struct(F.lit(0).alias("turn"), F.lit(0).alias("i"), F.col("_to").alias("url"))))
    # outer generators: of others the optimizer makes filters that compute the whole array again
    found = met.select("page_id", "pre", F.explode_outer(F.concat(F.coalesce(href, none), F.coalesce(text, none), listed(3, others))).alias("l")).where("l is not null").select("page_id", "pre", "l.*")
    twin = F.when(F.contains("url", F.lit("%")), urls.decoded(F.col("url")))
    both = F.array_compact(F.array(F.struct("turn", "url"), F.when(twin != F.col("url"), F.struct(F.lit(4).alias("turn"), twin.alias("url")))))
    every = found.select("page_id", "pre", "i", F.explode_outer(both).alias("l")).select("page_id", "l.turn", "pre", "i", "l.url")
    every = normalised(every, "url")
    every = every.where(F.col("url").isNotNull() & ~urls.truncated(F.col("url")))
    once = first_of(every.withColumn("key", urls.plain_key(F.col("url"))), ["page_id", "key"], ["turn", "pre", "i"])
    pos = F.row_number().over(Window.partitionBy("page_id").orderBy("turn", "pre", "i"))
    return once.select("page_id", pos.alias("pos"), "url")


def feed_links(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """page_id, feed: the first alternate link to a feed."""
    rows = nodes.where((F.col("tag") == "link") & F.contains(F.lower(F.col("attrs")["rel"]), F.lit("alternate")) & F.lower(F.col("attrs")["type"]).isin(*FEED_TYPES))
    first = rows.groupBy("page_id").agg(F.min_by(F.col("attrs")["href"], "pre").alias("href"))
    return first.join(pages.select("page_id", "url"), "page_id").select("page_id", absolute(F.col("url"), F.col("href")).alias("feed"))


def machine_day(a: Column) -> Column:
    """The day that attributes tell to machines: a datetime, or epoch seconds in one of three attributes (UTC)."""
    iso = F.try_to_date(F.left(a["datetime"], F.lit(10)), "yyyy-MM-dd")
    epoch = F.coalesce(a["data-time"], a["data-timestamp"], a["data-date"])
    return F.coalesce(iso, F.timestamp_seconds(F.when(epoch.rlike("^[0-9]{9,10}$"), epoch).cast("long")).cast("date"))


def machine_dates(nodes: DataFrame) -> DataFrame:
    """page_id, day: the first day told to machines."""
    return nodes.withColumn("day", machine_day(F.col("attrs"))).where("day is not null").groupBy("page_id").agg(F.min_by("day", "pre").alias("day"))


def post_dates(nodes: DataFrame, posts: DataFrame | Column, as_of: Column, post: Column | None = None) -> DataFrame:
    """page_id, item, day: the date that a post was written; null if nothing tells it. posts: rows of posts, or which nodes
    are posts; post: the same of all that count as posts, of the given ones or not (None: div.post).

    In order: a machine date in the post; a holder of dates in it; the last holder before it; and the nearest date with a
    time before it that stands in no post and has no other post behind it. Quotes never count, nor do dates that a member
    merely writes.

    Marks are told on narrow rows before they are dealt by page, once; a holder's text is gathered where its marks are, so
    that nothing is joined.
    """
    nodes, begins = _with_posts(nodes, posts)
    post = F.array_contains("classes", "post") & (F.col("tag") == "div") if post is None else post
    dated = F.array_join("classes", " ").rlike(DATE_BEFORE)
    holder = (F.col("tag") == "time") | _classes(*DATE_CLASSES) | dated
    rows = nodes.select(
        "page_id", "pre", "end", (F.col("tag") == "blockquote").alias("_quote"), post.alias("_post"), begins.alias("_begins"), holder.alias("_holder"), dated.alias("_dated"),
        machine_day(F.col("attrs")).alias("machine"), F.when(F.col("text") != "", F.col("text")).alias("text"), F.col("tag").isin("script", "style", "template").alias("_raw"), F.col("text").rlike(DATE_WITH_TIME).alias("_timed"),
    )
    rows = rows.where(F.col("_quote") | F.col("_post") | F.col("_begins") | F.col("_holder") | F.col("machine").isNotNull() | F.col("text").isNotNull())
    rows = rows.withColumns({"_quoted": _ended(F.col("_quote")), "_in_post": _ended(F.col("_post")), "item": _holder(F.col("_begins"))})
    rows = rows.withColumn("_at", _holder(F.col("_holder") & ~F.col("_quoted")))
    # what is dear to tell stands in no filter
    rows = rows.withColumn("_timed", F.col("_timed") & ~F.col("_quoted") & ~F.col("_in_post")).withColumn("_holds", F.coalesce(F.col("_at") == F.col("pre"), F.lit(False)))
    first = F.col("_begins") & (F.col("item") == F.col("pre"))
    rows = rows.withColumn("_first", F.coalesce(first, F.lit(False)))
    told = F.col("_first") | F.col("_post") | F.col("_holds") | F.col("machine").isNotNull() | F.col("_timed")
    mark = F.struct("pre", "item", "_first", "_post", "_dated", "machine", "_holds", F.when(F.col("_timed"), F.col("text")).alias("_late"))
    # each holder with the marks in it; other marks on their own
    words = F.collect_list(F.when(F.col("_at").isNotNull() & F.col("text").isNotNull() & ~F.col("_raw"), F.struct("pre", "text")))
    gathered = rows.where(told | F.col("_at").isNotNull()).groupBy("page_id", F.coalesce("_at", "pre").alias("_at")).agg(words.alias("_words"), F.collect_list(F.when(told, mark)).alias("_marks"))
    said = F.trim(F.regexp_replace(F.array_join(F.array_sort("_words")["text"], " "), r"\s+", " "))
    rows = gathered.select("page_id", said.alias("_said"), F.inline("_marks"))
    rows = rows.withColumn("held", F.when(F.col("_holds"), dates.parse_date(F.col("_said"), as_of)))
    rows = rows.withColumn("_here", F.when(F.col("_late").isNotNull(), F.struct("pre", dates.parse_date(F.col("_late"), as_of).alias("day"))))
    before = _page(Window.unboundedPreceding, -1)
    prior = F.last(F.when(F.col("_holds") & F.col("_dated"), F.struct("held")), ignorenulls=True).over(before)["held"]
    rows = rows.withColumns({"_prior": prior, "_loose": F.last("_here", ignorenulls=True).over(before), "_last_post": F.max(F.when(F.col("_post"), F.col("pre"))).over(before)})
    ahead = F.when(F.coalesce(F.col("_last_post") < F.col("_loose.pre"), F.lit(True)), F.col("_loose.day"))
    nearest = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pre")))
    out = rows.where("item is not null").groupBy("page_id", "item").agg(nearest("machine").alias("machine"), nearest("held").alias("held"), F.max(F.when(F.col("_first"), F.coalesce("_prior", ahead))).alias("_head"))
    return out.select("page_id", "item", F.coalesce("machine", "held", "_head").alias("day"))


def topic_pages(pages: DataFrame, nodes: DataFrame, posts: DataFrame, as_of: Column, since: Column) -> DataFrame:
    """page_id, topic_id, offs, pager, has_old of a board's topic pages: where a page stands, what other pages of its topic
    it links, and whether it holds a post older than since."""
    at = pages.withColumn("here", urls.board_id(F.col("url"))).where("here.kind = 'topic'").select("page_id", "url", F.col("here.id").alias("topic_id"), F.col("here.at").alias("offs"))
    to = nodes.where("tag = 'a' and attrs['href'] is not null").select("page_id", F.col("attrs")["href"].alias("href")).join(at.hint("merge"), "page_id").select("page_id", "topic_id", urls.board_id(absolute(F.col("url"), F.col("href"))).alias("there"))
    linked = to.where("there.kind = 'topic' and there.id = topic_id").groupBy("page_id").agg(F.array_sort(F.collect_set("there.at")).alias("pager"))
    old = post_dates(nodes, posts, as_of).groupBy("page_id").agg(F.coalesce(F.bool_or(F.col("day") < since), F.lit(False)).alias("has_old"))
    met = at.join(linked.hint("merge"), "page_id", "left").join(old.hint("merge"), "page_id", "left")
    return met.select("page_id", "topic_id", "offs", "pager", F.coalesce("has_old", F.lit(False)).alias("has_old"))


def authors(nodes: DataFrame, posts: DataFrame | Column) -> DataFrame:
    """page_id, item, author, author_id of each post: the first link to a member's profile between it and the post before,
    else the first behind it and before the next. Those in posts, quotes and signatures are no author's. posts: rows of
    posts, or which nodes are posts. Only posts, links to members, quotes and signatures are dealt by page, once."""
    nodes, post = _with_posts(nodes, posts)
    href = F.col("attrs")["href"]
    number = F.nullif(F.regexp_extract(href, r"(?i)(?:u=|/members/(?:[^/]*\.)?|/profile/)(\d+)", 1), F.lit("")).cast("long")
    member = F.when((F.col("tag") == "a") & href.rlike(PROFILE), F.struct(F.trim("text").alias("author"), number.alias("author_id")))
    silent = _classes(*SIGNATURE_CLASSES) | (F.col("tag") == "blockquote")
    rows = nodes.select("page_id", "pre", "end", post.alias("_post"), silent.alias("_silent"), member.alias("_member"))
    rows = rows.where(F.col("_post") | F.col("_silent") | F.col("_member").isNotNull())
    rows = rows.withColumns({"_top": _holder(F.col("_post")), "_out": _ended(F.col("_silent"))}).where(~F.col("_out"))
    begun = F.when(F.col("_post") & (F.col("_top") == F.col("pre")), F.struct(F.col("pre").alias("item"), F.col("end").alias("till")))
    rows = rows.withColumn("_held", F.last(begun, ignorenulls=True).over(_page(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_member", F.when(~F.coalesce(F.col("pre") <= F.col("_held.till"), F.lit(False)), F.col("_member")))
    # each post with what stands in the interval before it, and in the one behind it
    by_gap = rows.groupBy("page_id", F.coalesce("_held.item", F.lit(-1)).alias("gap")).agg(F.min_by("_member", F.when(F.col("_member").isNotNull(), F.col("pre"))).alias("_m"))
    order = Window.partitionBy("page_id").orderBy("gap")
    near = by_gap.withColumns({"_before": F.lag("_m").over(order)})
    return near.where("gap >= 0").select("page_id", F.col("gap").alias("item"), F.coalesce("_before", "_m").alias("_a")).select("page_id", "item", "_a.author", "_a.author_id")


def next_pages(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """page_id, next: the page after each page that has one.

    Boards that count by offsets have the last word on their own pages: the smallest larger offset of the same topic or
    board. Elsewhere rel=next, a link labelled as next (unless it leads back), then the page with the next number.
    """
    at = pages.select("page_id", F.col("url").alias("base"))
    said = texts(nodes, outermost(nodes, F.col("tag") == "a").select("page_id", "pre", "end")).select("page_id", F.col("item").alias("pre"), "t")
    above = nodes.select("page_id", F.col("pre").alias("parent"), F.array_join("classes", " ").alias("_above"))
    links = nodes.where("tag in ('a', 'link') and attrs['href'] is not null").join(at.hint("merge"), "page_id")
    links = links.join(said.hint("merge"), ["page_id", "pre"], "left").join(above.hint("merge"), ["page_id", "parent"], "left")
    a, base, to = F.col("attrs"), F.col("base"), F.col("to")
    links = links.withColumn("to", absolute(base, a["href"])).withColumn("t", F.coalesce("t", F.lit("")))
    anchor = (F.col("tag") == "a") & (urls.authority(to) == urls.authority(base))
    bare = F.substring_index(to, "#", 1)
    here, there = urls.board_id(base), urls.board_id(to)
    smf = F.when(anchor & (here["kind"] == there["kind"]) & (here["id"] == there["id"]) & (there["at"] > here["at"]), there["at"])
    offset = lambda u: F.coalesce(F.nullif(F.regexp_extract(urls.path(u), PATH_OFFSET, 2), F.lit("")).cast("long"), F.lit(0))
    ident = lambda u: F.regexp_extract(urls.path(u), PATH_OFFSET, 1)
    by_path = F.when(anchor & (urls.query(to) == "") & (ident(base) != "") & (ident(base) == ident(to)) & (offset(to) > offset(base)), offset(to))
    rel = F.array_contains(F.split(F.lower(F.coalesce(a["rel"], F.lit(""))), r"\s+"), "next") & (F.rtrim(to, F.lit("/")) != F.rtrim(base, F.lit("/")))
    kinds = F.concat_ws(" ", F.array_join("classes", " "), F.col("_above"))
    label = anchor & (F.col("t").rlike(NEXT_TEXT) | F.contains(F.lower(F.coalesce(a["title"], a["aria-label"], F.lit(""))), F.lit("next page")) | (kinds.rlike(NEXT_CLASS) & ~F.col("t").rlike("(?i)last|prev")))
    number, now = urls.page_number(to), urls.page_number(base)
    counted = anchor & (number == F.coalesce(now, F.lit(1)) + 1)
    first = lambda value, which, order: F.min_by(value, F.when(which, order))
    got = links.groupBy("page_id", "base").agg(
        F.min(smf).alias("smf"), first(to, rel, F.col("pre")).alias("rel"), F.min(F.when(by_path.isNotNull(), F.struct(by_path, "pre", bare.alias("to"))))["to"].alias("path"),
        first(bare, label, F.col("pre")).alias("label"), first(to, counted, F.struct((F.col("t") != number.cast("string")).alias("other"), "pre")).alias("counted"),
    )
    other = lambda c: F.when(F.rtrim(F.col(c), F.lit("/")) != F.rtrim(base, F.lit("/")), F.col(c))
    back = F.coalesce(urls.page_number(F.col("label")) <= now, F.lit(False))
    smf_url = F.concat(F.substring_index(base, "/", 3), F.lit("/index.php?"), here["kind"], F.lit("="), here["id"].cast("string"), F.lit("."), F.col("smf").cast("string"))
    plain = F.coalesce(F.when(~back, other("label")), other("counted"))
    nxt = F.when(here.isNotNull(), smf_url).otherwise(F.coalesce("rel", F.when(ident(base) != "", F.col("path")).otherwise(plain)))
    return got.select("page_id", nxt.alias("next")).where("next is not null")


def probe(pages: DataFrame, nodes: DataFrame, links: DataFrame, best: DataFrame, items: DataFrame, most: int = 15) -> DataFrame:
    """One row for each page: software, items, links, downloads, hosts (the most frequent, with counts), next,
    guest_wall, titles (up to twelve). best: page_id, software; items: page_id, title, place."""
    known = identified(links).select("page_id", urls.host_only(F.col("url")).alias("host"), "file_key")
    by_host = known.groupBy("page_id", "host").agg(F.count("*").alias("n"), F.count("file_key").alias("files"))
    listed = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "host"))), 1, most)
    hosts = by_host.groupBy("page_id").agg(F.sum("n").alias("links"), F.sum("files").alias("downloads"), F.array_join(F.transform(listed, lambda x: F.concat_ws(" ", x["host"], (-x["less"]).cast("string"))), ", ").alias("hosts"))
    named = items.groupBy("page_id").agg(F.count("*").alias("items"), F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("place", F.left("title", F.lit(90)).alias("title")))), lambda x: x["title"]), 1, 12), "; ").alias("titles"))
    out = pages.select("page_id", guest_wall(F.col("html")).alias("guest_wall")).join(best.select("page_id", "software").hint("merge"), "page_id", "left").join(hosts.hint("merge"), "page_id", "left").join(named.hint("merge"), "page_id", "left").join(next_pages(pages, nodes).hint("merge"), "page_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("page_id", "software", zero("items"), zero("links"), zero("downloads"), F.coalesce("hosts", F.lit("")).alias("hosts"), "next", "guest_wall", F.coalesce("titles", F.lit("")).alias("titles"))


def captions(nodes: DataFrame, reach: int = 40) -> DataFrame:
    """page_id, pre, url, caption of each player: the words of the last paragraph or heading before it that isn't an
    advertisement's, unless another player comes between; of a link to a file, its own words."""
    a = F.col("attrs")
    src = F.when(F.col("tag").isin("audio", "source"), F.nullif(F.trim(a["src"]), F.lit(""))).when((F.col("tag") == "a") & urls.is_media(F.coalesce(a["href"], F.lit(""))), a["href"])
    blocks = outermost(nodes, F.col("tag").rlike("^(p|h[1-6])$") | ((F.col("tag") == "a") & src.isNotNull()))
    said = texts(nodes, blocks.select("page_id", "pre", "end")).select("page_id", F.col("item").alias("pre"), "t")
    met = nodes.withColumn("src", src).join(said.hint("merge"), ["page_id", "pre"], "left")
    words = F.when(F.col("tag").rlike("^(p|h[1-6])$") & (F.col("t") != "") & ~F.contains("t", F.lit("adsbygoogle")), F.struct(F.col("t").alias("said")))
    # a source's own audio element isn't another player
    mark = F.when((F.col("tag") == "audio"), F.struct(F.lit("").alias("said"))).otherwise(words)
    met = met.withColumn("_m", mark).withColumn("_b", F.last("_m", ignorenulls=True).over(_page(-reach, -1)))
    up = met.select("page_id", F.col("pre").alias("parent"), F.when(F.col("tag") == "audio", F.struct("_b")).alias("_audio"))
    met = met.where("src is not null").join(up.hint("merge"), ["page_id", "parent"], "left")
    held = F.when((F.col("tag") == "source") & F.col("_audio").isNotNull(), F.col("_audio._b.said")).otherwise(F.col("_b.said"))
    return met.select("page_id", "pre", F.col("src").alias("url"), F.coalesce(F.when(F.col("tag") == "a", F.coalesce("t", F.trim("text"))).otherwise(held), F.lit("")).alias("caption"))
