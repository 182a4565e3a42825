"""What is behind a page: forum software, content systems, challenge pages, guest walls."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_GENERATOR = r"<meta[^>]+name=[\"']generator[\"'][^>]+content=[\"'][^\"']*"
# Marks of each software in lower-cased pages: what a page must contain any of, and the pattern.
SIGNATURES = (
    ("vBulletin", (("meta generator", ("vbulletin",), _GENERATOR + "vbulletin"), ("vBulletin asset", ("/clientscript/", "/forumdisplay.php", "/showthread.php"), r"(?:/clientscript/|/forumdisplay\.php|/showthread\.php)"), ("vBulletin class", ("vbmenu", "vbphrase", "postbit", "tborder"), r"\b(?:vbmenu|vbphrase|postbit|tborder)\b"))),
    ("XenForo", (("meta generator", ("xenforo",), _GENERATOR + "xenforo"), ("XenForo asset", ("/js/xf/", "/xenforo/"), r"(?:/js/xf/|/styles/[^/]+/xenforo/)"), ("XenForo class", ("p-body", "block--messages", "message-cell", "structitem"), r"\b(?:p-body|block--messages|message-cell|structitem)\b"))),
    ("MyBB", (("meta generator", ("mybb",), _GENERATOR + "mybb"), ("MyBB asset", ("/jscripts/", "/showthread.php", "/forumdisplay.php", "/thread-", "/forum-"), r"(?:/jscripts/|/showthread\.php|/forumdisplay\.php|href=\"[^\"]*/(?:thread|forum)-)"), ("MyBB class", ("trow1", "trow2", "inline_row", "forumdisplay_regular", "post_body", "postbit"), r"\b(?:trow1|trow2|inline_row|forumdisplay_regular|post_body|postbit)\b"))),
    ("Forumotion", (("Forumotion host", ("illiweb.com", "forumotion.", "foroactivo.", "forumactif."), r"(?:illiweb\.com|forumotion\.|foroactivo\.|forumactif\.)"), ("Forumotion script", ("_userdata",), r"\b_userdata\s*\["), ("Forumotion URL", ("href=",), r"href=[\"'](?:https?://[^/\"']+)?/[tf]\d+-"))),
    ("SMF", (("SMF footer", ("powered by smf", "simple machines"), r"powered by smf|simple machines"), ("SMF script", ("smf_scripturl", "smf_theme_url", "smf_default_theme_url"), r"smf_scripturl|smf_theme_url|smf_default_theme_url"), ("SMF URL", ("index.php",), r"index\.php(?:\?|/)(?:topic|board)[=,]\d+\.\d+"))),
    ("phpBB", (("meta generator", ("phpbb",), _GENERATOR + "phpbb"), ("phpBB asset", ("/theme/", "/viewtopic.php", "/viewforum.php"), r"(?:/styles/[^/]+/theme/|/viewtopic\.php|/viewforum\.php)"), ("phpBB class", ("phpbb", "forumbg", "postbody", "topiclist"), r"\b(?:phpbb|forumbg|postbody|topiclist)\b"))),
    ("Invision Community", (("meta generator", ("invision", "ips community"), _GENERATOR + "(?:invision|ips community)"), ("Invision asset", ("/applications/core/interface/", "/applications/forums/", "/uploads/"), r"(?:/applications/core/interface/|/applications/forums/|/uploads/\w+/)"), ("Invision class", ("ipslayout", "ipstype_", "ipsbutton", "ipscomment"), r"\b(?:ipslayout|ipstype_|ipsbutton|ipscomment)\b"))),
    ("Drupal", (("meta generator", ("drupal",), _GENERATOR + "drupal"), ("Drupal asset", ("/core/misc/drupal", "/sites/default/files/", "drupalsettings"), r"(?:/core/misc/drupal|/sites/default/files/|drupalsettings)"), ("Drupal marker", ("drupalsettings", "js-drupal-", "node--"), r"\b(?:drupalsettings|js-drupal-|node--\w+)\b"))),
)
# Marks of browser challenges, of a content system, and of pages that hide links from guests.
CHALLENGE = ("cf-chl-", "cf-turnstile", "just a moment...", "checking your browser", "ddos-guard", "enable javascript and cookies to continue")
GUEST_WALL = r"(?i)sign in to (?:view|see|download)|you (?:do not|don't) have permission|members only|to unlock|hidden (?:content|link)"
SELF_HOSTED = r"(?i)<meta[^>]+generator[^>]+wordpress"


def software(pages: DataFrame) -> DataFrame:
    """page_id, software, confidence, evidence: each software that leaves a mark. The page is lower-cased once, and
    searched by a pattern only if it contains a word of it."""
    low = pages.select("page_id", F.lower(F.coalesce("html", F.lit(""))).alias("low"))
    marked = lambda words, p: reduce(or_, (F.contains("low", F.lit(w)) for w in words)) & F.col("low").rlike(p)
    found = [F.struct(F.lit(name).alias("software"), F.array_compact(F.array(*[F.when(marked(words, p), F.lit(mark)) for mark, words, p in marks])).alias("evidence")) for name, marks in SIGNATURES]
    # an outer generator: of others the optimizer makes a filter that searches each page again
    rows = low.select("page_id", F.inline_outer(F.array(*found))).where(F.size("evidence") > 0)
    return rows.select("page_id", "software", F.round(F.least(F.lit(0.99), 0.45 + 0.2 * F.size("evidence")), 2).alias("confidence"), F.array_join("evidence", "; ").alias("evidence"))


def best(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("page_id").orderBy(F.desc("confidence"), "software")
    return found.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def is_cms(html: Column) -> Column:
    """Marks of a content system anywhere in the page."""
    b = F.coalesce(html, F.lit(""))
    has = lambda s: F.contains(b, F.lit(s))
    return b.rlike(SELF_HOSTED) | has("/wp-json/") | has("rest_route=") | (has("/wp-content/") & has("/wp-includes/"))


def is_challenge(html: Column) -> Column:
    """A browser challenge in place of a page; the weak mark counts on small pages only."""
    b = F.lower(F.left(F.coalesce(html, F.lit("")), F.lit(250_000)))
    strong = F.lit(False)
    for mark in CHALLENGE:
        strong = strong | F.contains(b, F.lit(mark))
    return strong | (F.contains(b, F.lit("challenge-platform")) & (F.length(html) < 30_000))


def guest_wall(html: Column) -> Column:
    """The page says that guests don't see all of it."""
    return F.coalesce(html, F.lit("")).rlike(GUEST_WALL)


def reader(url: Column, html: Column, best_software: Column) -> Column:
    """Which reader a page gets: forum, cms or web."""
    board = url.rlike(r"(?i)index\.php(?:\?|/)(?:topic|board)[=,]\d+\.")
    return F.when(board, "forum").when(is_cms(html), "cms").when(best_software == "SMF", "forum").otherwise("web")
