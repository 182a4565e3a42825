"""Columns over urls: parts, normal forms, classes, and the identity of the file that a url names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import hosts as H

#: scheme, authority, path, query, fragment by RFC 3986; loose urls have parts too.
_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?"
_HOST = r"^(?:.*@)?(?:www\.)?([^:]*)"
# What a link leads to, by its host, in order.
BUCKETS = (
    ("source", r"(github\.com|gitlab\.com|bitbucket\.org|git\.sr\.ht|codeberg\.org)"),
    ("build", r"(androidfilehost\.com|sourceforge\.net|mega\.nz|mega\.co\.nz|mediafire\.com|drive\.google\.com|onedrive\.live\.com|dropbox\.com|pixeldrain\.com|gofile\.io|1fichier\.com|rapidgator\.net|nitroflare\.com|ddownload\.com|katfile\.com|turbobit\.net|hitfile\.net|uploadgig\.com|fikper\.com|wdfiles\.ru|cloud\.mail\.ru|disk\.yandex\.(?:ru|com)|files\.fm)"),
    ("video", r"(youtube\.com|youtu\.be|vimeo\.com|odysee\.com|streamable\.com)"),
    ("forum", r"(reddit\.com|t\.me)"),
)
PREMIUM = r"(rapidgator\.net|nitroflare\.com|ddownload\.com|katfile\.com|turbobit\.net|hitfile\.net|uploadgig\.com|fikper\.com)"
SITE_PAGES = ("about", "faq", "help", "terms", "tos", "privacy", "login", "signin", "register", "signup", "pricing", "pro", "premium", "blog", "contact", "legal", "home", "index.html", "upload", "app")
ACTION_KEYS = ("eval", "p_vote", "vote", "watch", "unwatch", "mark", "logout", "delete")
TARGET_KEYS = ("url", "u", "target", "dest", "destination", "redirect", "redirect_url", "link", "download", "file", "href")
WRAPPER_TOKENS = ("redirect", "goto", "out.php", "away.php", "link.php", "dl.php", "mirror", "filehost", "download.php", "/go/", "/link/", "/dl/")
PAGE_KEYS = ("page", "p", "pagenum", "start", "st", "offset")
SHORTENERS = r"(?i)https?://(?:bit\.ly|tinyurl\.com|goo\.gl|is\.gd|ow\.ly|cutt\.ly)/[A-Za-z0-9_-]+"
MEDIA_EXTENSIONS = ("mp3", "flac", "wav", "aiff", "aif", "ogg", "m4a", "opus", "zip", "rar", "7z")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp")


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, i)


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def fragment(url: Column) -> Column:
    return _part(url, 5)


def authority(url: Column) -> Column:
    return F.lower(_part(url, 2))


def host_only(url: Column) -> Column:
    """The host in lower case, without user, port and a leading www."""
    return F.regexp_extract(F.lower(_part(url, 2)), _HOST, 1)


def _host(authority: Column) -> Column:
    name = F.substring_index(F.substring_index(F.lower(authority), "@", -1), ":", 1)
    return F.when(F.startswith(name, F.lit("www.")), F.substring(name, 5, 1 << 20)).otherwise(name)


def _behind(text: Column, before: Column, more: int) -> Column:
    return F.substring(text, F.length(before) + more, F.length(text))


#: Steps that take a url apart; each has names and functions of the columns so far. A url that begins with a scheme and
#: a host needs no pattern.
_SPLIT = (
    {"url": lambda c: F.coalesce(c["url"], F.lit(""))},
    {"bare": lambda c: F.substring_index(c["url"], "#", 1)},
    {"front": lambda c: F.substring_index(c["bare"], "?", 1), "fragment": lambda c: _behind(c["url"], c["bare"], 2)},
    {"query": lambda c: _behind(c["bare"], c["front"], 2), "at": lambda c: F.locate("://", c["front"])},
    {"plain": lambda c: (c["at"] > 1) & (F.locate("/", c["front"]) == c["at"] + 1)},
    {"rest": lambda c: F.when(c["plain"], F.substring(c["front"], c["at"] + 3, F.length(c["front"]))).otherwise(F.concat(_part(c["url"], 2), _part(c["url"], 3)))},
    {"authority": lambda c: F.when(c["plain"], F.substring_index(c["rest"], "/", 1)).otherwise(_part(c["url"], 2))},
    {"host": lambda c: _host(c["authority"]), "path": lambda c: _behind(c["rest"], c["authority"], 1)},
)


def query_keys(url: Column) -> Column:
    """Lower-cased names of the query's parameters."""
    parts = F.filter(F.split(F.lower(query(url)), "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.substring_index(p, "=", 1))


def unescape(text: Column) -> Column:
    """The entities that occur in urls. For all of HTML's, see sources.html.unescape."""
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("#x27", "'"), ("nbsp", " "), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(sign))
    return text


def _unspared(u: Column) -> Column:
    """Without closing brackets at the end that have no opening one."""
    spare = F.length(F.replace(u, F.lit("("), F.lit(""))) - F.length(F.replace(u, F.lit(")"), F.lit("")))
    tail = F.length(u) - F.length(F.regexp_replace(u, r"\)+$", ""))
    return F.substring(u, F.lit(1), F.length(u) - F.greatest(F.lit(0), F.least(spare, tail)))


#: Steps of normalise, each a function of what the one before gave.
NORMAL = (
    lambda u: F.regexp_replace(F.replace(F.trim(unescape(u)), F.lit("\\/"), F.lit("/")), "^[ \\t\\r\\n'\"<>\\[\\]{}.,;]+|[ \\t\\r\\n'\"<>\\[\\]{}.,;]+$", ""),
    lambda u: F.regexp_replace(F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u), "[.,;]+$", ""),
    _unspared,
    lambda u: F.when(u.rlike("(?i)^https?://[^/?#]"), u),
)


def normalise(url: Column) -> Column:
    """An absolute http(s) url without edge punctuation, or null. For whole tables see operators.dedupe.normalised, which
    computes each step once."""
    for step in NORMAL:
        url = step(url)
    return url


def find_urls(text: Column) -> Column:
    """All urls in a text, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"""(?i)(?:https?://|//)[^\s"'<>`\]}]+"""), F.lit(0))


def decoded(url: Column) -> Column:
    """Percent-decoded; as it is where it can't be."""
    return F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)


def with_decoded(urls: Column) -> Column:
    """Each url of an array followed, at the end, by those decoded that differ."""
    return F.array_distinct(F.concat(urls, F.filter(F.transform(urls, decoded), lambda u: ~F.array_contains(urls, u))))


def bucket(host: Column) -> Column:
    out = F.lit("other")
    for name, pattern in reversed(BUCKETS):
        out = F.when(host.rlike("(?i)" + pattern), F.lit(name)).otherwise(out)
    return out


def premium(host: Column) -> Column:
    return host.rlike("(?i)" + PREMIUM)


def is_enabled(url: Column, keys: tuple[str, ...]) -> Column:
    return host_only(url).isin(*H.domains(keys))


def is_known_file_host(url: Column) -> Column:
    return host_only(url).isin(*H.domains())


def truncated(url: Column) -> Column:
    return F.contains(url, F.lit("..."))


def names_a_file(url: Column) -> Column:
    """Something beyond a site's own pages: a query, a long fragment, or a path that isn't a locale or a site page."""
    return _names_a_file({"path": path(url), "query": query(url), "fragment": fragment(url)})


def _names_a_file(c: dict) -> Column:
    whole = F.trim(c["path"], F.lit("/"))
    own = ~F.contains(whole, F.lit("/")) & (F.lower(whole).rlike("^[a-z]{2}(?:[-_][a-z]{2})?$") | F.lower(whole).isin(*SITE_PAGES))
    return (c["query"] != "") | (F.length(c["fragment"]) > 3) | ((whole != "") & ~own)


# What the urls of files look like on hosts of their own kind.
_WORD = r"^[A-Za-z0-9_-]+"
_MEGA_PATH, _MEGA_OLD = r"(?i)^/(?:folder|file)/[A-Za-z0-9_-]+$", r"^F?![A-Za-z0-9_-]+![A-Za-z0-9_-]"
_DRIVE = r"(?:/(?:file/d|drive/(?:u/\d+/)?folders|folders)/|[?&]id=)([A-Za-z0-9_-]{10,})"


class Reducer:
    """How the urls of a kind of host are reduced: functions of a url's parts; canonical sees the identity too."""

    def __init__(self, identity, canonical):
        self.identity, self.canonical = identity, canonical


def _segment(c: dict, i: int) -> Column:
    return F.get(c["segments"], F.lit(i))


def _gator_id(c: dict) -> Column:
    """/file/<key>, and a name behind it."""
    key = F.regexp_extract(_segment(c, 2), "^[A-Za-z0-9]+", 0)
    return F.when((F.lower(_segment(c, 1)) == "file") & (key != ""), F.concat(F.lit("rapidgator:"), key))


def _gator_url(c: dict) -> Column:
    named = (F.length(_segment(c, 2)) + F.length(F.lit("rapidgator:")) == F.length(c["identity"])) & (_segment(c, 3) != "")
    return F.concat(F.lit("https://rapidgator.net/file/"), F.substring(c["identity"], 12, 1 << 20), F.when(named, F.concat(F.lit("/"), _segment(c, 3))).otherwise(""))


def _mega_id(c: dict) -> Column:
    """The key in the fragment belongs to the identity: with another key the folder holds another file."""
    bang = lambda i: F.get(c["marks"], F.lit(i))
    both = lambda number, key: F.concat(F.lit("mega:"), number, F.lit("#"), F.regexp_extract(key, _WORD, 0))
    new = (c["query"] == "") & c["path"].rlike(_MEGA_PATH) & c["fragment"].rlike(_WORD)
    return F.when(c["fragment"].rlike(_MEGA_OLD), both(bang(1), bang(2))).when(new, both(_segment(c, 2), c["fragment"]))


def _mega_url(c: dict) -> Column:
    kind = F.when(c["fragment"].startswith("F!"), "folder").when(c["fragment"].startswith("!"), "file").otherwise(F.lower(_segment(c, 1)))
    return F.concat(F.lit("https://mega.nz/"), kind, F.lit("/"), F.substring(c["identity"], 6, 1 << 20))


def _drive_id(c: dict) -> Column:
    key = F.regexp_extract(c["url"], _DRIVE, 1)
    return F.when(key != "", F.concat(F.lit("gdrive:"), key))


def _drive_url(c: dict) -> Column:
    start = F.when(F.contains(c["url"], F.lit("/folders/")), "https://drive.google.com/drive/folders/").otherwise("https://drive.google.com/file/d/")
    return F.concat(start, F.substring(c["identity"], 8, 1 << 20))


def _site_id(c: dict) -> Column:
    inside = F.lit(False)
    for domain, folders in H.SITE_DIRS.items():
        for folder in folders:
            inside = inside | ((c["host"] == domain) & F.lower(c["path"]).startswith(folder))
    mine = inside & F.lower(F.substring_index(c["path"], ".", -1)).isin(*H.SITE_EXTENSIONS)
    return F.when(mine, F.concat(c["prefix"], F.lit(":"), F.lower(c["path"])))


REDUCERS = {
    "plain": Reducer(lambda c: F.concat(c["prefix"], F.lit(":"), F.lower(F.rtrim(c["bare"], F.lit("/")))), lambda c: F.rtrim(c["bare"], F.lit("/"))),
    "rapidgator": Reducer(_gator_id, _gator_url),
    "mega": Reducer(_mega_id, _mega_url),
    "gdrive": Reducer(_drive_id, _drive_url),
    "site": Reducer(_site_id, lambda c: F.concat(F.lit("https://www."), c["prefix"], c["path"])),
}


def _by_kind(c: dict, part: str) -> Column:
    out = F.when(c["kind"].isNull(), None)
    for name, reducer in REDUCERS.items():
        out = out.when(c["kind"] == name, getattr(reducer, part)(c))
    return out.cast("string")


def reduce_steps(keys: tuple[str, ...]) -> tuple[dict, ...]:
    """Steps from url to identity and canonical: it is taken apart, its host looked up, and that host's reducer runs."""
    known = H.by_domain("reducer", keys)
    return (
        *_SPLIT,
        {"segments": lambda c: F.split(c["path"], "/", 4), "marks": lambda c: F.split(c["fragment"], "!")},
        {"kind": lambda c: F.when(~truncated(c["url"]) & _names_a_file(c), known[c["host"]]), "prefix": lambda c: H.prefix_of(c["host"])},
        {"identity": lambda c: _by_kind(c, "identity")},
        {"canonical": lambda c: F.when(c["identity"].isNotNull(), _by_kind(c, "canonical"))},
    )


def reduce(url: Column, keys: tuple[str, ...] = H.enabled_hosts("all"), custom: dict | None = None) -> Column:
    """struct(identity, canonical) of the file that a url names on one of the hosts; both null for all other urls.

    custom: host key -> function of a url column that gives (identity, canonical) columns, in place of the built-in one.
    For whole tables see operators.dedupe.identified, which computes each step once.
    """
    c = {"url": url}
    for step in reduce_steps(tuple(k for k in keys if k not in (custom or {}))):
        c |= {name: f(c) for name, f in step.items()}
    return with_custom(url, c["identity"], c["canonical"], keys, custom)


def with_custom(url: Column, identity: Column, canonical: Column, keys: tuple[str, ...], custom: dict | None) -> Column:
    for key, own in (custom or {}).items():
        if key in keys:
            mine = host_only(url).isin(*H.domains((key,))) & ~truncated(url) & names_a_file(url)
            one, two = own(url)
            identity, canonical = F.when(mine, one).otherwise(identity), F.when(mine & one.isNotNull(), two).otherwise(canonical)
    return F.struct(identity.alias("identity"), canonical.alias("canonical"))


def plain_key(url: Column) -> Column:
    return F.lower(F.rtrim(url, F.lit("/")))


def download_key(url: Column, keys: tuple[str, ...] = H.enabled_hosts("all")) -> Column:
    """The file's identity, or the url in lower case."""
    return F.coalesce(reduce(url, keys)["identity"], plain_key(url))


def is_download(url: Column, keys: tuple[str, ...] = H.enabled_hosts("all")) -> Column:
    return reduce(url, keys)["identity"].isNotNull()


def is_action(url: Column) -> Column:
    return F.arrays_overlap(query_keys(url), F.array(*map(F.lit, ACTION_KEYS)))


def is_wrapper(url: Column, text: Column) -> Column:
    """Not a file host, and a word of a redirector in the url or text, or a query key that names a target."""
    blob = F.lower(F.concat_ws(" ", host_only(url), path(url), query(url), text))
    said = F.lit(False)
    for token in WRAPPER_TOKENS:
        said = said | F.contains(blob, F.lit(token))
    return ~is_known_file_host(url) & (said | F.arrays_overlap(query_keys(url), F.array(*map(F.lit, TARGET_KEYS))))


def short_links(text: Column) -> Column:
    """Distinct links of shorteners in a text, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SHORTENERS), F.lit(0)))


def page_number(url: Column) -> Column:
    """The page that a url names by its query, or its path; offsets tell the first page (1) from later ones (2)."""
    found = []
    for key in PAGE_KEYS:
        n = F.regexp_extract(query(url), rf"(?:^|&){key}=(\d{{1,9}})(?:&|$)", 1)
        n = F.try_to_number(F.nullif(n, F.lit("")), F.lit("999999999")).cast("long")
        found.append(F.when(n > 0, 2).when(n == 0, 1).cast("long") if key in ("start", "offset") else n)
    in_path = F.nullif(F.regexp_extract(path(url), r"(?i)/(?:page[-/]?|p)(\d{1,9})(?:/|$)", 1), F.lit(""))
    return F.coalesce(*found, in_path.cast("long"))


def board_topic(url: Column) -> Column:
    """A path-style board's topic without its page, or null; only a highlight may stand in the query."""
    foreign = F.exists(query_keys(url), lambda k: k != "highlight")
    topic = F.regexp_extract(path(url), r"^/(t\d+)(?:p\d+)?-([^/]*)$", 1)
    slug = F.regexp_extract(path(url), r"^/(t\d+)(?:p\d+)?-([^/]*)$", 2)
    return F.when((topic != "") & ~foreign, F.concat(F.substring_index(url, "/", 3), F.lit("/"), topic, F.lit("-"), slug))


def board_id(url: Column) -> Column:
    """struct(kind, id, at) of a topic or board of an index.php forum, in both of its spellings; null for actions."""
    pattern = r"(?i)index\.php(?:\?(?:[^#]*&)?|/)(topic|board)[=,](\d+)\.(?:msg)?(\d+)"
    kind = F.lower(F.regexp_extract(url, pattern, 1))
    refused = F.arrays_overlap(query_keys(F.replace(url, F.lit(";"), F.lit("&"))), F.array(*map(F.lit, ("action", "prev_next", "phpsessid", "sesc"))))
    number = lambda i: F.regexp_extract(url, pattern, i).cast("long")
    return F.when((kind != "") & ~refused, F.struct(kind.alias("kind"), number(2).alias("id"), number(3).alias("at")))


def echo_key(url: Column) -> Column:
    """Of the many spellings that a downstream system may echo, one: decoded twice, lower case, no scheme, www or slash."""
    u = F.lower(decoded(decoded(url)))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(u, "^https?://", ""), r"^www\.", ""), "/+$", "")


def same_site(a: Column, b: Column) -> Column:
    return host_only(a) == host_only(b)


def extension(url: Column) -> Column:
    name = F.substring_index(path(url), "/", -1)
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def is_media(url: Column) -> Column:
    return extension(url).isin(*MEDIA_EXTENSIONS)


def is_image(url: Column) -> Column:
    return extension(url).isin(*IMAGE_EXTENSIONS)


def classify(url: Column, keys: tuple[str, ...]) -> list[Column]:
    """host, bucket, premium, downloadable, file_host."""
    host = host_only(url)
    return [host.alias("host"), bucket(host).alias("bucket"), premium(host).alias("premium"), host.isin(*H.domains(keys)).alias("downloadable"), host.isin(*H.domains()).alias("file_host")]
