"""Boards, pagers, dates and floods on pages that are made from drawn facts, each rule against what was drawn."""

import datetime
import random
from html import escape
from urllib.parse import urljoin

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanframe.functions import urls
from gleanframe.operators import candidates, chains, detect, items, pages
from gleanframe.sources import html

few = settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
HOME = "http://vinylbarn.invalid"


def _tag(name, *inner, **attrs):
    said = "".join(f' {k.rstrip("_").replace("_", "-")}="{escape(v)}"' for k, v in attrs.items())
    return f"<{name}{said}>{''.join(inner)}</{name}>"


def _link(to, text, **attrs):
    return _tag("a", text, **attrs, href=to)


def _frame(spark, made):
    return spark.createDataFrame([(n, url, text) for n, (url, text) in enumerate(made)], "page_id long, url string, html string")


def _nexts(spark, made):
    df = _frame(spark, made)
    got = {r.page_id: r.next for r in pages.next_pages(df, html.page_nodes(df)).collect()}
    return [got.get(n) for n in range(len(made))]


@few
@given(st.integers(1, 10**6), st.lists(st.integers(0, 90), min_size=1, max_size=6), st.integers(0, 90), st.booleans())
def test_offset_boards_go_to_the_smallest_larger_offset(spark, topic, places, here, short):
    """Whatever else a page labels as next, in both spellings of the links."""
    to = (lambda at: f"{HOME}/index.php/topic,{topic}.{at}.html") if short else (lambda at: f"/index.php?topic={topic}.{at}")
    row = _tag("p", *[_link(to(20 * p), str(p)) for p in places], _link(f"/index.php?topic={topic + 1}.{20 * here + 20}", "&rsaquo;"))
    page = _tag("html", _tag("head", f'<link href="/index.php?topic={topic}.0;prev_next=next" rel="next">'), _tag("body", row))
    later = [p for p in places if p > here]
    assert _nexts(spark, [(f"{HOME}/index.php?topic={topic}.{20 * here}", page)]) == [f"{HOME}/index.php?topic={topic}.{20 * min(later)}" if later else None]


@few
@given(st.integers(1, 999), st.sets(st.integers(0, 40), max_size=5), st.integers(0, 40))
def test_path_offsets_stay_on_their_board(spark, board, places, here):
    spell = lambda b, p: f"/f{b}p{p}-crates" if p else f"/f{b}-crates"
    made = [_link(spell(board, 10 * p), "x") for p in sorted(places)] + [_link(spell(board + 1, 10 * here + 10), "Next")]
    later = [p for p in places if p > here]
    assert _nexts(spark, [(HOME + spell(board, 10 * here), "".join(made))]) == [HOME + spell(board, 10 * min(later)) if later else None]


def test_next_pages_by_trust(spark):
    """rel=next before a label, a label before a number, a number's own text before others; other sites never."""
    rel, label = f'<link href="/a/3" rel="prev"><link rel="next" href="/a/9">', _link("/a/8", "weiter")
    count = lambda n, t: _link(f"/b?page={n}", t)
    made = [
        ("/a/1", rel + label, "/a/9"),
        ("/a/1", label, "/a/8"),
        ("/a/1", _link("/a/8", "&gt;", rel="nofollow next"), "/a/8"),
        ("/a/1", _tag("li", _link("/a/7", "more"), class_="pages-next"), "/a/7"),
        ("/a/1", _tag("li", _link("/a/7", "last one"), class_="pages-next"), None),
        ("/a/1", _link("/a/6", "*", title="Go to Next Page"), "/a/6"),
        ("/b?page=4", count(3, "weiter") + count(5, "5") + count(6, "6"), "/b?page=5"),
        ("/b?page=4", count(5, "cover") + _link("/b?page=5&z=1", "5"), "/b?page=5&z=1"),
        ("/b", count(2, "two"), "/b?page=2"),
        ("/b?page=9", count(9, "9") + count(9, "volgende"), None),
        ("/b", _link("http://else.invalid/b?page=2", "next"), None),
        ("/b", "", None),
    ]
    want = [HOME + w if w else None for _, _, w in made]
    assert _nexts(spark, [(HOME + u, t) for u, t, _ in made]) == want


day = st.dates(datetime.date(1971, 1, 1), datetime.date(2068, 12, 31))


@few
@given(day, day, day, st.integers(0, 23))
def test_dates_of_posts_by_rank(spark, one, two, three, hour):
    """A machine date, else a holder's date, else a stamp with a time before the post, never across another post; quotes,
    joining dates and dates in words count for nothing."""
    short = lambda d: f"{d.day:02}.{d.month:02}.{d.year}"
    stamp, post = lambda d: f"{short(d)} {hour:02}:07", lambda *x: _tag("div", *x, class_="post")
    quote = _tag("blockquote", _tag("span", stamp(three), class_="date"), "said")
    made = [
        (post(_tag("time", stamp(two), datetime=f"{one}T09:00"), quote), [one]),
        (post(_tag("span", stamp(one), class_="postdate"), quote), [one]),
        (_tag("p", stamp(one), class_="keyinfo") + post(quote, "words"), [one]),
        (_tag("td", "since ", short(three)) + _tag("td", stamp(one)) + post("words"), [one]),
        (_tag("td", "since ", short(three)) + post("words of ", short(two)), [None]),
        (_tag("i", stamp(one)) + post("first") + post("second"), [one, None]),
        (post("first") + _tag("i", stamp(two)) + post("second"), [None, two]),
        (post(quote), [None]),
    ]
    nodes = html.page_nodes(_frame(spark, [(HOME, t) for t, _ in made]))
    tops = pages.outermost(nodes, F.array_contains("classes", "post")).select("page_id", "pre", "end")
    got = pages.post_dates(nodes, tops, F.lit("2026-05-05").cast("date")).orderBy("page_id", "item").collect()
    assert [[r.day for r in got if r.page_id == n] for n in range(len(made))] == [w for _, w in made]


# one way in which each selector of a family is met
def _holder(selector):
    if isinstance(selector[0], tuple):
        inner, outer = _holder(selector[0]), _holder(selector[1])
        return lambda x: outer(inner(x))
    tag, attribute, how, value = selector
    tag = tag or "div"
    wrap = (lambda x: f"<table>{x}</table>") if tag == "tr" else (lambda x: x)
    attrs = {} if not attribute else {"class_": f"z {value} y"} if attribute == "class" else {"id": value + ("77" if how == "starts" else "")}
    return lambda x: wrap(_tag(tag, _tag("td", x) if tag == "tr" else x, **attrs))


@pytest.mark.parametrize("family", [f for f in items.SELECTORS if f != "SMF-board"])
def test_each_selector_of_a_family_is_an_item(spark, family):
    """A file in a login form, a signature or the footer is none of an item's; what no selector holds is read as a whole."""
    hidden = _tag("form", '<input type="password">', _link("https://mega.nz/folder/L#k", "in"), action="/go") + _tag("p", _link("https://mega.nz/folder/S#k", "mine"), class_="signature") + _tag("footer", _link("https://mega.nz/folder/F#k", "f"))
    made = []
    for n, s in enumerate(items.SELECTORS[family]):
        inside = _tag("h2", f"Crate {n}") + _tag("form", _link(f"https://mega.nz/folder/I{n}#k", "get"), action="/rate") + hidden
        made.append((f"{HOME}/{n}", _tag("body", _link("https://mega.nz/folder/O#k", "outside"), _holder(s)(inside), hidden)))
    made.append((f"{HOME}/none", _tag("body", _tag("h3", "Plain page"), _link("https://mega.nz/folder/P#k", "get"))))
    got = items.read_items(_frame(spark, made), family).orderBy("page_id").collect()
    last = len(made) - 1
    assert [(r.page_id, r.downloads, r.main) for r in got] == [(n, 1, False) for n in range(last)] + [(last, 1, True)]
    if family != "SMF":  # these titles come from a post's own words
        assert [r.title for r in got] == [f"Crate {n}" for n in range(last)] + ["Plain page"]


def test_titles_of_posts(spark):
    """The catalogue's name, else a post's own words before its first url; quotes and labels of links are not its own."""
    quote = _tag("blockquote", "an older one ", _link("https://www.discogs.com/release/5-Not-This", "d"))
    said = [
        (quote + _link("https://www.discogs.com/fr/master/81-Stone-Garden%20Two", "look") + "some words", "Stone Garden Two"),
        (quote + "Stone Garden, own rip: https://mega.nz/folder/Z#k and more", "Stone Garden, own rip"),
        (_tag("div", "Quote from: me", class_="quoteheader") + "Brick Yard " + _link("https://mega.nz/folder/Y#k", "the label"), "Brick Yard"),
        ("w" * 150 + _link("https://mega.nz/folder/X#k", "l"), "w" * 100),
    ]
    made = [(f"{HOME}/index.php?topic={n}.0", _tag("div", text + _link(f"https://mega.nz/folder/Q{n}#k", "x"), class_="post")) for n, (text, _) in enumerate(said)]
    got = items.read_items(_frame(spark, made), "SMF").orderBy("page_id").collect()
    assert [r.title for r in got] == [w for _, w in said]


@few
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from([0, 0, 0, 0, 3, 1200, None])), min_size=8, max_size=40))
def test_floods_by_what_was_drawn(spark, drawn):
    """Six unanswered topics of one member on a page go; answered and uncounted ones stay."""
    said = lambda n: "-" if n is None else f"{n:,}"
    row = lambda i, who, n: _tag("tr", _tag("td", _link(f"/index.php?topic={9000 + i}.0", f"Record number {i}")), _tag("td", _link(f"/profile/{who}", f"member {who}")), _tag("td", said(n)), _tag("td", "by ", _link("/profile/z", "member z")))
    page = _tag("table", *[row(i, *x) for i, x in enumerate(drawn)], class_="table_grid")
    got = items.read_items(_frame(spark, [(f"{HOME}/index.php?board=4.0", page)]), "SMF-board").collect()
    idle = {who: sum(w == who and n == 0 for w, n in drawn) for who in "abc"}
    kept = {f"Record number {i}" for i, (who, n) in enumerate(drawn) if not (n == 0 and idle[who] >= 6)}
    if kept:
        assert {r.title for r in got if not r.main} == kept
    else:
        assert all(r.main for r in got)


def test_guest_walls(spark):
    walls = ["please SIGN IN to See the links", "you do not have permission here", "for members only", "thank the author to unlock", "a hidden link"]
    free = ["sign in", "permission granted", "links below", "", None]
    df = spark.createDataFrame([(s,) for s in walls + free], "html string")
    assert [r[0] for r in df.select(detect.guest_wall(F.col("html"))).collect()] == [True] * len(walls) + [False] * len(free)


def test_follow_ups(spark):
    """Topics once, whatever their page, mark or highlight; profiles, boards, actions, styles, other sites and the page
    itself never; plausible pages only where no topic is."""
    here = f"{HOME}/f44-jungle"
    never = ["/u77", "/f2-other", "/f44-jungle", "/t5-x?vote=1", "/look.css", "/tags/dub", "/search", "/zz"]
    rows = lambda paths: spark.createDataFrame([(8, n, "t", urljoin(HOME, p), here) for n, p in enumerate(paths)], "base_id long, item_id long, name string, url string, base string")
    of = lambda paths: [r.url.removeprefix(HOME) for r in candidates.candidates(rows(paths), "vinylbarn.invalid", base_url="base").collect()]
    assert of(["/t5p30-old-rave#40", "/t5-old-rave?highlight=dub", "/plain-page", "http://else.invalid/t6-y", *never]) == ["/t5-old-rave"]
    assert of(["/plain-page", "/Plain-Page/", *never]) == ["/plain-page"]
    assert of(never) == []
    assert of(["/index.php/topic,61.40.html", "/index.php?topic=61.msg9#msg9"]) == ["/index.php?topic=61.0"]


def test_absolute_urls(spark):
    rng = random.Random(11)
    part = lambda: rng.choice(["k", "l.m", "..", ".", "", "n o", "p=q"])
    bases = ["https://h.invalid", "https://h.invalid/", "http://h.invalid/k/l?m=n#o", "https://h.invalid/k/l/"]
    hrefs = {rng.choice(["", "/", "//g.invalid/", "./", "../"]) + "/".join(part() for _ in range(rng.randrange(5))) + rng.choice(["", "?r=..", "#s/../t"]) for _ in range(150)} | {"mailto:me", "https://g.invalid/a/../b"}
    # a path that begins with two slashes is a host's
    pairs = [(b, h) for b in bases for h in sorted(hrefs) if h and "//" not in h.removeprefix("//").split("?")[0].split("#")[0].removeprefix("https://")]
    got = spark.createDataFrame(pairs, "b string, h string").withColumn("got", html.absolute(F.col("b"), F.col("h"))).collect()
    assert [(r.b, r.h, r.got) for r in got] == [(b, h, urljoin(b, h)) for b, h in pairs]


def test_walks_come_to_an_end(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (10, 11), (11, None), *((100 + i, 101 + i) for i in range(700))], "page long, next_page long")
    got = chains.page_chain(edges, edges.where("page in (1, 10, 100)").select("page"), 500)
    walk = {(r.start, r.page): r.n for r in got.collect()}
    assert {k: v for k, v in walk.items() if k[0] < 100} == {(1, 1): 0, (1, 2): 1, (1, 3): 2, (10, 10): 0, (10, 11): 1}
    assert {k[1]: v for k, v in walk.items() if k[0] == 100} == {100 + i: i for i in range(500)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 2


def test_plans_reduce_a_url_once(spark):
    from gleanframe.operators.dedupe import identified

    links = spark.createDataFrame([("https://mega.nz/folder/X#k",)], "url string")
    plan = identified(links).where("file_key is not null")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") <= 14 and plan.count("regexp_replace") == 0
    df = _frame(spark, [("https://x.test/", "<a href='/y'>z</a>")])
    plan = pages.page_links(df, html.page_nodes(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "ArrowEvalPython" not in plan
    assert urls.REDUCERS
