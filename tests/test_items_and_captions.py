import pytest
from pyspark.sql import functions as F

from gleanframe.functions import naming
from gleanframe.functions import dates, urls
from gleanframe.functions import hosts as H
from gleanframe.functions import recase as R
from gleanframe.operators import dedupe
from gleanframe.operators import items as I

PAGE = """<html><body><nav><a href="/x">menu</a></nav>
<div class="post"><h2>First release</h2><p>words enough to be kept as an item</p><a href="https://mega.nz/folder/abc#key1">get</a></div>
<div class="post"><h2>First release</h2><a href="https://mega.nz/folder/ABC#key1">get</a></div>
<div class="post">tiny</div><footer><a href="/y">foot</a></footer></body></html>"""


def test_items(spark):
    pages = spark.createDataFrame([(1, "https://a.example/t", PAGE), (2, "https://a.example/u", "<body><p>no item here but some text that is long enough</p></body>"), (3, None, None)], "page_id long, url string, html string")
    got = I.READERS["web"](pages).orderBy("page_id", "place").collect()
    assert [(r.page_id, r.title, r.links, r.downloads) for r in got] == [(1, "First release", 1, 1), (2, None, 0, 0)]
    assert [(r.page_id, r.main, r.place) for r in got] == [(1, False, 1), (2, True, 1)]
    plan = I.READERS["SMF-board"](pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 3 and plan.count("MapInArrow") == 1
    report = {r.name: (r.ok, r.detail) for r in I.preflight(pages).collect()}
    assert report["pages"] == (True, "3") and report["urls"] == (False, "1") and report["contents"][0] is False


@pytest.mark.parametrize(
    "text, upload, want",
    [("DJ SWAN-E AND THE MC", ["Swan-E"], "DJ Swan-E and the MC"), ("THE RSR (SIDE A)", [], "The RSR (Side A)"), ("PIlgrim at night", [], "Pilgrim at night"), ("SS - THE END", [], "SS - The End"), ("FX", ["FX", "mix"], "FX"), ("", [], ""), ("123", [], "123")],
)
def test_recased(spark, text, upload, want):
    row = spark.createDataFrame([(text, upload)], "text string, upload array<string>")
    assert row.select(R.recased(F.col("text"), F.col("upload"))).first()[0] == want


_M = "https://c.example/m/"
TITLES = [
    ("TAPE 7 (SIDE A) – R-TYPE B2B PLAYA", "Tape_7_(Side_A)_-_R-Type_B2B_Playa.mp3", "Tape 7 (Side A) - R-Type B2B Playa"),
    ("SHY FX", "Shy_FX.mp3", "Shy FX"),
    ("JASON KAYE (SIDE A)", "jk.mp3", "Jason Kaye (Side A)"),
    ("SIDE 7 – ECHO / KROME", "s7.mp3", "Side 7 - Echo & Krome"),
    ("Jumping Jack Frost (Side B)", "Tape_5_(Side_B)_-_Jumping_Jack_Frost.mp3", "Tape 5 - Jumping Jack Frost (Side B)"),
    ("TAPE 6 – BILLY HUNTER & MR HYDE", "Tape_6_-_Billy_Bunter_&_Mr_Hyde.mp3", "Tape 6 - Billy Bunter & Mr Hyde"),
    ("PIlgrim & Donovan Badboy Smith", "p.mp3", "Pilgrim & Donovan Badboy Smith"),
    ("", "Side_1_-_Hype%20&amp;_X.mp3", "Side 1 - Hype & X"),
]


def test_names_of_tracks_and_folders(spark):
    rows = spark.createDataFrame([(c, _M + u, w) for c, u, w in TITLES], "caption string, url string, want string")
    got = rows.select("want", R.track_title(F.col("caption"), F.col("url")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    folders = [("Hysteria 9", "1995", "Hysteria 9 (1995)"), ("Amnesia House @ The Edge NYE 1993", "1993", "Amnesia House @ The Edge NYE 1993"), ("ACCELERATED CULTURE 17 &#8211; ENERGY FLUX", "2004", "Accelerated Culture 17 - Energy Flux (2004)")]
    rows = spark.createDataFrame(folders, "title string, year string, want string").withColumn("title", F.replace("title", F.lit("&#8211;"), F.lit("–")))
    assert [r[0] for r in rows.select(R.folder_name(F.col("title"), F.col("year"))).collect()] == [f[2] for f in folders]
    years = spark.createDataFrame([("YEAR: 1994",), ("year 1994",), ("Year : 2002 x",), (None,)], "t string")
    assert [r[0] for r in years.select(naming.labelled_year(F.col("t"))).collect()] == ["1994", "", "2002", ""]


def test_titles_in_steps(spark):
    rows = spark.createDataFrame([(c, _M + u if u else u, w) for c, u, w in [*TITLES, (None, None, "untitled"), ("...", "", "untitled"), ("THE (END", "x.y.mp3", "The (End")]], "caption string, url string, want string")
    got = dedupe.stepwise(rows, R.TITLE, "got", caption="caption", url="url").withColumn("alike", R.track_title(F.col("caption"), F.col("url")))
    assert all(r.got == r.want == r.alike for r in got.collect())


def test_no_word_is_lost_at_a_line_end(spark):
    row = spark.createDataFrame([("(SIDE\nB) X", [])], "text string, upload array<string>")
    assert row.select(R.recased(F.col("text"), F.col("upload"))).first()[0] == "(Side\nb) X"


def test_disagreements(spark):
    rows = [("Andy C (Side A)", "Andy_C_(Side_1).mp3", ""), ("Andy C (Side A)", "Andy_C_(Side_2).mp3", "side a vs upload side 2"), ("tape 2 side a", "tape_3_side_1.mp3", "tape 2 vs upload tape 3"), ("swan (live) e tape 1", "tape_1_swan.mp3", ""), ("Grooverider", "x.mp3", "caption words not in upload name: grooverider")]
    got = spark.createDataFrame([(c, _M + u, w) for c, u, w in rows], "c string, u string, w string").select("w", R.disagreement(F.col("c"), F.col("u")).alias("got")).collect()
    assert [r.got for r in got] == [r.w for r in got]


def _values(spark, column, rows, schema="url string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(column).collect()]


def test_urls(spark):
    u = F.col("url")
    got = _values(spark, urls.reduce(u)["identity"], ["http://www.rapidgator.net/file/abc/x.html", "https://mega.nz/file/id", "https://mega.nz/#!id!key", "https://drive.google.com/drive/u/0/folders/abcdefghij1", "https://rapidgator.net/file/abc...rar", "https://gofile.io/d/X#y", "https://ravetapepacks.com/music/A.MP3", "https://ravetapepacks.com/about.html", "https://swisstransfer.com/es", None, "", "x"])
    assert got == ["rapidgator:abc", None, "mega:id#key", "gdrive:abcdefghij1", None, "gofile.io:https://gofile.io/d/x", "ravetapepacks.com:/music/a.mp3", None, None, None, None, None]
    assert _values(spark, urls.normalise(u), ["//a.b/c.", "<http://a/b(c))>", "ftp://a", None, "http:\\/\\/a\\/b", "https://"]) == ["https://a.b/c", "http://a/b(c)", None, None, "http://a/b", None]
    custom = {"mega": lambda c: (F.concat(F.lit("own:"), c), c)}
    assert _values(spark, urls.reduce(u, ("mega",), custom)["identity"], ["https://mega.nz/file/id"]) == ["own:https://mega.nz/file/id"]
    assert H.enabled_hosts("") == ("rapidgator",) and H.enabled_hosts("nope,mega") == ("mega",) and "mega" in H.enabled_hosts("cloud") and "katfile" not in H.enabled_hosts("cloud")


def test_dates(spark):
    day = dates.parse_date(F.col("url"), F.lit("2024-03-01").cast("date"))
    got = _values(spark, day, ["Hoy", "ayer 10:00", "2025-05-02T10", "Sáb 14 Sep 2024 - 21:34", "April 14th, 2025", "11/04/25, 20:35", "31/02/2020", "1/1/70", "2020-02-31 and 1/1/2020", "yesterdays", None])
    assert [str(d) if d else None for d in got] == ["2024-03-01", "2024-02-29", "2025-05-02", "2024-09-14", "2025-04-14", "2025-04-11", None, "1970-01-01", None, None, None]
