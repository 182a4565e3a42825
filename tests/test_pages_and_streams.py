import io
import json
import zipfile
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from gleanframe import catalog
from gleanframe.operators import handoff
from gleanframe.operators import pages as P
from gleanframe.plans.fixtures import frame
from gleanframe.sources import html as H
from gleanframe.sources import tables as T
from gleanframe.streaming import harvest, store

SF = "/root/testdata/sf0.001"


def test_tree_closes_what_is_left_open():
    nodes = H.parse("<div id=a><p>one<p>two<b>x</div><ul><li>1<li>2</ul><script>if (a<b) {}</script><br/>")
    assert [(n[3], n[0], n[1], n[2]) for n in nodes] == [("div", 0, 3, None), ("p", 1, 1, 0), ("p", 2, 3, 0), ("b", 3, 3, 2), ("ul", 4, 6, None), ("li", 5, 5, 4), ("li", 6, 6, 4), ("script", 7, 7, None), ("br", 8, 8, None)]
    assert "".join(nodes[7][7]) == "if (a<b) {}" and H.parse(None) == []


def test_furniture_by_brute_force(spark):
    class Outside(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.n = 0, 0

        def handle_starttag(self, tag, attrs):
            banned = tag in P.FURNITURE_TAGS
            self.inside += banned
            self.n += tag == "a" and not self.inside

        def handle_endtag(self, tag):
            self.inside -= tag in P.FURNITURE_TAGS

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.n for r in P.outside(H.page_nodes(pages), F.col("tag").isin(*P.FURNITURE_TAGS)).groupBy("page_id").agg(F.count_if(F.col("tag") == "a").alias("n")).collect()}
    for r in pages.collect():
        parser = Outside()
        parser.feed(r.html)
        assert got.get(r.page_id, 0) == parser.n


def test_feeds(spark):
    rss = "<?xml version='1.0'?><rss><channel><item><guid>g1</guid><title>One</title><link>https://a/1</link><description>&lt;b&gt;Bold&lt;/b&gt; text</description></item><item><title>Two</title><link>https://a/2</link></item></channel></rss>"
    atom = "<feed><entry><id>i</id><title>T</title><link rel='self' href='https://s'/><link href='https://b'/><author><name>N</name></author><updated>2024</updated></entry></feed>"
    got = T.feed_entries(spark.createDataFrame([("r", rss), ("a", atom)], "feed_url string, xml string")).orderBy("feed_url", "pos").collect()
    assert [(r.id, r.name, r.url, r.author, r.published, r.summary) for r in got] == [("i", "T", "https://b", "N", "2024", ""), ("g1", "One", "https://a/1", None, None, "Bold text"), ("https://a/2", "Two", "https://a/2", None, None, "")]


def test_archives_and_releases(spark, tmp_path):
    for n, url in ((9, "old"), (10, "new")):
        with zipfile.ZipFile(tmp_path / f"linkcollector{n}.zip", "w") as z:
            z.writestr("00", json.dumps({"name": "Pack", "downloadFolder": "/d"}))
            z.writestr("00_01", json.dumps({"downloadLink": {"url": f"https://{url}"}, "more": [{"url": "https://deep"}]}))
            z.writestr("extraInfo", "{")
    (tmp_path / "downloadList3.zip").write_bytes(b"no zip")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        read = T.read_archives(spark, str(tmp_path))
        todo, exchanged = [read._jdf.queryExecution().executedPlan()], []
        while todo:
            node = todo.pop()
            if "Exchange" in node.nodeName():
                exchanged.append(node.output().mkString(","))
            todo += [node.children().apply(i) for i in range(node.children().size())]
        assert exchanged and not any("content" in e for e in exchanged)
        got = read.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(r.url for r in got if r.url) == ["https://deep", "https://new"]
    assert [(r.name, r.folder) for r in got if r.name] == [("Pack", "/d")]
    (tmp_path / "list.json").write_text(json.dumps({"label": "L", "revealed": 2, "releases": [{"id": str(i), "name": "n", "artists": ["a"]} for i in range(4)]}))
    assert [r.id for r in T.read_releases(spark, str(tmp_path / "list.json")).orderBy("pos").collect()] == ["0", "1"]
    for name, rows in (("posts", [{"id": 1, "title": {"rendered": "T"}, "categories": [3]}]), ("media", [{"id": 1, "post": 1, "source_url": "u", "mime_type": "image/png"}, {"id": 2, "post": 1, "source_url": "v", "mime_type": "audio/mpeg"}]), ("categories", [{"id": 3, "name": "c", "parent": 0}])):
        (tmp_path / f"{name}.js").write_text(json.dumps(rows))
    posts, media, categories = T.read_cms(spark, *(str(tmp_path / f"{n}.js") for n in ("posts", "media", "categories")))
    assert posts.select("title.rendered").first()[0] == "T" and media.count() == 1 and categories.first().name == "c"


def test_packages_are_written(spark, tmp_path):
    links = frame(spark, SF, "fx_links").withColumn("package", F.lit("p")).withColumn("at", F.expr("item_id * 10 + pos"))
    jobs = handoff.packages(links, "at")
    handoff.write_packages(jobs, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().files == jobs.first().files
    named = handoff.named_entries(links, spark.createDataFrame([], "url string, filename string"), "at")
    assert named.count() == jobs.first().files


def _stream(spark, tmp_path, df, parts, run, name):
    source = tmp_path / f"in-{name}"
    for i, rows in enumerate(df.randomSplit([1.0] * parts, 7)):
        rows.coalesce(1).write.parquet(f"{source}/p={i}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    q = stream.writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()


def test_never_twice_is_the_batch_result(spark, tmp_path):
    links = frame(spark, SF, "fx_links").where("item_id % 5 = 0").selectExpr("item_id", "pos", "url", "concat('p', item_id % 3) as package", "item_id * 10 + pos as sent")
    table, out, told = str(tmp_path / "memory"), str(tmp_path / "out"), []
    run = harvest.never_twice(spark, table, out, lambda jobs, n: told.append((n, {r.package for r in jobs.collect()})), buckets=16)
    _stream(spark, tmp_path, links, 3, run, "a")
    keys = [r.file_key for r in harvest.sent_links(spark, out).collect()]
    from gleanframe.operators import dedupe

    want = {r.file_key for r in dedupe.identified(links).where("file_key is not null").collect()}
    assert len(keys) == len(set(keys)) and set(keys) == want
    assert [n for n, _ in told] == [0, 1, 2] and told[0][1] == {"p0", "p1", "p2"}
    before = sorted(harvest.sent_files(spark, table, 16).read().collect())
    run(links, 2)  # a batch that runs again
    assert sorted(harvest.sent_files(spark, table, 16).read().collect()) == before and len(before) == len(want) and len(told) == 3


@pytest.mark.parametrize("fails", ["checked", "packages", "told", "merge"])
def test_a_batch_cut_short_goes_on(spark, tmp_path, monkeypatch, fails):
    """The driver fails between two sinks, and runs the batch again."""
    rows = [(1, 0, "https://mega.nz/folder/A#k", "p", 1), (1, 1, "https://mega.nz/folder/B#k", "p", 2), (2, 0, "https://mega.nz/folder/A#k", "q", 3), (2, 1, "https://mega.nz/folder/C#k", "q", 4)]
    links = spark.createDataFrame(rows, "item_id long, pos int, url string, package string, sent long")
    told, table, out = [], str(tmp_path / "memory"), str(tmp_path / "out")
    run = harvest.never_twice(spark, table, out, lambda jobs, n: told.append([r.text for r in jobs.collect()]), lambda new: new.where("url not like '%B#k'"), buckets=8)

    def broken(*_):
        raise OSError("lost")

    whole_step, whole_mark, whole_merge = store.Steps.step, store.Steps.mark, store.Buckets.merge
    with monkeypatch.context() as m:
        m.setattr(store.Steps, "step", lambda self, name, make: broken() if name == fails else whole_step(self, name, make))
        m.setattr(store.Steps, "mark", lambda self, name: broken() if name == fails else whole_mark(self, name))
        m.setattr(store.Buckets, "merge", broken if fails == "merge" else whole_merge)
        with pytest.raises(OSError):
            run(links, 0)
    run(links, 0)
    run(links, 0)
    want = ["https://mega.nz/folder/A#k", "https://mega.nz/folder/C#k"]
    assert all(sorted(t) == want for t in told) and len(told) == (2 if fails == "told" else 1)
    assert sorted((r.file_key, r.first_sent, r.last_seen) for r in harvest.sent_files(spark, table, 8).read().collect()) == [("mega:A#k", 1, 3), ("mega:B#k", 2, 2), ("mega:C#k", 4, 4)]


def test_a_merge_rewrites_what_it_touches(spark, tmp_path):
    path = tmp_path / "t"
    table = store.Buckets(spark, str(path), "k long, v string", ["k"], 512)
    whole = lambda past, rows: past.join(rows, "k", "left_anti").unionByName(rows)
    table.merge(spark.range(20_000).selectExpr("id as k", "'old' as v"), whole)
    files = lambda: {(f, f.stat().st_mtime_ns) for f in path.glob("bucket=*/*.parquet")}
    before = files()
    batch = spark.range(19_990, 20_030).selectExpr("id as k", "'new' as v")
    assert table.merge(batch, whole) <= 40
    after = files()
    assert 0 < len(before - after) <= 40 < len(before) // 10  # keys of a batch over folders bound what is rewritten
    assert table.read().groupBy("v").count().orderBy("v").collect() == [("new", 40), ("old", 19_990)]
    table.merge(batch, whole)
    assert table.read().groupBy("v").count().orderBy("v").collect() == [("new", 40), ("old", 19_990)]
    assert table.read(batch).count() < 3_000


def test_a_merge_cut_short_is_put_in_place(spark, tmp_path, monkeypatch):
    table = store.Buckets(spark, str(tmp_path / "t"), "k long, v string", ["k"], 4)
    union = lambda past, rows: past.unionByName(rows).distinct()
    table.merge(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), union)
    put = store.Buckets._put

    def lost(self):
        if (tmp_path / "t/_new/_SUCCESS").exists():
            raise OSError("lost")
        put(self)

    with monkeypatch.context() as m:
        m.setattr(store.Buckets, "_put", lost)
        with pytest.raises(OSError):
            table.merge(spark.createDataFrame([(3, "c")], "k long, v string"), union)
    assert sorted(table.read().collect()) == [(1, "a"), (2, "b"), (3, "c")]
    (tmp_path / "t/_new/bucket=0").mkdir(parents=True)  # not whole: dropped
    assert table.read().count() == 3 and not (tmp_path / "t/_new").exists()
    assert table.merge(spark.createDataFrame([], "k long, v string"), union) == 0


def test_baseline_is_silent(spark, tmp_path):
    run = harvest.after_baseline(spark, str(tmp_path / "seen"), str(tmp_path / "new"), 8)
    rows = lambda *ids: spark.createDataFrame([(1, i) for i in ids], "store long, release_id long")
    run(rows(1, 2), 0)
    run(rows(2, 3, 3), 1)
    run(rows(2, 3, 3), 1)
    run(rows(3, 4), 2)
    assert sorted((r.batch, r.release_id) for r in harvest.sent_links(spark, str(tmp_path / "new"), "new").collect()) == [(1, 3), (2, 4)]


#: Moves by hand: to_state, lawful, state and attempts afterwards.
STORY = [("filed", False, "new", 0), ("queued", True, "queued", 0), ("failed", True, "failed", 1), ("claimed", False, "failed", 1), ("queued", True, "queued", 1), ("claimed", True, "claimed", 1), ("downloading", True, "downloading", 1), ("quarantined", True, "quarantined", 1), ("queued", True, "queued", 1), ("claimed", True, "claimed", 1), ("downloading", True, "downloading", 1), ("verified", True, "verified", 1), ("failed", True, "failed", 2), ("queued", True, "queued", 2), ("cancelled", True, "cancelled", 2), ("filed", False, "cancelled", 2)]


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_queue_moves(spark, span):
    moves = spark.createDataFrame([(q, i, s[0]) for q in (1, 2) for i, s in enumerate(STORY)], "queue_id long, seq long, to_state string")
    got = sorted(harvest.replay_queue(moves, span).collect(), key=lambda r: (r.queue_id, r.seq))
    assert [(r.legal, r.attempts) for r in got] == [(s[1], s[3]) for s in STORY] * 2
    assert [r.from_state for r in got] == ["new", *(s[2] for s in STORY[:-1])] * 2


@pytest.mark.parametrize("delay", ["10 minutes"])
def test_windows_over_a_stream(spark, tmp_path, delay):
    events = frame(spark, SF, "fx_trace")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    q = harvest.stage_counts(stream, delay=delay).writeStream.format("memory").queryName("stage_windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("stage_windows").agg(F.sum("n")).first()[0] == events.count()


def _topic_page(topic, at, pager, day):
    links = "".join(f'<a href="/index.php?topic={topic}.{o}">{o}</a>' for o in pager)
    post = f'<div class="keyinfo">{day}, 11:30</div><div class="post">text</div>'
    return f"https://b.invalid/index.php?topic={topic}.{at}", f"<html><body>{links}<p><a href='/index.php?topic=9.5'>x</a></p>{post}</body></html>"


def test_walks_resume_where_the_last_one_stopped(spark, tmp_path):
    """A topic that grows, one that is pruned, one with a page missing, one with an old post; page sizes differ."""
    new, old = "2026-04-02", "2019-04-02"
    grow = lambda topic, size, last, skip=(), age=None: [_topic_page(topic, o, [p for p in (size, last) if 0 < p <= last], old if o == age else new) for o in range(0, last + 1, size) if o not in skip]
    batches = [
        grow(1, 20, 80) + grow(2, 10, 50) + grow(3, 15, 60, skip=(30,)) + grow(4, 25, 100, age=50) + grow(5, 15, 0),
        grow(1, 20, 120) + grow(2, 10, 20) + grow(3, 15, 75) + grow(4, 25, 100, age=50) + grow(5, 15, 30),
        grow(3, 15, 90),
    ]
    run = harvest.resumed_walks(spark, str(tmp_path / "marks"), str(tmp_path / "out"), "pager", buckets=4)
    since, as_of = (F.lit(d).cast("date") for d in ("2025-01-01", "2026-06-01"))

    def read(batch, version):
        nodes = H.page_nodes(batch)
        posts = P.outermost(nodes, F.array_contains("classes", "post")).select("page_id", "pre", "end")
        run(P.topic_pages(batch, nodes, posts, as_of, since), version)

    source = tmp_path / "in"
    stream = spark.readStream.schema(T.PAGES).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    for n, made in enumerate(batches):
        spark.createDataFrame([(i, *r) for i, r in enumerate(made)], T.PAGES).coalesce(1).write.parquet(f"{source}/b={n}")
        stream.writeStream.foreachBatch(read).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {}
    for r in harvest.sent_links(spark, str(tmp_path / "out"), "read").orderBy(F.desc("offs")).collect():
        got.setdefault((r.batch, r.topic_id), []).append(r.offs)
    assert got == {
        (0, 1): [80, 60, 40, 20, 0], (0, 2): [50, 40, 30, 20, 10, 0], (0, 3): [60, 45], (0, 4): [100, 75, 50], (0, 5): [0],
        (1, 1): [120, 100, 80], (1, 2): [20, 10, 0], (1, 3): [75, 60, 45, 30, 15, 0], (1, 4): [100], (1, 5): [30, 15, 0],
        (2, 3): [90, 75],
    }
    marks = harvest.thread_marks(spark, str(tmp_path / "marks"), 4).read()
    assert sorted(map(tuple, marks.collect())) == [(1, 120), (2, 20), (3, 90), (4, 100), (5, 30)]


def test_authors_by_their_place(spark):
    """Before or behind a post, never in it, its quotes or signatures."""
    who = lambda n: f'<a href="/index.php?action=profile;u={n}">m{n}</a>'
    left = f"<div>{who(1)}</div><div class=post>a {who(9)}</div><div class=signature>{who(8)}</div><div>{who(2)}</div><div class=post><blockquote>{who(7)}</blockquote></div>"
    right = f"<div class=post>a</div><div>{who(3)}</div>"
    nobody = "<div class=post>x</div>"
    nodes = H.page_nodes(spark.createDataFrame([(1, "", left), (2, "", right), (3, "", nobody)], T.PAGES))
    posts = P.outermost(nodes, F.array_contains("classes", "post"))
    got = [(r.page_id, r.author, r.author_id) for r in P.authors(nodes, posts).orderBy("page_id", "item").collect()]
    assert got == [(1, "m1", 1), (1, "m2", 2), (2, "m3", 3), (3, None, None)]


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_a_queue_stream_begun_from_a_snapshot(spark, tmp_path, rocks):
    moves = frame(spark, SF, "fx_queue").where("queue_id < 12")
    whole = sorted(map(tuple, harvest.replay_queue(moves).collect()))
    third = moves.selectExpr("percentile(seq, array(0.3, 0.6, 0.8))").first()[0]
    early = harvest.queue_snapshot(harvest.replay_queue(moves.where(F.col("seq") <= third[0])))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        source = tmp_path / "in"
        stream = harvest.stream_queue(spark.readStream.schema(moves.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*"), early)
        for n, (a, b) in enumerate(zip(third, [*third[1:], 1e18])):
            moves.where((F.col("seq") > a) & (F.col("seq") <= b)).coalesce(1).write.parquet(f"{source}/b={n}")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == [r for r in whole if r[1] > third[0]] and len(got) > 50


def test_packages_by_names_and_by_time(spark, tmp_path, rocks):
    """One that completes, one whose time is over, one that stays open, whose state is read back."""
    import time

    spark.conf.set("spark.sql.shuffle.partitions", "2")
    source, kind = tmp_path / "in", "package string, name string, came boolean"
    put = lambda n, *rows: spark.createDataFrame(list(rows), kind).coalesce(1).write.parquet(f"{source}/b={n}")
    put(0, ("whole", "a", False), ("whole", "b", False), ("late", "a", False), ("late", "c", False))
    query = harvest.watch_packages(spark.readStream.schema(kind).parquet(f"{source}/*"), 15).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    out = lambda: sorted(map(tuple, spark.read.schema("package string, found int, wanted int, complete boolean").parquet(str(tmp_path / "out")).collect())) if (tmp_path / "out").exists() else []

    def wait(n):
        end = time.time() + 60
        while len(out()) < n and time.time() < end:
            time.sleep(0.5)
        return out()

    try:
        put(1, ("whole", "a", True), ("whole", "b", True), ("late", "c", True))
        assert wait(1)[-1] == ("whole", 2, 2, True)
        assert wait(2) == [("late", 1, 2, False), ("whole", 2, 2, True)]
        # in one batch a package begins, and stays open while the query is stopped
        put(2, ("open", "x", False), ("open", "y", True), ("whole", "a", False))
        end = time.time() + 60  # batches go on for the timers' sake: a stream of this kind never has all done
        while sum(p["numInputRows"] for p in query.recentProgress) < 10 and time.time() < end:
            time.sleep(0.2)
    finally:
        query.stop()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    state = spark.read.format("statestore").option("stateVarName", "wanted").load(str(tmp_path / "cp"))
    held = {(r.key.package, r.user_map_key.name, r.user_map_value.came) for r in state.select("key", "user_map_key", "user_map_value").collect()}
    assert {h for h in held if h[0] == "open"} == {("open", "x", False), ("open", "y", True)}
    assert len(out()) == 2
