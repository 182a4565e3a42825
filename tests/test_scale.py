"""What must not grow with a table: nodes held of a page, moves by group, parses of a page, exchanges."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from gleanframe import catalog, catalog_pages
from gleanframe.functions import naming
from gleanframe.llm import language
from gleanframe.operators import items
from gleanframe.operators import pages as P
from gleanframe.sources import fold, readers
from gleanframe.sources import html as H
from gleanframe.streaming import harvest


def test_nodes_of_a_long_page_go_out_as_they_end():
    page = "<table><tr><th>x</th></tr>" + "".join(f'<tr><td><a href="/t?x={i}&amp;y">a &lt; {i}</a><td>{i}</tr>' for i in range(20_000)) + "</table>&amp <b>end"
    found = list(H.ended(page))
    assert max(map(len, found)) < 20_000 < sum(map(len, found))
    whole = sorted((n for part in H.ended(page, len(page)) for n in part), key=lambda n: n[0])
    assert [(*n[:7], "".join(n[7])) for n in H.parse(page)] == [(*n[:7], "".join(n[7])) for n in whole]


def test_pieces_of_any_size_give_the_same_nodes():
    for page in ("", "x", "<a", "<p>a&am", "<script>if (a<b) x</scr", "<script>a</script>z &amp", "<!-- a <b> --><i>x", "<a title='<<<>'>t</a>&lt;<b>", "<ul><li>a<li>b<br/></ul>c"):
        whole = [(*n[:7], "".join(n[7])) for n in H.parse(page)]
        for piece in (1, 3, 10):
            got = sorted((n for part in H.ended(page, piece) for n in part), key=lambda n: n[0])
            assert [(*n[:7], "".join(n[7])) for n in got] == whole


def _walk(moves):
    out, state, attempts = [], "new", 0
    for queue, seq, to in sorted(moves):
        legal = to in harvest.MOVES[state]
        attempts += legal and to == "failed"
        out.append((queue, seq, state, to, legal, attempts))
        state = to if legal else state
    return out


def test_ranges_of_a_queue_hold_many_moves_however_far_their_numbers_lie_apart(spark):
    names = list(harvest.MOVES)
    moves = [(q, i * 1_000_003 + q, names[(i * 7 + q + i // 5) % len(names)]) for q, n in ((1, 500), (2, 3), (3, 41)) for i in range(n)]
    df = spark.createDataFrame(moves, "queue_id long, seq long, to_state string")
    want = sorted(r for q in (1, 2, 3) for r in _walk([m for m in moves if m[0] == q]))
    for span in (1, 40, 1000):
        assert sorted(map(tuple, harvest.replay_queue(df, span).collect())) == want
    plan = harvest.replay_queue(df)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan


def test_a_year_inside_a_longer_number_is_no_year_of_the_title(spark):
    rows = [("Pack No 19908", "1990", "Pack No 19908 (1990)"), ("Rave 1990", "1990", "Rave 1990"), ("1990-91", "1990", "1990-91"), ("x", None, "x"), ("x", "", "x")]
    df = spark.createDataFrame(rows, "title string, year string, want string")
    assert all(r.got == r.want for r in df.select("want", naming.folder_name(df.title, df.year).alias("got")).collect())


def test_page_titles_in_the_letters_of_the_source(spark):
    pages = spark.createDataFrame([(1, '<title>a &amp; &quot;b&quot; &amp</title><div class="post">x</div>')], "page_id long, html string")
    nodes = H.page_nodes(pages)
    posts = P.outermost(nodes, F.array_contains("classes", "post"))
    given = spark.createDataFrame([(1, "a & &quot;b&quot; &amp")], "page_id long, page_title string")
    assert P.titles(nodes, posts).first().title == 'a & "b" &'
    assert P.titles(nodes, posts, given).first().title == "a & &quot;b&quot; &amp"


def test_filters_learn_from_every_training_document(spark):
    common = spark.range(12_000).selectExpr("id as doc_id", "'aaa' as text", "'x' as lang")
    words = [chr(97 + i) * 3 for i in range(1, 26)]
    rare = spark.createDataFrame([(20_000 + 4 * i + j, w, "x") for i, w in enumerate(words) for j in range(4)], common.schema)
    trained = rare.where(~language.held_out()).select("text").distinct()
    f = language.fit(common.union(rare))
    scores, _ = f.scores([r.text for r in trained.collect()])
    assert len(scores) > 20 and (scores > 0.99).all()


def test_small_files_share_partitions():
    assert len(readers.packed([(str(i), 100) for i in range(50_000)])) == 196
    assert readers.packed([("a", 1), ("b", 1)]) == [["a"], ["b"]]
    big = readers.packed([(str(i), readers.BYTES) for i in range(1000)])
    assert len(big) == 1000 and readers.packed([]) == []


def test_rows_of_a_long_board_go_out_in_bounded_batches():
    row = '<tr><td><a href="/index.php?topic={0}.0">Topic name {0}</a></td><td><a href="/index.php?action=profile;u=1">m</a></td><td>1</td></tr>'
    page = '<table class="table_grid">' + "".join(row.format(i) for i in range(2_500)) + "</table>"
    batch = pa.RecordBatch.from_pydict({"page_id": [1, 2], "url": ["https://b.example/index.php?board=5.0"] * 2, "html": [page, page]})
    sizes = [b.num_rows for b in fold.in_rows([batch], items._rules("SMF-board"), 1000)]
    assert max(sizes) == 1000 and sum(sizes) == 2 * 2_501


def test_archives_are_made_one_at_a_time():
    kind, rows = ["linkcollector", "downloadList"], [[{"p_partkey": 1, "p_name": "a"}]] * 2
    made = catalog_pages._zip([pa.RecordBatch.from_pydict({"kind": kind, "n": [2, 2], "rows": rows})])
    assert next(made)[0] == "linkcollector2.zip" and next(made) == ("downloadList2.zip", b"cut short")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_each_link_of_an_item_is_normalised_once(spark):
    pages = spark.createDataFrame([(1, "https://s.example/a", "<p>x</p>")], "page_id long, url string, html string")
    assert _plan(items.read_items(pages, "SMF")).count("&nbsp;") == 1


def test_each_link_of_a_page_is_normalised_once(spark):
    pages = spark.createDataFrame([(1, "https://s.example/a", "<p>x</p>")], "page_id long, url string, html string")
    assert _plan(P.page_links(pages, H.page_nodes(pages))).count("&nbsp;") == 1


def test_a_page_is_searched_once_and_tasks_share_the_pages_of_a_small_file(spark):
    from gleanframe import catalog
    from gleanframe.operators import detect

    marked = catalog._marked(spark, "/root/testdata/sf0.001")
    assert "RepartitionByExpression" in _plan(marked)
    assert _plan(detect.software(marked)).count("RLIKE") == sum(len(marks) for _, marks in detect.SIGNATURES)


def test_a_stream_goes_on_behind_what_it_has_had(spark, tmp_path):
    for n in range(2):
        spark.range(1000 * n, 1000 * n + 1000, 1, 4).write.parquet(f"{tmp_path}/in/b={n}")
        got = harvest.resumed(spark.readStream.schema("id long").parquet(f"{tmp_path}/in/*"), f"{tmp_path}/at")
        assert got.count() == got.distinct().count() == 1000 * n + 1000


def test_moves_of_a_queue_stream_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog_pages, "new_path", lambda s, name: str(tmp_path / name))
    monkeypatch.setattr(catalog_pages, "frame", lambda *a: spark.range(300, 2300, 1, 4).selectExpr("id % 40 as queue_id", "id as seq", "case id % 3 when 0 then 'queued' else 'claimed' end as to_state"))
    catalog_pages.query.__globals__["_QUERIES"]["w4_queue_stream"](spark, "")
    assert len(list((tmp_path / "queue" / "in" / "b=1").glob("part-*"))) > 1


def test_pages_of_a_small_file_are_dealt_before_they_are_parsed(spark):
    assert "RepartitionByExpression" in _plan(catalog_pages._extra(spark, "/root/testdata/sf0.001"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_titles_of_posts_take_one_exchange_of_nodes(spark):
    board = '''<nav>n<div class="post">menu</div></nav><form id="f"><div class="post">log in</div><p><input type="password"></p></form><form><div class="post">one<div class="post"> inner</div>
        <blockquote>said</blockquote> <a href="/x">label</a></div></form><input type="password"><blockquote><div class="post">quoted</div></blockquote><div class="post"><a href="https://www.discogs.com/release/1-Some-Name">d</a></div><div class="post"></div>'''
    nodes = H.page_nodes(spark.createDataFrame([(1, board), (2, '<div class="post">two</div>')], "page_id long, html string"))
    found = P.post_titles(nodes, F.array_contains("classes", "post"), furniture=False)
    assert _plan(found).count("Exchange hashpartitioning") == 1 and "Join" not in _plan(found)
    want = [(1, "one inner"), (1, "quoted"), (1, "Some Name"), (1, None), (2, "two")]
    assert [(r.page_id, r.title) for r in found.orderBy("page_id", "item").collect()] == want
    kept = P.without_furniture(nodes)
    posts = P.outermost(kept, F.array_contains("classes", "post"))
    assert sorted(map(tuple, P.post_titles(kept, posts).collect()), key=str) == sorted(map(tuple, found.collect()), key=str)


def test_authors_of_posts_take_one_exchange_of_marks(spark):
    by = lambda n: f'<a href="/index.php?action=profile;u={n}"> m{n} </a>'
    board = f'{by(1)}<div class="post">{by(9)}<div class="post">in</div></div><div class="sig">{by(8)}</div><div class="post">b</div>{by(2)}<blockquote>{by(7)}<div class="post">q</div></blockquote><div class="post">c</div>'
    pages = spark.createDataFrame([(1, board), (2, '<div class="post">none</div>')], "page_id long, html string")
    nodes = H.page_nodes(pages)
    found = P.authors(nodes, F.array_contains("classes", "post"))
    assert _plan(found).count("Exchange hashpartitioning") == 1 and "Join" not in _plan(found)
    got = [(r.page_id, r.author, r.author_id) for r in found.orderBy("page_id", "item").collect()]
    assert got == [(1, "m1", 1), (1, "m2", 2), (1, "m2", 2), (2, None, None)]
    by_rows = P.authors(nodes, P.outermost(nodes, F.array_contains("classes", "post")))
    assert sorted(map(tuple, by_rows.collect())) == sorted(map(tuple, found.collect()))


def test_dates_of_posts_take_one_exchange_of_nodes(spark):
    board = \
        '<div class="keyinfo">on <b>11/04/25</b>, 10:00<script>1/1/01, 1:00</script></div><div class="post">a <div class="post">1/2/03, 1:00</div></div>' \
        '<p>12/04/25, 11:00</p><div class="post">b<blockquote><div class="keyinfo">2/2/02, 2:00</div></blockquote></div>' \
        '<div class="post"><div class="date">13/04/25</div>c<time datetime="2025-04-14">x</time></div><div class="date">no day</div><div class="post"><div class="date">15/04/25</div></div>'
    nodes = H.page_nodes(spark.createDataFrame([(1, board), (2, '<div class="post">1/2/03, 1:00</div>')], "page_id long, html string"))
    found = P.post_dates(nodes, F.array_contains("classes", "post"), F.lit("2026-06-01").cast("date"))
    assert _plan(found).count("Exchange hashpartitioning") == 1 and "Join" not in _plan(found)
    got = [(r.page_id, r.day and f"{r.day:%d}") for r in found.orderBy("page_id", "item").collect()]
    assert got == [(1, "11"), (1, "11"), (1, "14"), (1, "15"), (2, None)]
    by_rows = P.post_dates(nodes, P.outermost(nodes, F.array_contains("classes", "post")), F.lit("2026-06-01").cast("date"))
    assert sorted(map(tuple, by_rows.collect()), key=str) == sorted(map(tuple, found.collect()), key=str)


def test_plain_tags_are_read_as_the_parser_reads_them(monkeypatch):
    odd = ['<a href="/x" class="a b">', "<a href='y'>", '<A HREF="/Q">', '<a href="1&amp;2">', '<a href="1>2">', '<a href="x""y">', '<a a="1" a="2">', "<script>", "</script>", "<title>", "</title>", "<titles>", "</p >", "<br/>", "<div\n>", "</", "</a>", "x", "&lt;<b>", "<p"]
    pages = [a + b + c for a in odd for b in odd for c in ("", "</b>", '<i id="q">z')]
    fast = [H.parse(p) for p in pages]
    for name in ("parse_starttag", "parse_endtag"):
        monkeypatch.setattr(H._Tree, name, getattr(H.HTMLParser, name))
    assert fast == [H.parse(p) for p in pages]
    called = []
    monkeypatch.undo()
    monkeypatch.setattr(H.HTMLParser, "parse_starttag", lambda self, i: called.append(i) or len(self.rawdata))
    H.parse('<div class="post"><a href="/x">y</a></div>')
    assert not called


def test_titles_of_a_file_of_one_row_group_are_made_by_many_tasks_each_step_once(spark, tmp_path):
    pq.write_table(pa.table({"p_partkey": pa.array(range(1000), pa.int64())}), tmp_path / "part.parquet")
    for name in ("n7_track_titles", "n8_disagreements", "n10_folder_names"):
        assert catalog.queries()[name](spark, str(tmp_path)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = catalog.queries()["n7_track_titles"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[–—‒]") == 2 and plan.count("UrlCodec.decode") == 1


def test_marks_of_a_content_system_count_wherever_they_stand_in_a_page(spark, tmp_path):
    import duckdb

    rows = [(n, "https://x.example/a", ("<p>words</p>" * 20_000 if n % 2 else "") + end) for n, end in enumerate(("", "<i>", "", "<p>", "", "<b>", "", "", "<u>"))] + [(11, "https://x.example/", "y" * 250_000), (14, "https://x.example/", "y" * 250_000)]
    pq.write_table(pa.table({"page_id": [r[0] for r in rows], "url": [r[1] for r in rows], "html": [r[2] for r in rows]}), tmp_path / "pages.parquet")
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{tmp_path}/pages.parquet'")
    for name in ("d4_readers", "d3_page_flags"):
        got = catalog.queries()[name](spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == sorted(db.execute(catalog.oracle_sql()[name]).fetchall())
    assert dict(map(tuple, catalog.queries()["d4_readers"](spark, str(tmp_path)).collect()))["cms"] == 3


def test_workers_give_free_memory_back_at_the_end_of_a_task(monkeypatch):
    from gleanframe.llm import near_dup

    given = []
    for module in (language, near_dup):
        monkeypatch.setattr(module, "give_back", lambda m=module: given.append(m.__name__))
    texts = pa.array(["some words of a text", None, "more words"])
    rows = [*language._count([pa.RecordBatch.from_arrays([pa.array(["en", "en", "de"]), texts], names=["lang", "text"])]), *near_dup._sets(2, 96)([pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), texts], names=["doc_id", "text"])])]
    assert len(rows) == 3 and given == [language.__name__, near_dup.__name__]


def test_boards_read_in_a_stream_say_what_whole_ones_say():
    import random

    rng, rules = random.Random(5), items._rules("SMF-board")
    row = lambda i: f'<tr class="r"><td></td><td><a href="/index.php?topic={i}.0">Topic name {i}</a>{rng.choice(["", " see //x.example/f", "<table><tr><td>in<td>ner</table>"])}</td><td><a href="/index.php?action=profile;u={i % 3}">member {i % 3}</a></td><td>{rng.choice(["1.234", "0", ""])}</td></tr>'
    other = ("<div class=post>", "</div>", "<h2>A head <b>line</b></h2>", '<div id="content">', "<main>", "</main>", "<nav><a href='/n'>menu item</a></nav>", '<table class="table_grid">', "</table>", "<h1>", "<p>words &amp; more", '<span class="title">', "</span>", "<form action='/x'>", "</form>", "<tr><td>no topic", "<br>", '<a data-url="/d" href="/y">a link to all</a>', "<script>//s.example</script>", "<body>", "<ul role=main>", "<li>one<li>two")
    streamed = 0
    for n in range(300):
        body = "".join(row(i) if rng.random() < 0.5 else rng.choice(other) for i in range(rng.choice([3, 20, 60])))
        page = rng.choice(["", "<html><head><title> The  board</title></head><body>", "<title>x</title><header><a href='/h'>home page</a></header>"]) + '<table class="table_grid">' + body + rng.choice(["", "</table>", "<title>late</title>", "<input>"])
        if not fold.in_stream(page):
            continue
        streamed += 1
        said = lambda rows: [(*r[:6], *r[8:10], sorted(set(r[10])), sorted(set(r[11])), *r[12:], *(() if r[2] else r[6:8])) for r in rows]
        want = said(fold._rows(1, "u", page, rules))
        for piece in (1, 40, 700, 1 << 18):
            assert said(fold.board_rows(1, "u", page, rules, piece)) == want
    assert streamed > 100


def test_of_a_long_board_no_nodes_are_held(monkeypatch):
    row = '<tr><td></td><td><a href="/index.php?topic={0}.0">Topic name {0}</a></td><td><a href="/index.php?action=profile;u=1">m</a></td><td>1</td></tr>'
    page = '<html><body><table class="table_grid">' + "".join(row.format(i) for i in range(30_000)) + "</table></body></html>"
    most, made = 0, fold.Page.__init__

    def counted(self, tree, rules):
        nonlocal most
        most = max(most, len(tree))
        made(self, tree, rules)

    monkeypatch.setattr(fold.Page, "__init__", counted)
    batch = pa.RecordBatch.from_pydict({"page_id": [1], "url": ["https://b.example/index.php?board=5.0"], "html": [page]})
    found = pa.Table.from_batches(fold.in_rows([batch], items._rules("SMF-board"), 1000))
    assert most < 20_000
    assert found.num_rows == 30_000 + 4 and sum(map(len, found.column("hrefs").to_pylist())) == 30_000 * 2 + 30_001
