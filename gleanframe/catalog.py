"""All registered queries on stored pages, links and history, with the SQL that states the same results.

A query takes (spark, sf_dir); its inputs are the given tables or views derived from them (plans.fixtures).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import dates, formats, naming, urls
from .functions import hosts as H
from .operators import candidates as C
from .operators import chains, cms, counts, dedupe, detect, handoff, history, windows
from .plans.fixtures import frame, sql
from .sources.html import by_page

_QUERIES: dict = {}
_SQL: dict[str, str] = {}
ALL = H.enabled_hosts("all")
AS_OF = "2024-02-10"
_ORDER = ["pos", "part", "supp"]

# the same identities in plain SQL, for the forms of url in the derived links
_ID = r"""case when contains(url, '...') then null
 when regexp_matches(url, '^https?://(www\.)?rapidgator\.net/file/[A-Za-z0-9]+') then concat('rapidgator:', regexp_extract(url, '/file/([A-Za-z0-9]+)', 1))
 when contains(url, 'mega.nz/folder/') then concat('mega:', regexp_extract(url, 'folder/(.+)$', 1))
 when contains(url, '#F!') then concat('mega:', regexp_extract(url, '#F!([^!]+)!', 1), '#', regexp_extract(url, '!([^!]+)$', 1))
 when contains(url, '?id=') then concat('gdrive:', regexp_extract(url, 'id=([A-Za-z0-9_-]{10,})', 1))
 when contains(url, 'mediafire.com/file') then concat('mediafire.com:', lower(rtrim(url, '/'))) end"""
_CANON = r"""case when contains(url, '...') then null
 when regexp_matches(url, '^https?://(www\.)?rapidgator\.net/file/') then concat('https://rapidgator.net/file/', regexp_extract(url, '/file/(.+)$', 1))
 when contains(url, 'mega.nz/folder/') then url
 when contains(url, '#F!') then concat('https://mega.nz/folder/', regexp_extract(url, '#F!([^!]+)!', 1), '#', regexp_extract(url, '!([^!]+)$', 1))
 when contains(url, '?id=') then concat('https://drive.google.com/file/d/', regexp_extract(url, 'id=([A-Za-z0-9_-]{10,})', 1))
 when contains(url, 'mediafire.com/file') then rtrim(url, '/') end"""
_HOST = r"regexp_replace(regexp_replace(lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)), ':.*$', ''), '^www\.', '')"
_LINKS = f", ids as (select *, {_ID} as file_key, {_CANON} as canonical, {_HOST} as host from fx_links)"
_KEPT = _LINKS + ", kept as (select * from (select *, row_number() over (partition by item_id, file_key order by pos, part, supp) as n from ids where file_key is not null) where n = 1)"


def query(name: str, statement: str | None = None):
    """Register a query, and what it returns in plain SQL."""

    def register(f):
        _QUERIES[name] = f
        if statement is not None:
            _SQL[name] = statement
        return f

    return register


def _expressions(statement: str) -> list[str]:
    """The expressions of a plain select, apart at the commas outside brackets."""
    body, out, depth = statement.removeprefix("select ").rsplit(" from ", 1)[0], [""], 0
    for c in body:
        depth += (c == "(") - (c == ")")
        out.append("") if c == "," and not depth else out.__setitem__(-1, out[-1] + c)
    return out


def queries():
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _pages(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet")


def _links(spark, d):
    return dedupe.identified(frame(spark, d, "fx_links"))


def _kept(spark, d):
    return dedupe.item_downloads(frame(spark, d, "fx_links"), _ORDER)


# --- urls -------------------------------------------------------------------------------------------------------------


@query("u1_host_only", f"select page_id, {_HOST} as host from pages")
def _(spark, d):
    return _pages(spark, d).select("page_id", urls.host_only(F.col("url")).alias("host"))


_MESSY = """case l_partkey % 5 when 0 then concat(' <http://a.example/x', cast(l_partkey as string), '>., ') when 1 then concat('//b.example/(y)', cast(l_partkey as string), '))')
 when 2 then concat('ftp://c.example/', cast(l_partkey as string)) when 3 then concat('https:', '\\\\/\\\\/', 'd.example/', cast(l_partkey as string), '?a=1&amp;b=2;') else 'https://' end"""
_CLEAN = """case l_partkey % 5 when 0 then concat('http://a.example/x', cast(l_partkey as string)) when 1 then concat('https://b.example/(y)', cast(l_partkey as string))
 when 3 then concat('https://d.example/', cast(l_partkey as string), '?a=1&b=2') end"""


@query("u2_normalise", f"select {_CLEAN} as url, count(*) as n from lineitem group by 1")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr(f"{_MESSY} as raw")
    return rows.groupBy(urls.normalise(F.col("raw")).alias("url")).agg(F.count("*").alias("n"))


@query("u3_find_urls", sql("fx_links") + " select item_id, 2 * count(*) as n, 2 * sum(length(url)) as chars from fx_links group by 1")
def _(spark, d):
    text = F.concat(F.lit("see "), F.col("url"), F.lit(" or <"), F.col("url"), F.lit("> !"))
    rows = frame(spark, d, "fx_links").select("item_id", F.explode(urls.find_urls(text)).alias("u"))
    return rows.groupBy("item_id").agg(F.count("*").alias("n"), F.sum(F.length("u")).alias("chars"))


@query("u4_decoded_twins", "select l_partkey % 50 as k, concat('https://x.example/a b', cast(l_partkey % 50 as string), '+c') as url, count(*) as n from lineitem group by 1, 2 union all select l_partkey % 50, concat('https://x.example/a%20b', cast(l_partkey % 50 as string), '+c'), count(*) from lineitem group by 1, 2")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_partkey % 50 as k", "concat('https://x.example/a%20b', cast(l_partkey % 50 as string), '+c') as url")
    return rows.select("k", F.explode(urls.with_decoded(F.array("url"))).alias("url")).groupBy("k", "url").agg(F.count("*").alias("n"))


@query("u5_buckets", sql("fx_links") + f", h as (select {_HOST} as host from fx_links) select case when contains(host, 'github.com') then 'source' when regexp_matches(host, '(rapidgator|mega|mediafire|drive.google)') then 'build' else 'other' end as bucket, count(*) as n from h group by 1")
def _(spark, d):
    return frame(spark, d, "fx_links").groupBy(urls.bucket(urls.host_only(F.col("url"))).alias("bucket")).agg(F.count("*").alias("n"))


@query("u6_premium", sql("fx_links") + f" select {_HOST} as host, contains(url, 'rapidgator.net') as premium, count(*) as n from fx_links group by 1, 2")
def _(spark, d):
    host = urls.host_only(F.col("url"))
    return frame(spark, d, "fx_links").groupBy(host.alias("host"), urls.premium(host).alias("premium")).agg(F.count("*").alias("n"))


@query("u7_labels", sql("fx_links") + f", h as (select {_HOST} as host from fx_links) select case host when 'rapidgator.net' then 'Rapidgator' when 'mega.nz' then 'MEGA' when 'mega.co.nz' then 'MEGA' when 'drive.google.com' then 'Google Drive' when 'swisstransfer.com' then 'SwissTransfer' when 'mediafire.com' then 'MediaFire' else 'source' end as label, count(*) as n from h group by 1")
def _(spark, d):
    rows = frame(spark, d, "fx_links").select("url", *urls.classify(F.col("url"), ALL))
    return H.with_label(rows).groupBy("label").agg(F.count("*").alias("n"))


@query("u8_enabled_hosts", sql("fx_links") + f", h as (select {_HOST} as host from fx_links) select host, host in ('rapidgator.net', 'mega.nz', 'mega.co.nz') as enabled, host <> 'github.com' as known, count(*) as n from h group by 1, 2, 3")
def _(spark, d):
    u, keys = F.col("url"), H.enabled_hosts("mega, rapidgator, unknown")
    return frame(spark, d, "fx_links").groupBy(urls.host_only(u).alias("host"), urls.is_enabled(u, keys).alias("enabled"), urls.is_known_file_host(u).alias("known")).agg(F.count("*").alias("n"))


@query("u10_names_a_file", sql("fx_links") + " select not contains(url, 'swisstransfer.com/es') as named, count(*) as n from fx_links group by 1")
def _(spark, d):
    return frame(spark, d, "fx_links").groupBy(urls.names_a_file(F.col("url")).alias("named")).agg(F.count("*").alias("n"))


@query("u11_reduce", sql("fx_links") + _LINKS + " select file_key, min(canonical) as canonical, count(*) as n from ids group by 1")
def _(spark, d):
    return _links(spark, d).groupBy("file_key").agg(F.min("canonical").alias("canonical"), F.count("*").alias("n"))


@query("u17_download_key", sql("fx_links") + _LINKS + " select coalesce(file_key, lower(rtrim(url, '/'))) as key, count(*) as n from ids group by 1")
def _(spark, d):
    return _links(spark, d).groupBy(F.coalesce("file_key", urls.plain_key(F.col("url"))).alias("key")).agg(F.count("*").alias("n"))


@query("u18_downloads", sql("fx_links") + _LINKS + " select host, count_if(file_key is not null) as downloads, count_if(contains(url, '...')) as truncated from ids group by 1")
def _(spark, d):
    u = F.col("url")
    return _links(spark, d).groupBy(urls.host_only(u).alias("host")).agg(F.count("file_key").alias("downloads"), F.count_if(urls.truncated(u)).alias("truncated"))


@query("u20_action_links", sql("fx_items") + " select contains(url, '?vote=') as action, count(*) as n from fx_items group by 1")
def _(spark, d):
    return frame(spark, d, "fx_items").groupBy(urls.is_action(F.col("url")).alias("action")).agg(F.count("*").alias("n"))


@query("u21_board_topics", "select case when l_partkey % 4 = 3 then null else concat('https://b.example/t', cast(l_partkey as string), '-name') end as topic, count(*) as n from lineitem group by 1")
def _(spark, d):
    form = "concat('https://b.example/t', cast(l_partkey as string), case l_partkey % 4 when 0 then '-name' when 1 then 'p20-name' when 2 then '-name?highlight=x' else '-name?vote=1' end) as url"
    return spark.read.parquet(f"{d}/lineitem.parquet").selectExpr(form).groupBy(urls.board_topic(F.col("url")).alias("topic")).agg(F.count("*").alias("n"))


@query("u22_board_ids", "select case when l_partkey % 4 < 3 then 'topic' end as kind, case when l_partkey % 4 < 3 then l_partkey end as id, case when l_partkey % 4 < 3 then l_linenumber * 15 end as at, count(*) as n from lineitem group by 1, 2, 3")
def _(spark, d):
    form = "concat('https://s.example/index.php', case l_partkey % 4 when 0 then '?topic=' when 1 then '/topic,' when 2 then '?x=1&topic=' else '?action=watch;topic=' end, cast(l_partkey as string), '.', cast(l_linenumber * 15 as string), case l_partkey % 4 when 1 then '.html' else '' end) as url"
    r = urls.board_id(F.col("url"))
    return spark.read.parquet(f"{d}/lineitem.parquet").selectExpr(form).groupBy(r["kind"].alias("kind"), r["id"].alias("id"), r["at"].alias("at")).agg(F.count("*").alias("n"))


@query("u23_page_numbers", r"select page_id, coalesce(try_cast(regexp_extract(url, '[?&]page=(\d+)(&|#|$)', 1) as bigint), try_cast(regexp_extract(lower(regexp_extract(url, '^[^?#]*')), '/(page[-/]?|p)(\d+)(/|$)', 2) as bigint)) as page_no from pages")
def _(spark, d):
    return _pages(spark, d).select("page_id", urls.page_number(F.col("url")).alias("page_no"))


@query("u24_wrappers", sql("fx_items") + " select item_id % 3 as k, count_if(item_id % 3 < 2) as wrappers from fx_items group by 1")
def _(spark, d):
    u = F.expr("case item_id % 3 when 0 then concat('https://w.example/go/', cast(item_id as string)) when 1 then concat('https://w.example/x?target=', cast(item_id as string)) else 'https://mega.nz/redirect/x' end")
    return frame(spark, d, "fx_items").select((F.col("item_id") % 3).alias("k"), urls.is_wrapper(u, F.lit("")).alias("w")).groupBy("k").agg(F.count_if("w").alias("wrappers"))


@query("u25_short_links", "select l_orderkey, count(distinct case when l_partkey % 3 = 0 then concat('bit.ly/a', cast(l_partkey as string)) when l_partkey % 3 = 1 then concat('tinyurl.com/b', cast(l_suppkey as string)) end) as n from lineitem group by 1")
def _(spark, d):
    said = F.expr("concat('get ', case l_partkey % 3 when 0 then concat('https://bit.ly/a', cast(l_partkey as string)) when 1 then concat('http://TinyURL.com/b', cast(l_suppkey as string), '.') else concat('https://notbit.example/c', cast(l_partkey as string)) end)")
    text = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.array_join(F.collect_list(said), ", ").alias("text"))
    return text.select("l_orderkey", F.size(urls.short_links(F.col("text"))).cast("long").alias("n"))


@query("u26_echo_keys", "select concat('h.example/a b', cast(p_partkey % 40 as string)) as key, count(*) as n from part group by 1")
def _(spark, d):
    form = F.expr("concat(case p_partkey % 2 when 0 then 'https://WWW.h.example/' else 'http://h.example/' end, case p_partkey % 3 when 0 then 'a%2520b' when 1 then 'a%20b' else 'A b' end, cast(p_partkey % 40 as string), case p_partkey % 5 when 0 then '/' else '' end)")
    return spark.read.parquet(f"{d}/part.parquet").groupBy(urls.echo_key(form).alias("key")).agg(F.count("*").alias("n"))


@query("u28_same_site", f"with h as (select page_id, {_HOST} as host from pages) select a.page_id, a.host = b.host as same from h a join h b on b.page_id = (a.page_id * 7 + 1) % (select count(*) from pages)")
def _(spark, d):
    pages = _pages(spark, d)
    other = pages.select(F.col("page_id").alias("other_id"), F.col("url").alias("other"))
    met = pages.withColumn("other_id", (F.col("page_id") * 7 + 1) % pages.count()).join(other, "other_id")
    return met.select("page_id", urls.same_site(F.col("url"), F.col("other")).alias("same"))


@query("u29_extensions_of_links", sql("fx_links") + " select case part % 9 when 1 then 'html' when 6 then 'rar' when 7 then '' else '' end as ext, part % 9 = 6 as media, count(*) as n from fx_links group by 1, 2")
def _(spark, d):
    u = F.col("url")
    return frame(spark, d, "fx_links").groupBy(urls.extension(u).alias("ext"), urls.is_media(u).alias("media")).agg(F.count("*").alias("n"))


@query("u29_media_extensions", sql("fx_media") + " select lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) as ext, true as media, count(*) as n from fx_media group by 1, 2")
def _(spark, d):
    u = F.col("url")
    return frame(spark, d, "fx_media").groupBy(urls.extension(u).alias("ext"), urls.is_media(u).alias("media")).agg(F.count("*").alias("n"))


# --- dedupe and history -----------------------------------------------------------------------------------------------


@query("m2_item_downloads", sql("fx_links") + _KEPT + " select item_id, file_key, canonical, pos, contains(canonical, 'rapidgator') as premium from kept")
def _(spark, d):
    return _kept(spark, d).select("item_id", "file_key", "canonical", "pos", "premium")


@query("m3_global_first", sql("fx_links") + " select key, item_id, pos from (select lower(rtrim(url, '/')) as key, item_id, pos, row_number() over (partition by lower(rtrim(url, '/')) order by item_id, pos, part, supp) as n from fx_links) where n = 1")
def _(spark, d):
    return dedupe.global_first(frame(spark, d, "fx_links"), ["item_id", *_ORDER]).select("key", "item_id", "pos")


@query("j1_annotated", sql("fx_links", "fx_downloads") + _KEPT + " select item_id, kept.file_key, d.file_key is not null as seen_before, coalesce(state, '') as prior_state, first_sent as prior_sent from kept left join fx_downloads d on kept.file_key = d.file_key")
def _(spark, d):
    return history.annotate(_kept(spark, d), frame(spark, d, "fx_downloads")).select("item_id", "file_key", "seen_before", "prior_state", "prior_sent")


@query("j2_fresh_links", sql("fx_links", "fx_downloads") + _KEPT + " select host_of as host, count(*) as files, count(distinct item_id) as items from (select *, regexp_extract(canonical, '^https?://(www\\.)?([^/]*)', 2) as host_of from kept where file_key not in (select file_key from fx_downloads)) group by 1")
def _(spark, d):
    """Files offered by items that have not been sent yet, by host."""
    return history.fresh(_kept(spark, d), frame(spark, d, "fx_downloads")).groupBy("host").agg(F.count("*").alias("files"), F.count_distinct("item_id").alias("items"))


_RELEASES = ", rf as (select distinct concat('https://site.example/r', cast(item_id % 5000 as string)) as release, file_key from ids where file_key is not null)"


def _release_files(spark, d):
    return _links(spark, d).select(F.expr("concat('https://site.example/R', cast(item_id % 5000 as string), '/')").alias("release_url"), "file_key")


_DONE = sql("fx_links", "fx_downloads") + _LINKS + _RELEASES + ", done as (select release, count(*) as files from rf left join fx_downloads d on rf.file_key = d.file_key group by 1 having count(*) = count(d.file_key))"


@query("j3_done_releases", _DONE + " select * from done")
def _(spark, d):
    return history.done_releases(_release_files(spark, d), frame(spark, d, "fx_downloads"))


def _candidate_pages(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_custkey as page", "concat('https://site.example/R', cast(o_orderkey % 5000 as string)) as url")


@query("j4_skip_done", _DONE + ", c as (select o_custkey as page, concat('https://site.example/r', cast(o_orderkey % 5000 as string)) as release from orders) select page, count(*) as n from c where release not in (select release from done) group by 1")
def _(spark, d):
    done = history.done_releases(_release_files(spark, d), frame(spark, d, "fx_downloads"))
    return history.skip_done(_candidate_pages(spark, d), done).groupBy("page").agg(F.count("*").alias("n"))


@query("j5_caught_up", _DONE + ", c as (select o_custkey as page, concat('https://site.example/r', cast(o_orderkey % 5000 as string)) as release from orders), a as (select page, bool_and(release in (select release from done)) as all_done from c group by 1) select c_custkey as page, coalesce(all_done, false) and c_custkey % 10 <> 0 as caught_up from customer left join a on a.page = c_custkey")
def _(spark, d):
    pages = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("page"))
    done = history.done_releases(_release_files(spark, d), frame(spark, d, "fx_downloads"))
    return history.caught_up(pages, pages.where("page % 10 = 0"), _candidate_pages(spark, d), done)


@query("j6_new_vs_baseline", "select o_orderkey as release_id, o_custkey % 5 as store from orders where not (o_custkey % 5 < 3 and o_orderkey % 2 = 0)")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey as release_id", "o_custkey % 5 as store")
    return history.not_in_baseline(rows, rows.where("store < 3 and release_id % 2 = 0"), ["store", "release_id"]).select("release_id", "store")


_SNAP = ", snap as (select concat('rapidgator:', regexp_extract(url, '/file/([A-Za-z0-9]+)', 1)) as file_key, bool_or(availability = 'OFFLINE') as offline from fx_snapshot group by 1)"


@query("j7_reconcile", sql("fx_downloads", "fx_snapshot") + _SNAP + ", looked as (select * from fx_downloads order by last_seen desc, file_key limit 200) select d.file_key, case when l.file_key is null then d.state when coalesce(offline, false) then 'gone' when s.file_key is not null then 'in_jd' when d.state = 'in_jd' then 'gone' else d.state end as state from fx_downloads d left join looked l on d.file_key = l.file_key left join snap s on s.file_key = d.file_key")
def _(spark, d):
    return history.reconcile(frame(spark, d, "fx_downloads"), frame(spark, d, "fx_snapshot"), 200).select("file_key", "state")


@query("j8_snapshot_keys", sql("fx_snapshot") + _SNAP + " select * from snap")
def _(spark, d):
    return history.snapshot_keys(frame(spark, d, "fx_snapshot"))


@query("j9_package_links", sql("fx_snapshot", "fx_packages") + " select uuid, url from fx_snapshot where package_id in (select package_id from fx_packages where package in ('pack3', 'pack7', 'pack99'))")
def _(spark, d):
    names = spark.createDataFrame([("pack3",), ("pack7",), ("pack99",)], "package string")
    return history.remove_packages(frame(spark, d, "fx_snapshot"), frame(spark, d, "fx_packages"), names).select("uuid", "url")


@query("j10_forget_offline", sql("fx_downloads", "fx_snapshot") + _SNAP + " select file_key, state from fx_downloads where file_key not in (select file_key from snap where offline)")
def _(spark, d):
    return history.drop_offline(frame(spark, d, "fx_snapshot"), frame(spark, d, "fx_downloads"))[1].select("file_key", "state")


@query("j11_completeness", "with w as (select concat('pack', cast(p_partkey % 100 as string)) as package, p_partkey from part) select package, count_if(p_partkey % 100 < 60 or p_partkey % 3 = 0) as found, count(*) as wanted, bool_and(p_partkey % 100 < 60 or p_partkey % 3 = 0) or max(p_partkey % 100 * 11) >= 900 as complete from w group by 1")
def _(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    wanted = part.selectExpr("concat('pack', cast(p_partkey % 100 as string)) as package", "concat('https://h.example/a%20', cast(p_partkey as string)) as url", "p_partkey % 100 * 11 as waited")
    came = part.where("p_partkey % 100 < 60 or p_partkey % 3 = 0").selectExpr("concat('http://www.H.example/a ', cast(p_partkey as string), '/') as url")
    return history.completeness(wanted, came, "waited")


@query("j12_redirects", sql("fx_redirects") + ", e as (select src, min(dst) as dst from fx_redirects group by 1), one as (select src as url, case when dst <> src then dst else src end as t1, case when dst <> src then 1 else 0 end as v1 from e), two as (select url, t1, v1, e.dst from one left join e on e.src = t1 and not contains(t1, 'rapidgator')) select url, case when dst is not null and dst <> t1 and dst <> url then dst else t1 end as target, v1 + case when dst is not null and dst <> t1 and dst <> url then 1 else 0 end as via from two")
def _(spark, d):
    edges = frame(spark, d, "fx_redirects")
    return chains.resolve_redirects(edges.select(F.col("src").alias("url")), edges).select("url", "target", "via")


@query("j13_page_chain", sql("fx_next") + ", walk(start, page, n) as (select page, page, 0 from fx_next union all select w.start, f.next_page, w.n + 1 from walk w join fx_next f on f.page = w.page where f.next_page is not null and w.n < 499) select start, page, cast(min(n) as bigint) as n from walk group by 1, 2")
def _(spark, d):
    edges = frame(spark, d, "fx_next")
    return chains.page_chain(edges, edges.select("page"), 500).select("start", "page", "n")


@query("j14_items_without_links", sql("fx_links", "fx_items") + _LINKS + " select item_id from fx_items where item_id not in (select item_id from ids where file_key is not null)")
def _(spark, d):
    return history.without_files(frame(spark, d, "fx_items"), _links(spark, d)).select("item_id")


@query("j15_participated_topics", sql("fx_posts") + " select distinct topic_id from fx_posts where author = 7")
def _(spark, d):
    return history.participated(frame(spark, d, "fx_posts"), 7)


@query("j16_event_categories", "with ev as (select n_nationkey, n_name from nation join region on n_regionkey = r_regionkey where r_name in ('ASIA', 'EUROPE')), p as (select o_orderkey as id, a.n_nationkey as one, b.n_nationkey as two, concat('live at ', b.n_name, ' and ', a.n_name) as title from orders join nation a on a.n_nationkey = o_custkey % 25 join nation b on b.n_nationkey = o_orderkey % 25), m as (select id, n_name as event, row_number() over (partition by id order by strpos(lower(title), lower(n_name)), n_name) as n from p join ev on n_nationkey = one or n_nationkey = two) select id, event from m where n = 1")
def _(spark, d):
    nation, region = spark.read.parquet(f"{d}/nation.parquet"), spark.read.parquet(f"{d}/region.parquet")
    categories = nation.selectExpr("cast(n_nationkey as long) as id", "n_name as name", "cast(n_regionkey as long) + 1000 as parent").union(region.selectExpr("cast(r_regionkey as long) + 1000", "r_name", "cast(null as long)"))
    names = F.broadcast(nation.selectExpr("n_nationkey", "n_name"))
    posts = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey as id", "o_custkey % 25 as one", "o_orderkey % 25 as two")
    posts = posts.join(names.toDF("one", "a"), "one").join(names.toDF("two", "b"), "two").select("id", F.concat(F.lit("Live at "), "b", F.lit(" and "), "a").alias("title"), F.array(F.col("one").cast("long"), F.col("two").cast("long")).alias("category_ids"))
    return cms.event_category(posts, categories, "^(ASIA|EUROPE)$")


@query("j17_shared_files", sql("fx_media") + ", once as (select post, dir, url, min(ordinal) as ordinal from fx_media group by 1, 2, 3), w as (select *, count(*) over (partition by post, dir) as weight, min(ordinal) over (partition by post) as post_at from once), k as (select * from (select *, row_number() over (partition by url order by weight desc, post_at) as n from w) where n = 1) select url, post, row_number() over (partition by post order by ordinal, url) as track, count(*) over (partition by post) as total from k")
def _(spark, d):
    return cms.own_shared_files(frame(spark, d, "fx_media")).select("url", "post", "track", "total")


@query("j18_library_images", "select l_orderkey as post, string_agg(url, ' ' order by place, url) as images from (select l_orderkey, concat('i', cast(l_partkey % 20 as string)) as url, min(case when l_linenumber < 3 then 0 else 1 end) as place from lineitem group by 1, 2) group by 1")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey as post", "concat('i', cast(l_partkey % 20 as string)) as url", "l_linenumber < 3 as in_post")
    shown = rows.where("in_post").groupBy("post").agg(F.array_sort(F.collect_set("url")).alias("shown"))
    rest = rows.where("not in_post").groupBy("post").agg(F.array_sort(F.collect_set("url")).alias("attached"))
    return cms.add_library_images(shown, rest).select("post", F.array_join("images", " ").alias("images"))


@query("j19_enqueue_new", sql("fx_links") + " select url, count(*) as n from fx_links where part >= 100 and url not in (select url from fx_links where part < 100) group by 1")
def _(spark, d):
    rows = frame(spark, d, "fx_links")
    return history.not_in_baseline(rows.where("part >= 100"), rows.where("part < 100"), ["url"]).groupBy("url").agg(F.count("*").alias("n"))


@query("m1_record_sent", sql("fx_links", "fx_downloads") + _LINKS + ", b as (select file_key, min_by(url, sent) as url, min(sent) as first_sent, max(sent) as last_seen, max_by(package, case when package <> '' then sent end) as package from (select file_key, url, item_id * 10000000000 + pos * 1000000000 + part * 10000 + supp as sent, case when item_id % 3 = 0 then '' else concat('new', cast(item_id % 50 as string)) end as package from ids where file_key is not null) group by 1) select coalesce(d.file_key, b.file_key) as file_key, coalesce(d.url, b.url) as url, coalesce(d.state, 'sent') as state, coalesce(b.package, d.package) as package, coalesce(d.first_sent, b.first_sent) as first_sent, coalesce(b.last_seen, d.last_seen) as last_seen from fx_downloads d full outer join b on d.file_key = b.file_key")
def _(spark, d):
    batch = _links(spark, d).selectExpr("file_key", "url", "item_id * 10000000000 + pos * 1000000000 + part * 10000 + supp as sent", "case when item_id % 3 = 0 then '' else concat('new', cast(item_id % 50 as string)) end as package")
    return history.record_sent(frame(spark, d, "fx_downloads"), batch)


@query("m4_mark", sql("fx_downloads") + " select file_key, case when state = 'gone' then 'in_jd' else state end as state from fx_downloads")
def _(spark, d):
    h = frame(spark, d, "fx_downloads")
    return history.mark(h, h.where("state = 'gone'"), "in_jd").select("file_key", "state")


@query("m5_forget", sql("fx_downloads") + " select file_key from fx_downloads where package <> 'pack4'")
def _(spark, d):
    h = frame(spark, d, "fx_downloads")
    return history.forget(h, h.where("package = 'pack4'")).select("file_key")


@query("m6_remember_releases", sql("fx_links") + _LINKS + " select concat('r', cast(item_id % 3000 as string)) as release, string_agg(distinct file_key, ',' order by file_key) as keys from ids where file_key is not null group by 1")
def _(spark, d):
    rows = _links(spark, d).select(F.expr("concat('r', cast(item_id % 3000 as string))").alias("release_url"), "file_key")
    return history.remember_releases(rows).select("release", F.array_join("keys", ",").alias("keys"))


@query("m7_insert_or_ignore", "with n as (select * from (select o_custkey % 500 as release_id, o_orderkey as first_seen, row_number() over (partition by o_custkey % 500 order by o_orderkey) as n from orders) where n = 1) select release_id, case when release_id < 200 then -release_id else first_seen end as first_seen from n union select cast(c_custkey as bigint), -c_custkey from customer where c_custkey < 200 and c_custkey not in (select release_id from n)")
def _(spark, d):
    old = spark.read.parquet(f"{d}/customer.parquet").where("c_custkey < 200").selectExpr("c_custkey as release_id", "-c_custkey as first_seen")
    old = old.union(spark.range(1).selectExpr("id as release_id", "-id as first_seen")).distinct()
    new = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_custkey % 500 as release_id", "o_orderkey as first_seen")
    return history.insert_or_ignore(old, new, ["release_id"], ["first_seen"])


@query("m8_latest_cache", "select user_id, arg_max(event_type, event_id) as event_type, max(event_id) as event_id from events group by 1")
def _(spark, d):
    return history.latest(spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("m9_changed_pages", "with c as (select url, arg_min(html, page_id) as html from pages where page_id % 3 <> 0 group by 1) select page_id from pages p left join c on c.url = p.url where c.html is null or c.html <> p.html")
def _(spark, d):
    pages = _pages(spark, d)
    cache = pages.where("page_id % 3 <> 0").groupBy("url").agg(F.xxhash64(F.min_by("html", "page_id")).alias("hash"))
    return history.changed_pages(pages, cache).select("page_id")


@query("m10_retry_states", "select p_partkey, case p_partkey % 3 when 0 then 'done' when 1 then 'queued' else case when p_partkey % 8 >= 6 or p_partkey % 500 in (404, 410) then 'failed' else 'queued' end end as state from part")
def _(spark, d):
    outcome = F.expr("case p_partkey % 3 when 0 then 'ok' when 1 then 'stopped' else 'error' end")
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", history.retry_state(outcome, F.expr("p_partkey % 500"), F.expr("p_partkey % 8")).alias("state"))


# --- dates and windows ------------------------------------------------------------------------------------------------

_DATE = f"""case event_id % 9 when 0 then date '{AS_OF}' when 1 then date '{AS_OF}' - interval 1 day
 when 2 then try_cast(concat('2024-0', cast(event_id % 9 + 1 as string), '-', cast(event_id % 25 + 10 as string)) as date)
 when 3 then try_cast(concat('2023-04-', lpad(cast(event_id % 31 + 1 as string), 2, '0')) as date)
 when 4 then try_cast(concat('2022-02-', lpad(cast(event_id % 31 + 1 as string), 2, '0')) as date)
 when 5 then try_cast(concat(case when event_id % 90 + 10 < 70 then '20' else '19' end, cast(event_id % 90 + 10 as string), '-', lpad(cast(event_id % 12 + 1 as string), 2, '0'), '-', lpad(cast(event_id % 31 + 1 as string), 2, '0')) as date)
 {{more}} end"""


_AOUT = "when 6 then try_cast(concat('2021-08-', lpad(cast(event_id % 31 + 1 as string), 2, '0')) as date)"


@query("t1_parse_dates", sql("fx_texts") + f" select event_id, cast({_DATE.format(more=_AOUT)} as date) as day from fx_texts")
def _(spark, d):
    return frame(spark, d, "fx_texts").select("event_id", dates.parse_date(F.col("text"), F.lit(AS_OF).cast("date")).alias("day"))


_NEWEST = f"""case when event_id % 9 in (3, 4, 6, 8) then null when event_id % 9 = 7 then cast(concat('2020-11-0', cast(event_id % 9 + 1 as string)) as date) else {_DATE.format(more='')} end"""


@query("t3_newest_dates", sql("fx_texts") + f" select event_id, cast({_NEWEST} as date) as day from fx_texts")
def _(spark, d):
    return frame(spark, d, "fx_texts").select("event_id", dates.newest(F.col("text"), F.lit(AS_OF).cast("date")).alias("day"))


@query("t6_cutoffs", "select o_orderkey, case when o_custkey % 30 > 0 then cast(cast(o_orderdate as date) - to_months(cast(o_custkey % 30 as integer)) as date) end as since from orders")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet")
    return rows.select("o_orderkey", dates.cutoff(F.col("o_orderdate").cast("date"), (F.col("o_custkey") % 30).cast("int")).alias("since"))


@query("t7_in_window", sql("fx_texts") + f" select event_id from fx_texts where not coalesce(cast({_DATE.format(more=_AOUT)} as date) < date '2023-06-01', false)")
def _(spark, d):
    day = dates.parse_date(F.col("text"), F.lit(AS_OF).cast("date"))
    return frame(spark, d, "fx_texts").where(~dates.too_old(day, F.lit("2023-06-01").cast("date"))).select("event_id")


@query("t8_listing_window", "with p as (select o_custkey % 200 as board, o_orderkey as page_no, cast(o_orderdate as date) as newest from orders), s as (select board, min(page_no) as stop from p where newest < date '1993-01-01' group by 1) select p.board, page_no from p left join s on s.board = p.board where stop is null or page_no < stop")
def _(spark, d):
    pages = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_custkey % 200 as board", "o_orderkey as page_no", "cast(o_orderdate as date) as newest")
    return windows.listing_window(pages, "board", "page_no", "newest", F.lit("1993-01-01").cast("date")).select("board", "page_no")


_THREAD = sql("fx_posts") + ", pg as (select topic_id, offs, bool_or(day < date '2024-01-16') as has_old from fx_posts group by 1, 2)"


def _thread_pages(spark, d):
    return frame(spark, d, "fx_posts").groupBy("topic_id", "offs").agg(F.bool_or(F.col("day") < F.lit("2024-01-16").cast("date")).alias("has_old"))


@query("t9_thread_window", _THREAD + ", s as (select topic_id, max(offs) as stop from pg where has_old group by 1) select pg.topic_id, pg.offs from pg left join s on s.topic_id = pg.topic_id where stop is null or pg.offs >= stop")
def _(spark, d):
    return windows.thread_window(_thread_pages(spark, d), "topic_id", "offs", "has_old").select("topic_id", "offs")


@query("t9_thread_resume", _THREAD + ", m as (select topic_id, case when topic_id % 2 = 0 then 30 else 1000000 end as mark, max(offs) as newest from pg group by 1), s as (select pg.topic_id, max(offs) as stop from pg join m on m.topic_id = pg.topic_id where has_old or (offs <= mark and mark <= newest) group by 1) select pg.topic_id, pg.offs from pg left join s on s.topic_id = pg.topic_id where stop is null or pg.offs >= stop")
def _(spark, d):
    pages = _thread_pages(spark, d)
    marks = pages.select("topic_id").distinct().withColumn("mark", F.when(F.col("topic_id") % 2 == 0, 30).otherwise(1_000_000))
    return windows.thread_window(pages, "topic_id", "offs", "has_old", marks).select("topic_id", "offs")


@query("t10_high_water", sql("fx_posts") + " select topic_id, cast(max(offs) // 15 * 15 as bigint) as mark from fx_posts group by 1")
def _(spark, d):
    return windows.high_water(frame(spark, d, "fx_posts"), "topic_id", "offs").select("topic_id", F.col("mark").cast("long").alias("mark"))


@query("t11_posts_in_window", sql("fx_posts") + " select topic_id, offs, count_if(day >= date '2024-01-16') as kept, min(day) as oldest, max(day) as newest from fx_posts group by 1, 2")
def _(spark, d):
    since = F.lit("2024-01-16").cast("date")
    return windows.posts_in_window(frame(spark, d, "fx_posts"), ["topic_id", "offs"], "day", since)


@query("t12_cms_window", "with p as (select l_suppkey as blog, l_orderkey * 10 + l_linenumber as ordinal, case when l_linenumber = 4 then null else cast(l_shipdate as date) end as day, l_partkey from lineitem), s as (select blog, min(ordinal) as stop from p where day < date '1992-06-01' group by 1) select p.blog, ordinal, count(*) as n from p left join s on s.blog = p.blog where stop is null or ordinal < stop group by 1, 2")
def _(spark, d):
    posts = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_suppkey as blog", "l_orderkey * 10 + l_linenumber as ordinal", "case when l_linenumber = 4 then null else cast(l_shipdate as date) end as day")
    return windows.listing_window(posts.groupBy("blog", "ordinal").agg(F.min("day").alias("day"), F.count("*").alias("n")), "blog", "ordinal", "day", F.lit("1992-06-01").cast("date")).select("blog", "ordinal", "n")


# --- candidates and formats -------------------------------------------------------------------------------------------

_W, _E = "(^|[^a-z0-9])", "($|[^a-z0-9])"
_LL, _LY, _RQ = (f"regexp_matches(lower(name), '{_W}({w}){_E}')" for w in ("flac|wav", "mp3", "busco"))


@query("c1_looks_lossless", sql("fx_items") + f" select item_id, {_LL} and not {_LY} and not {_RQ} as lossless, {_RQ} or ({_LY} and not {_LL}) as lossy from fx_items")
def _(spark, d):
    return frame(spark, d, "fx_items").select("item_id", formats.looks_lossless(F.col("name")).alias("lossless"), formats.looks_lossy(F.col("name")).alias("lossy"))


_FOLLOW = "case when regexp_matches(url, '/threads/|/album') then 0 when contains(url, '/user') then null else 1 end"
_CAND = sql("fx_items") + ", r as (select base_id, item_id, split_part(url, '#', 1) as url, {tier} as tier from fx_items where not contains(url, '?vote=')), b as (select *, min(tier) over (partition by base_id) as best from r where tier is not null), f as (select *, row_number() over (partition by base_id, lower(url) order by item_id) as k from b where tier = best), l as (select *, row_number() over (partition by base_id order by item_id) as n from f where k = 1) select base_id, item_id, url from l where n <= 5"


@query("c3_candidates", _CAND.format(tier=_FOLLOW))
def _(spark, d):
    return C.candidates(frame(spark, d, "fx_items"), "site.example", 5).select("base_id", "item_id", "url")


@query("c4_lossless_candidates", _CAND.format(tier=f"case when {_LL} and not {_LY} and not {_RQ} then {_FOLLOW} when not ({_RQ} or ({_LY} and not {_LL})) then {_FOLLOW} + 2 end"))
def _(spark, d):
    return C.candidates(frame(spark, d, "fx_items"), "site.example", 5, lossless=True).select("base_id", "item_id", "url")


@query("c5_bot_floods", sql("fx_board") + " select page, topic from (select *, sum(case when replies = 0 then 1 else 0 end) over (partition by page, starter) as zeros from fx_board) where not (zeros >= 6 and coalesce(replies, -1) = 0)")
def _(spark, d):
    return windows.bot_floods(frame(spark, d, "fx_board")).select("page", "topic")


_VERDICT = """case when a + b > 0 then case when a >= b then 'lossless' else 'lossy' end when contains(said, 'flac') then 'lossless?' when contains(said, 'kbps') then 'lossy?' else 'unknown' end"""
_CHECKS = sql("fx_checks") + ", v as (select *, (case when p_partkey % 4 = 0 then 1 else 0 end) + (case when p_partkey % 3 = 1 then 1 else 0 end) as a, (case when p_partkey % 4 = 1 then 1 else 0 end) + (case when p_partkey % 3 = 0 then 1 else 0 end) as b from fx_checks)"


@query("c7_verdicts", _CHECKS + f" select p_partkey, {_VERDICT} as verdict from v")
def _(spark, d):
    return frame(spark, d, "fx_checks").select("p_partkey", formats.verdict(F.array("file_a", "file_b"), F.col("said")).alias("verdict"))


@query("c8_keep_for_lossless", _CHECKS + f" select url from v where not coalesce(not alive, false) and {_VERDICT} <> 'lossy'")
def _(spark, d):
    rows = frame(spark, d, "fx_checks")
    return rows.where(formats.keep(F.col("alive"), formats.verdict(F.array("file_a", "file_b"), F.col("said")))).select("url")


# --- pages ------------------------------------------------------------------------------------------------------------

_MARKED = "(select page_id, concat(html, case page_id % 6 when 0 then '<a href=\"/viewtopic.php?t=1\"><div class=\"postbody\">' when 1 then 'Powered by SMF index.php?topic=12.0' when 2 then '<link href=\"/wp-content/x\"><script src=\"/wp-includes/y\">' when 3 then 'Just a moment...' when 4 then 'challenge-platform' else '' end) as html from pages) p"


def _marked(spark, d):
    pages = by_page(_pages(spark, d))  # a file of one row group is read by one task
    return pages.selectExpr("page_id", "url", "concat(html, case page_id % 6 when 0 then '<a href=\"/viewtopic.php?t=1\"><div class=\"postbody\">' when 1 then 'Powered by SMF index.php?topic=12.0' when 2 then '<link href=\"/wp-content/x\"><script src=\"/wp-includes/y\">' when 3 then 'Just a moment...' when 4 then 'challenge-platform' else '' end) as html")


@query("d1_software", f"select page_id, case page_id % 6 when 0 then 'phpBB' else 'SMF' end as software, cast(0.85 as double) as confidence, case page_id % 6 when 0 then 'phpBB asset; phpBB class' else 'SMF footer; SMF URL' end as evidence from {_MARKED} where page_id % 6 in (0, 1)")
def _(spark, d):
    return detect.software(_marked(spark, d))


@query("d2_best_software", f"select page_id, case page_id % 6 when 0 then 'phpBB' else 'SMF' end as software, cast(0.85 as double) as confidence from {_MARKED} where page_id % 6 in (0, 1)")
def _(spark, d):
    return detect.best(detect.software(_marked(spark, d))).select("page_id", "software", "confidence")


@query("d3_page_flags", f"select page_id, contains(left(html, 200000), '/wp-content/') and contains(left(html, 200000), '/wp-includes/') as cms, contains(lower(html), 'just a moment...') or (contains(html, 'challenge-platform') and length(html) < 30000) as challenge from {_MARKED}")
def _(spark, d):
    # this query's SQL asks for the beginning of a page
    return _marked(spark, d).select("page_id", detect.is_cms(F.left("html", F.lit(200_000))).alias("cms"), detect.is_challenge(F.col("html")).alias("challenge"))


@query("d4_readers", f"select case page_id % 6 when 1 then 'forum' when 2 then 'cms' else 'web' end as reader, count(*) as n from {_MARKED} group by 1")
def _(spark, d):
    pages = _marked(spark, d)
    known = pages.join(detect.best(detect.software(pages)).select("page_id", "software").hint("merge"), "page_id", "left")
    return known.groupBy(detect.reader(F.col("url"), F.col("html"), F.col("software")).alias("reader")).agg(F.count("*").alias("n"))


# --- counts -----------------------------------------------------------------------------------------------------------


@query("a1_links_per_bucket", sql("fx_links") + " select item_id, count_if(part % 9 in (0, 1, 2, 3, 4, 6, 7)) as build, count_if(part % 9 = 8) as source, count_if(part % 9 = 5) as other from fx_links group by 1")
def _(spark, d):
    return counts.per_bucket(frame(spark, d, "fx_links")).select("item_id", "build", "source", "other")


@query("a2_links_per_host", sql("fx_links") + _LINKS + " select host, count(*) as links, count_if(file_key is not null) as downloads from ids group by 1 order by links desc, host limit 15")
def _(spark, d):
    return counts.per_host(_links(spark, d), 15)


@query("a3_history_states", sql("fx_downloads") + " select state, count(*) as n from fx_downloads group by 1")
def _(spark, d):
    return counts.per(frame(spark, d, "fx_downloads"), "state")


@query("a4_queue_states", sql("fx_queue") + " select to_state, count(*) as n from fx_queue group by 1")
def _(spark, d):
    return counts.per(frame(spark, d, "fx_queue"), "to_state")


@query("a5_crawl_records", sql("fx_links", "fx_downloads") + _KEPT + " select item_id % 100 as crawl, count(distinct item_id % 700) as pages, count(distinct item_id) as items, count(*) as total, count_if(d.file_key is null) as fresh, count_if(d.file_key is not null) as already_sent from kept left join fx_downloads d on d.file_key = kept.file_key group by 1")
def _(spark, d):
    seen = history.annotate(_kept(spark, d), frame(spark, d, "fx_downloads")).withColumns({"crawl": F.col("item_id") % 100, "page_id": F.col("item_id") % 700})
    return counts.crawl_records(seen)


@query("a6_job_rollup", sql("fx_links") + " select supp % 10 as job, case when grouping(part % 9) = 0 then part % 9 end as form, count(*) as links, count(distinct item_id) as items from fx_links group by rollup (supp % 10, part % 9)")
def _(spark, d):
    rows = frame(spark, d, "fx_links").selectExpr("supp % 10 as job", "part % 9 as form", "item_id")
    return rows.rollup("job", "form").agg(F.count("*").alias("links"), F.count_distinct("item_id").alias("items"))


_CRAWLS = "select o_custkey % 50 as job, concat('u', cast(o_orderkey % 97 as string)) as url, o_orderkey % 7 as pages, o_orderkey % 5 as links, o_orderkey % 3 as fresh, o_orderkey % 2 as already_sent, o_orderkey % 1100 = 0 as caught_up, case when o_orderkey % 13 = 0 then 'no answer' when o_orderkey % 17 = 0 then '' end as error from orders"


@query("a6_job_view", f"with c as ({_CRAWLS}) select job, cast(sum(pages) as bigint) as pages, cast(sum(links) as bigint) as links, cast(sum(fresh) as bigint) as fresh, cast(sum(already_sent) as bigint) as already_sent, bool_or(caught_up) as caught_up, coalesce(string_agg(case when error <> '' then concat(url, ': ', error) end, chr(10) order by concat(url, ': ', error)), '') as errors from c group by 1")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet")
    return counts.job_rollup(rows.selectExpr(*_expressions(_CRAWLS)))


@query("a7_trace_stages", sql("fx_trace") + " select stage, count(*) as n from fx_trace group by 1")
def _(spark, d):
    return counts.per(frame(spark, d, "fx_trace"), "stage")


@query("a8_files_per_release", sql("fx_media") + " select post, count(distinct url) as files from fx_media group by 1")
def _(spark, d):
    return counts.files_per(frame(spark, d, "fx_media"), "post")


@query("a9_distinct_files", sql("fx_links") + _LINKS + " select count(distinct file_key) as files, count(distinct host) as hosts from ids")
def _(spark, d):
    return counts.distinct_files(_links(spark, d))


@query("c9_checkable_hosts", sql("fx_links") + _LINKS + " select host, host in ('rapidgator.net', 'mega.nz', 'mega.co.nz', 'mediafire.com', 'swisstransfer.com') as checkable, count(*) as n from ids group by 1, 2")
def _(spark, d):
    u = F.col("url")
    return frame(spark, d, "fx_links").groupBy(urls.host_only(u).alias("host"), formats.checkable(u).alias("checkable")).agg(F.count("*").alias("n"))


# --- sorts and limits -------------------------------------------------------------------------------------------------


@query("l1_recent_history", sql("fx_downloads") + " select file_key, last_seen from fx_downloads order by last_seen desc, file_key limit 25")
def _(spark, d):
    return frame(spark, d, "fx_downloads").select("file_key", "last_seen").transform(history.newest_first, "last_seen", ["file_key"], 25)


@query("l2_recent_failures", sql("fx_queue") + " select seq, queue_id from fx_queue where to_state = 'failed' order by seq desc limit 20")
def _(spark, d):
    return history.newest_first(frame(spark, d, "fx_queue"), "seq", [], 20, "to_state = 'failed'").select("seq", "queue_id")


@query("l3_pending_first", "select p_partkey, case when p_partkey % 10 = 0 then 'pending' else 'done' end as state from part order by case when p_partkey % 10 = 0 then 0 else 1 end, p_partkey limit 150")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey", "case when p_partkey % 10 = 0 then 'pending' else 'done' end as state")
    return history.pending_first(rows, "p_partkey", 150)


@query("l4_trace_tail", sql("fx_trace") + " select n, stage from fx_trace where stage = 'click' and n > 100 order by n desc limit 30")
def _(spark, d):
    return history.tail(frame(spark, d, "fx_trace").select("n", "stage"), "n", 30, "stage = 'click' and n > 100")


@query("l6_watch_list", "select c_nationkey as store, c_name as name from customer order by 1, 2")
def _(spark, d):
    return history.watch_list(spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_nationkey as store", "c_name as name"))


@query("l5_item_limit", sql("fx_items") + " select base_id, item_id from (select *, row_number() over (partition by base_id order by item_id) as n from fx_items) where n <= 3")
def _(spark, d):
    return dedupe.item_limit(frame(spark, d, "fx_items"), ["base_id"], ["item_id"], 3).select("base_id", "item_id")


# --- names ------------------------------------------------------------------------------------------------------------

_TEXT = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(name, '“', chr(34)), '”', chr(34)), '\s*[–—‒]\s*', ' - ', 'g'), '\s+/\s+', ' & ', 'g'), '(\S)/(\S)', '\1-\2', 'g'), '\s+', ' ', 'g'))"


@query("n1_clean_text", sql("fx_names") + f" select p_partkey, {_TEXT} as name from fx_names")
def _(spark, d):
    return frame(spark, d, "fx_names").select("p_partkey", naming.clean_text(F.col("name")).alias("name"))


@query("n2_safe_components", sql("fx_names") + f""", t as (select p_partkey, regexp_replace(trim(regexp_replace(regexp_replace(replace(replace({_TEXT}, ':', ' -'), '"', ''''), '[<>"/\\\\|?*]', '', 'g'), '\\s+', ' ', 'g')), '[. ]+$', '') as n from fx_names) select p_partkey, case when n = '' then 'untitled' else n end as name from t""")
def _(spark, d):
    return frame(spark, d, "fx_names").select("p_partkey", naming.safe_component(F.col("name")).alias("name"))


@query("n3_job_safe", sql("fx_names") + r""" select p_partkey, regexp_replace(trim(regexp_replace(name, '[<>:"/\\|?*]+', '_', 'g')), '[. ]+$', '') as name from fx_names""")
def _(spark, d):
    return frame(spark, d, "fx_names").select("p_partkey", naming.job_safe(F.col("name")).alias("name"))


@query("n4_url_words", sql("fx_media") + r" select url, concat('Tape ', regexp_extract(url, 'Tape_(\d+)', 1), ' Side A') as words from fx_media group by 1, 2")
def _(spark, d):
    return frame(spark, d, "fx_media").select("url").distinct().select("url", F.array_join(naming.url_words(F.col("url")), " ").alias("words"))


@query("n6_tapes", sql("fx_names") + " select p_partkey, case when p_partkey % 5 = 4 then '3' else '' end as tape, case when p_partkey % 5 = 4 then 'B' else '' end as side, case when p_partkey % 4 = 2 then '1994' else '' end as year from fx_names")
def _(spark, d):
    n = F.col("name")
    return frame(spark, d, "fx_names").select("p_partkey", naming.tape_of(n).alias("tape"), naming.side_of(n).alias("side"), naming.labelled_year(n).alias("year"))


@query("n9_file_names", "select p_partkey, concat(lpad(cast(p_partkey % 150 as string), 3, '0'), ' - ', p_name, '.flac') as name from part")
def _(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", naming.file_name(F.expr("p_partkey % 150"), F.lit(150), F.col("p_name"), F.lit("FLAC")).alias("name"))


@query("n11_release_titles", "select p_partkey, concat(case p_partkey % 3 when 0 then 'Unknown' when 1 then p_brand else concat(p_brand, ', ', p_type) end, ' - ', p_name) as title from part")
def _(spark, d):
    artists = F.expr("case p_partkey % 3 when 0 then cast(array() as array<string>) when 1 then array(p_brand) else array(p_brand, p_type) end")
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", naming.release_title(artists, F.col("p_name")).alias("title"))


@query("n12_cover_names", "select p_partkey, case p_partkey % 4 when 0 then 'cover.jpg' else concat('artwork ', cast(p_partkey % 4 as string), ' - Img%20', cast(p_partkey as string), '.JPEG') end as name from part")
def _(spark, d):
    u = F.expr("concat('https://c.example/Img%20', cast(p_partkey as string), '.JPEG')")
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", naming.cover_name(F.expr("p_partkey % 4"), u).alias("name"))


@query("n13_display_names", "select p_partkey, case when p_partkey % 3 = 0 then 'https://c.example/' else concat('my file ', cast(p_partkey as string)) end as name from part")
def _(spark, d):
    u = F.expr("case when p_partkey % 3 = 0 then 'https://c.example/' else concat('https://c.example/x/my%20file%20', cast(p_partkey as string), '/?q=1') end")
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", naming.name_from_url(u).alias("name"))


# --- hand-off ---------------------------------------------------------------------------------------------------------


_SENT = "item_id * 10000000000 + pos * 1000000000 + part * 10000 + supp"
_JOBS = sql("fx_links") + _LINKS + f", one as (select concat('p', cast(item_id % 1000 as string)) as package, file_key, min_by(canonical, {_SENT}) as canonical, min({_SENT}) as o from ids where file_key is not null group by 1, 2)"
_JOB = "'TRUE' as enabled, package as packageName, concat('/media/', package) as downloadFolder, 'TRUE' as autoStart, 'TRUE' as autoConfirm"


def _packaged(spark, d):
    return frame(spark, d, "fx_links").withColumn("package", F.expr("concat('p', cast(item_id % 1000 as string))")).withColumn("at", F.expr(_SENT))


@query("k1_packages", _JOBS + f" select package, text, {_JOB}, files from (select package, string_agg(canonical, chr(10) order by o, file_key) as text, count(*) as files from one group by 1)")
def _(spark, d):
    return handoff.packages(_packaged(spark, d), "at", "/media/").withColumn("files", F.col("files").cast("long"))


@query("k2_named_entries", _JOBS + f" select package, canonical as text, {_JOB}, case when contains(canonical, 'rapidgator') then concat('file ', regexp_extract(canonical, '/file/f([0-9]+)', 1)) end as filename from one")
def _(spark, d):
    rows = _packaged(spark, d)
    names = dedupe.identified(rows).where("file_key like 'rapidgator:%'").select(F.col("canonical").alias("url"), F.concat(F.lit("file "), F.regexp_extract("canonical", "/file/f([0-9]+)", 1)).alias("filename")).distinct()
    return handoff.named_entries(rows, names, "at", "/media").drop("at")


@query("k3_rejected_links", sql("fx_links") + _LINKS + " select concat('p', cast(item_id % 1000 as string)) as package, count(*) as rejected from ids where file_key is null group by 1")
def _(spark, d):
    rows = frame(spark, d, "fx_links").withColumn("package", F.expr("concat('p', cast(item_id % 1000 as string))"))
    return handoff.rejected(rows).groupBy("package").agg(F.count("*").alias("rejected"))


@query("k4_target_paths", "select p_partkey, concat(p_brand, '/', 'b - ', p_type, '/', p_name) as path from part")
def _(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", naming.target_path(F.expr("concat(p_brand, '/./../b: ', p_type, '//')"), F.col("p_name")).alias("path"))


from . import catalog_pages  # noqa: E402, F401
