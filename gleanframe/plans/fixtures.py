"""Links, items, posts, boards and history derived from the star-schema tables by expressions that any SQL engine reads
alike: each view is a table and a list of expressions, for Spark's selectExpr and for plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ID = "cast(l_partkey % 700 as string)"
_URL = f"""case l_partkey % 9
 when 0 then concat('https://rapidgator.net/file/f', {_ID})
 when 1 then concat('http://www.rapidgator.net/file/f', {_ID}, '/name_', {_ID}, '.html')
 when 2 then concat('https://mega.nz/folder/f', {_ID}, '#key', cast(l_suppkey % 3 as string))
 when 3 then concat('https://mega.co.nz/#F!f', {_ID}, '!key', cast(l_suppkey % 3 as string))
 when 4 then concat('https://drive.google.com/open?id=gdrive_file_', {_ID})
 when 5 then 'https://www.swisstransfer.com/es'
 when 6 then concat('https://rapidgator.net/file/f', {_ID}, '...part1.rar')
 when 7 then concat('https://www.mediafire.com/file/F', {_ID}, '/Name.rar/')
 else concat('https://github.com/user/repo', {_ID}) end"""
_FORMAT = "case o_orderkey % 5 when 0 then '[FLAC] ' when 1 then '[MP3] ' when 2 then 'busco flac ' when 3 then 'wav and mp3 ' else '' end"

#: name -> (table, expressions, filter).
VIEWS: dict[str, tuple[str, list[str], str | None]] = {
    "fx_links": ("lineitem", ["l_orderkey as item_id", "cast(l_linenumber as bigint) as pos", "l_partkey as part", "l_suppkey as supp", f"{_URL} as url"], None),
    "fx_items": ("orders", ["o_orderkey as item_id", "o_custkey as base_id", f"concat({_FORMAT}, 'release ', cast(o_custkey as string)) as name", "concat('https://site.example/', case o_orderkey % 4 when 0 then 'threads/' when 1 then 'album-' when 2 then 'user/' else 'misc-' end, cast(o_orderkey % 2000 as string), case o_orderkey % 6 when 0 then '?vote=1' when 1 then '#top' else '' end) as url", "cast(o_orderdate as date) as published"], None),
    "fx_downloads": ("part", ["concat('rapidgator:f', cast(p_partkey as string)) as file_key", "concat('https://rapidgator.net/file/f', cast(p_partkey as string)) as url", "case p_partkey % 3 when 0 then 'sent' when 1 then 'in_jd' else 'gone' end as state", "concat('pack', cast(p_partkey % 20 as string)) as package", "p_partkey * 13 % 1000 as first_sent", "p_partkey * 7 % 1000 + 1000 as last_seen"], "p_partkey < 700 and p_partkey % 2 = 0"),
    "fx_snapshot": ("part", ["p_partkey as uuid", "case when p_partkey % 2 = 0 then concat('https://rapidgator.net/file/f', cast(p_partkey % 700 as string), '/x.html') else concat('http://rapidgator.net/file/f', cast(p_partkey % 700 as string)) end as url", "case when p_partkey % 7 = 0 then 'OFFLINE' else 'ONLINE' end as availability", "p_partkey % 25 as package_id", "p_name as name"], "p_partkey % 3 = 0"),
    "fx_packages": ("part", ["p_partkey as package_id", "concat('pack', cast(p_partkey as string)) as package"], None),
    "fx_posts": ("events", ["user_id as topic_id", "event_id", "15 * cast(floor((row_number() over (partition by user_id order by ts, event_id) - 1) / 15) as bigint) as offs", "cast(ts as date) as day", "event_type", "event_id % 50 as author"], None),
    "fx_texts": ("events", ["event_id", "case event_id % 9 when 0 then 'Hoy a las 12:00' when 1 then 'yesterday, 10:11' when 2 then concat('posted 2024-0', cast(event_id % 9 + 1 as string), '-', cast(event_id % 25 + 10 as string), 'T10:00') when 3 then concat(cast(event_id % 31 + 1 as string), ' de abril de 2023') when 4 then concat('Feb ', cast(event_id % 31 + 1 as string), ', 2022') when 5 then concat(cast(event_id % 31 + 1 as string), '/', cast(event_id % 12 + 1 as string), '/', cast(event_id % 90 + 10 as string), ', 20:35') when 6 then concat('août ', cast(event_id % 31 + 1 as string), ' 2021') when 7 then concat('2019-02-30 or 0', cast(event_id % 9 + 1 as string), '.11.2020') else 'no date' end as text"], None),
    "fx_board": ("orders", ["o_custkey % 100 as page", "o_orderkey as topic", "o_custkey % 7 as starter", "case when o_orderkey % 3 = 0 then o_orderkey % 9 when o_orderkey % 11 = 0 then null else 0 end as replies"], None),
    "fx_checks": ("part", ["p_partkey", "concat('https://rapidgator.net/file/f', cast(p_partkey as string)) as url", "case p_partkey % 5 when 0 then true when 1 then false else null end as alive", "concat(p_name, case p_partkey % 4 when 0 then '.flac' when 1 then '.mp3' when 2 then '.rar' else '' end) as file_a", "concat(p_name, case p_partkey % 3 when 0 then '.MP3' when 1 then '.wav' else '.txt' end) as file_b", "case p_partkey % 6 when 0 then 'a flac rip' when 1 then '320 kbps' else 'text' end as said"], None),
    "fx_redirects": ("part", ["concat('https://short.example/', cast(p_partkey as string)) as src", "case p_partkey % 4 when 0 then concat('https://rapidgator.net/file/f', cast(p_partkey % 700 as string)) when 1 then concat('https://short.example/', cast(p_partkey - 1 as string)) when 2 then concat('https://short.example/', cast(p_partkey - 1 as string)) else concat('https://short.example/', cast(p_partkey as string)) end as dst"], None),
    "fx_next": ("part", ["p_partkey as page", "case when p_partkey % 100 = 99 then p_partkey - 40 when p_partkey % 37 = 0 then null else p_partkey + 1 end as next_page"], None),
    "fx_media": ("lineitem", ["l_orderkey % 3000 as post", "l_linenumber as pos", "l_orderkey * 10 + l_linenumber as ordinal", "concat('dir', cast(l_suppkey % 40 as string)) as dir", "concat('https://cms.example/music/dir', cast(l_suppkey % 40 as string), '/Tape_', cast(l_partkey % 900 as string), '_(Side_A).MP3') as url"], None),
    "fx_queue": ("events", ["user_id as queue_id", "event_id as seq", "case event_id * 7 % 11 when 0 then 'queued' when 1 then 'claimed' when 2 then 'queued' when 3 then 'downloading' when 4 then 'verified' when 5 then 'failed' when 6 then 'cancelled' when 7 then 'quarantined' when 8 then 'claimed' when 9 then 'skipped_owned' else case when event_id % 13 = 0 then 'filed' else 'queued' end end as to_state"], None),
    "fx_trace": ("events", ["event_id as n", "ts", "event_type as stage", "user_id % 9 as msg"], None),
    "fx_cms": ("nation", ["n_nationkey as id", "n_name as name", "n_regionkey as parent"], None),
    "fx_names": ("part", ["p_partkey", "concat(case p_partkey % 5 when 0 then ' “' when 1 then 'A / B ' when 2 then '1/2: ' when 3 then 'x <y> ' else 'Tape 3 Side b ' end, p_name, case p_partkey % 4 when 0 then ' – Live ...' when 1 then '?. ' when 2 then ' YEAR: 1994' else '' end) as name"], None),
}


def frame(spark: SparkSession, sf_dir: str, name: str, by: str | None = None) -> DataFrame:
    """A view; by: a column of its table by which rows are dealt over tasks before they become the view's, since a file of
    one row group is one task's otherwise."""
    table, expressions, where = VIEWS[name]
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    df = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), by) if by else df
    return (df.where(where) if where else df).selectExpr(*expressions)


def sql(*names: str) -> str:
    """The views as common table expressions."""
    parts = []
    for name in names:
        table, expressions, where = VIEWS[name]
        parts.append(f"{name} as (select {', '.join(expressions)} from {table}" + (f" where {where}" if where else "") + ")")
    return "with recursive " + ",\n".join(parts)
