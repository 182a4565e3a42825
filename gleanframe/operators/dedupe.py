"""First wins: links by file identity, within an item or over all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import hosts as H
from ..functions import urls as U


def identified(links: DataFrame, keys: tuple[str, ...] = H.enabled_hosts("all"), custom: dict | None = None) -> DataFrame:
    """links with file_key and canonical; null where the url names no file.

    Every step of the reduction is a projection of its own. The url's parts and the result go through generators of one
    row, so that neither later steps nor filters on file_key compute them again, and so that generated methods stay
    small enough for the compiler.
    """
    links = links.drop("file_key", "canonical")
    rows, made = links.withColumn("_u_url", F.col("url")), {"url": "_u_url"}
    for step in U.reduce_steps(tuple(k for k in keys if k not in (custom or {}))):
        c = {name: F.col(held) for name, held in made.items()}
        new = {f"_u_{name}": f(c) for name, f in step.items()}
        kept = [F.col(f"`{n}`") for n in rows.columns if n not in new]
        rows = rows.select(*kept, F.inline(F.array(F.struct(*[v.alias(k) for k, v in new.items()])))) if "host" in step else rows.withColumns(new)
        made |= {name: f"_u_{name}" for name in step}
    found = U.with_custom(F.col("url"), F.col("_u_identity"), F.col("_u_canonical"), keys, custom)
    return rows.select(*[F.col(f"`{n}`") for n in links.columns], F.inline(F.array(found)).alias("file_key", "canonical"))


def stepwise(rows: DataFrame, steps: tuple, name: str, **given: str) -> DataFrame:
    """rows with `name`, the last of steps, each of which has names and functions of the columns so far. A step is a
    projection of its own and the last one a generator of one row: neither later steps nor filters compute one again."""
    kept, made = [F.col(f"`{n}`") for n in rows.columns if n != name], dict(given)
    for step in steps:
        c = {k: F.col(f"`{held}`") for k, held in made.items()}
        rows = rows.withColumns({f"_s_{k}": f(c) for k, f in step.items()})
        made |= {k: f"_s_{k}" for k in step}
    return rows.select(*kept, F.inline(F.array(F.struct(F.col(f"_s_{next(iter(steps[-1]))}").alias(name)))))


def normalised(rows: DataFrame, name: str) -> DataFrame:
    """rows with the urls in a column normalised."""
    return stepwise(rows, tuple({"url": lambda c, f=f: f(c["url"])} for f in U.NORMAL), name, url=name)


def first_of(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group, by an order without ties."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def item_downloads(links: DataFrame, order: list, keys: tuple[str, ...] = H.enabled_hosts("all")) -> DataFrame:
    """Of each item the links that name a file, each file once: item_id, file_key, canonical, host, premium, and the rest."""
    known = identified(links, keys).where("file_key is not null")
    host = U.host_only(F.col("canonical"))
    return first_of(known, ["item_id", "file_key"], order).withColumn("host", host).withColumn("premium", U.premium(host))


def global_first(links: DataFrame, order: list) -> DataFrame:
    """Each url once over all items, whatever its case and closing slashes."""
    return first_of(links.withColumn("key", U.plain_key(F.col("url"))), ["key"], order)


def item_limit(df: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= most).drop("_n")
