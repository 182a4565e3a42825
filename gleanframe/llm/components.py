"""Connected components of a link table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut


def _star(links: DataFrame, large: bool, few: bool = False) -> DataFrame:
    """Link every node's larger (or smaller) neighbours with the smallest node around. few: whether Spark may choose the
    join by the size of the links' files, which is many times smaller than the links."""
    chosen = lambda df: df if few else df.hint("merge")
    if large:
        both = links.union(links.select("b", "a")).toDF("u", "v")
        lowest = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        out = both.where("v > u").join(chosen(lowest), "u").select(F.col("low").alias("a"), F.col("v").alias("b"))
    else:
        lowest = links.groupBy("b").agg(F.min("a").alias("low"))
        near = links.join(chosen(lowest), "b")
        out = near.where("a > low").select(F.col("low").alias("a"), F.col("a").alias("b")).union(lowest.select("low", "b"))
    return out.where("a < b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links: (a, b), a < b -> (node, component): the smallest node reachable, for every node that has a link.

    Each step groups by node with partial aggregation and joins on it; no group is gathered, so a hub of any size does.
    """
    links, before = cut(links.select("a", "b").distinct(), "links"), None
    for _ in range(most_rounds):
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        few = now[0] * 2 <= BROADCAST_ROWS
        before, links = now, cut(_star(_star(links, True, few), False, few), "links")
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).union(links.select("a", "a").distinct())
