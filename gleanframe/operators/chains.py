"""Redirects and pages that follow each other: joins that double their reach, not a step for each link of a chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..plans.cuts import cut


def resolve_redirects(links: DataFrame, redirects: DataFrame, hops: int = 2) -> DataFrame:
    """links (url) with target and via (hops taken); followed until a file host, at most so many hops, never in a circle."""
    out = links.withColumn("target", F.col("url")).withColumn("via", F.lit(0)).withColumn("_seen", F.array("url"))
    edges = redirects.groupBy(F.col("src").alias("target")).agg(F.min("dst").alias("_dst"))
    for _ in range(hops):
        out = out.join(edges, "target", "left")
        go = F.col("_dst").isNotNull() & ~urls.is_known_file_host(F.col("target")) & ~F.array_contains("_seen", F.col("_dst"))
        out = out.withColumns({"via": F.col("via") + F.coalesce(go, F.lit(False)).cast("int"), "target": F.when(go, F.col("_dst")).otherwise(F.col("target"))}).withColumn("_seen", F.array_append("_seen", F.col("target"))).drop("_dst")
    return out.drop("_seen")


def page_chain(edges: DataFrame, starts: DataFrame, most: int = 500) -> DataFrame:
    """start, n, page: the walk from each start along (page, next_page), without coming back, at most so many pages.

    Jumps of 1, 2, 4, ... edges reach any page in as many joins as the cap has bits. Every round is cut, so that its plan
    has two joins whatever the cap; a page that a walk meets again keeps its first place.
    """
    jump = cut(edges.where("next_page is not null").groupBy("page").agg(F.min("next_page").alias("to")), "jump")
    out, reach = cut(starts.select(F.col("page").alias("start"), F.lit(0).cast("long").alias("n"), "page").distinct(), "walk"), 1
    while reach < most:
        further = out.where(F.col("n") + reach < most).join(jump, "page").select("start", (F.col("n") + reach).alias("n"), F.col("to").alias("page"))
        out = cut(out.unionByName(further).groupBy("start", "page").agg(F.min("n").alias("n")), "walk")
        reach *= 2
        if reach < most:
            jump = cut(jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.page")).select(F.col("a.page").alias("page"), F.col("b.to").alias("to")), "jump")
    return out.select("start", "page", "n")
