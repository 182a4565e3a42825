"""Secrets in whole texts, told from copied examples by who owns them; DataFrame functions only.

Fixed patterns find candidates; their hashes are counted over the whole corpus by distinct repositories and owners. A
value that several owners hold is a copied example; one that a single owner has looks live, in however many of its
repositories it stands, and the number of these says how widely it is spread. Long mixed strings outside the patterns
become spans of their own if they look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Patterns in the order in which spans that start together are listed, and the least length of the value.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]+"
#: The method's own kind: strings of this length and more that mix letters and digits.
MIXED = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
KINDS, LEAST = ("assign", "access", "hex", "mixed"), (6, 20, 24, 20)
#: A value that more owners than this hold is a copied example.
OWNERS = 1


def _matches(text: Column, kind: int) -> Column:
    # shorter runs of hex digits can't be part of a longer one, so that they may be passed over
    pattern = (ASSIGN, ACCESS, r"(?<![0-9a-f])[0-9a-f]{24,}+", MIXED)[kind]
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _gaps(text: Column, kind: int) -> Column:
    pattern = (ASSIGN, ACCESS, r"(?<![0-9a-f])[0-9a-f]{24,}+", MIXED)[kind]
    return F.transform(F.split(text, pattern, -1), F.length)


def _scanned(docs: DataFrame, repo: Column, owner: Column) -> DataFrame:
    """row, doc_id, repo, owner, and for each kind what lies between matches (lengths) and the matches. One pass."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(repo.cast("string"), F.lit("")).alias("repo"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), text.alias("text"))
    rows = rows.select("*", *[_matches(F.col("text"), k).alias(f"m{k}") for k in range(len(KINDS))])
    gaps = [F.when(F.size(f"m{k}") > 0, _gaps(F.col("text"), k)).alias(f"g{k}") for k in range(len(KINDS))]
    return cut(rows.select("row", "doc_id", "repo", "owner", *[f"m{k}" for k in range(len(KINDS))], *gaps), "scanned")


def candidates(scanned: DataFrame) -> DataFrame:
    """row, repo, owner, kind, start, end, hash of the value, for matches that are long enough."""
    found = []
    for k in range(len(KINDS)):
        pairs = scanned.where(F.size(f"m{k}") > 0).select("row", "repo", "owner", F.lit(k).alias("kind"), F.posexplode(F.arrays_zip(F.col(f"g{k}").alias("gap"), F.col(f"m{k}").alias("match"))).alias("i", "x"))
        found.append(pairs.select("row", "repo", "owner", "kind", "i", "x.gap", "x.match").where("match is not null"))
    every = found[0].union(found[1]).union(found[2]).union(found[3])
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(F.col("kind") == 0, F.regexp_extract("match", ASSIGN, 1)).otherwise(F.col("match"))
    every = every.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(before)).withColumn("value", value)
    least = F.element_at(F.array(*map(F.lit, LEAST)), F.col("kind") + 1)
    every = every.where((F.length("value") >= least) & ((F.col("kind") < 3) | (F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]"))))
    return every.select("row", "repo", "owner", "kind", (F.col("end") - F.length("match")).alias("start"), "end", F.md5("value").alias("hash"))


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_repos, n_owners, n_seen over the whole corpus; summed up by owner first. Where the owner isn't known, each
    repository counts as one's own."""
    known = F.when(F.col("owner") == "", F.concat(F.lit("?"), "repo")).otherwise(F.col("owner"))
    by_repo = found.withColumn("owner", known).groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"), F.sum("n").alias("n_seen"))


def secrets(docs: DataFrame, repo: Column | None = None, owner: Column | None = None, with_holders: bool = False) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied: one row for each row of docs.

    with_holders: holders too, repositories:owners of each span's value in the order of spans.

    Counts and hash are of the patterns' spans; spans also has mixed strings of a single owner that overlap none of these.
    n_live and n_copied tell values of a single owner from copied ones among all spans. Offsets are code points, ends
    exclusive. Null texts count as empty, texts of any length are read whole, repeated rows are rows of their own; unknown
    repositories are one; columns of docs but doc_id, text and those in repo and owner are left out. No rows, no result.
    """
    repo, owner = F.col("source") if repo is None else repo, F.col("source") if owner is None else owner
    scanned = _scanned(docs, repo, owner)
    found = cut(candidates(scanned), "candidates")
    held = found.join(ownership(found).select("hash", "n_repos", "n_owners", (F.col("n_owners") <= OWNERS).alias("live")), "hash")
    base = F.col("kind") < 3
    order = Window.partitionBy("row").orderBy("start", "kind")
    left = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    right = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    apart = (F.coalesce(left, F.lit(0)) <= F.col("start")) & (F.coalesce(right, F.col("end")) >= F.col("end"))
    held = held.withColumn("apart", apart).where(base | (F.col("apart") & F.col("live")))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    span = F.struct("start", "kind", F.concat_ws(":", name, "start", "end").alias("span"), F.concat_ws(":", "n_repos", "n_owners").alias("holders"))
    joined = lambda only, what="span": F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.when(only, span))), lambda x: x[what]))
    by_row = held.groupBy("row").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.lit(True)).alias("spans"), F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_copied"), *([joined(F.lit(True), "holders").alias("holders")] if with_holders else [])
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = scanned.select("row", "doc_id").join(by_row, "row", "left")
    return out.select("doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"), F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("n_live"), zero("n_copied"), *([F.coalesce("holders", F.lit("")).alias("holders")] if with_holders else []))
