"""Mixing documents to target token shares with soft membership in domains; DataFrame functions only.

A naive Bayes classifier, trained on a labelled table, gives every document its domain posteriors. Projected gradient
steps of a least-squares problem then find nonnegative document rates for which the expected token totals of the
domains match their targets, and which otherwise stay close to one.

A rate depends on a document's posteriors alone. Documents whose posteriors agree in GRID-ths are summed up before the
first step and share a rate: the steps run over one row for each cell of posteriors that occurs. What a cell holds of each
domain is the sum of its documents' own posteriors, so that the totals that meet the targets are not rounded.
"""

from __future__ import annotations

import json
import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_or_not

#: Buckets that words are hashed into, pseudo-count of a bucket, labelled documents used (on average).
BUCKETS, PSEUDO, SAMPLE = 1 << 14, 0.5, 20_000
#: Words of a text are not independent: n words count as n to this power.
EVIDENCE = 0.6
#: Documents share a rate if their posteriors agree when cut into so many parts.
GRID = 64
#: Weight of the squared distance of rates from one, against the squared relative misses of the targets; steps.
CLOSENESS, STEPS = 1e-3, 60


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"\s+"), "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS))


def train(docs: DataFrame, labels: DataFrame, domains: list[str], sample: int = SAMPLE) -> tuple[DataFrame, list[float]]:
    """bucket, w0, w1, ... (log likelihoods by domain), and the log priors.

    labels: doc_id, domain; others than the given domains, nulls and documents without text are left out; of several labels
    of a doc_id the first by name holds. About
    `sample` labelled documents, drawn by a hash of doc_id, count. No labels give equal posteriors everywhere.
    """
    named = labels.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    rate = min(1.0, sample / max(1, named.count()))
    drawn = cut(named.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(rate * 1_000_000)), "labelled")
    seen = docs.select("doc_id", "text").join(small_or_not(drawn), "doc_id").select("domain", F.explode(words(F.col("text"))).alias("word"))
    counted = seen.select(_bucket(F.col("word")).alias("bucket"), "domain").groupBy("bucket").agg(*[F.sum((F.col("domain") == d).cast("double")).alias(f"n{i}") for i, d in enumerate(domains)])
    counted = cut(counted, "counts")  # BUCKETS rows at most
    totals = counted.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0.0)) for i in range(len(domains))]).first()
    held = {r[0]: r[1] for r in drawn.groupBy("domain").count().collect()}
    weights = [F.log((F.coalesce(f"n{i}", F.lit(0.0)) + PSEUDO) / (totals[i] + PSEUDO * BUCKETS)).alias(f"w{i}") for i in range(len(domains))]
    buckets = docs.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket").join(F.broadcast(counted), "bucket", "left").select("bucket", *weights)
    whole = sum(held.values()) + len(domains)
    return cut(buckets, "weights"), [math.log((held.get(d, 0) + 1) / whole) for d in domains]


def posteriors(docs: DataFrame, model: DataFrame, priors: list[float]) -> DataFrame:
    """doc_id, text_hash, n_tokens, p0, ..., q0, ...: posteriors, and these in GRID-ths, which add up to GRID; rows that
    repeat doc_id and text are one."""
    n = len(priors)
    rows = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"), words(F.col("text")).alias("words"))
    rows = rows.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_tokens"), F.explode_outer("words").alias("word")).withColumn("bucket", _bucket(F.col("word")))
    met = rows.join(F.broadcast(model), "bucket", "left")  # BUCKETS rows
    summed = met.groupBy("doc_id", "text_hash", "n_tokens").agg(*[F.avg(f"w{i}").alias(f"w{i}") for i in range(n)])
    score = [F.lit(p) + F.coalesce(F.col(f"w{i}"), F.lit(0.0)) * F.pow(F.col("n_tokens").cast("double"), F.lit(EVIDENCE)) for i, p in enumerate(priors)]
    scored = summed.select("doc_id", "text_hash", "n_tokens", *[s.alias(f"s{i}") for i, s in enumerate(score)])
    top = F.greatest(*[F.col(f"s{i}") for i in range(n)]) if n > 1 else F.col("s0")
    scored = scored.select("doc_id", "text_hash", "n_tokens", *[F.exp(F.col(f"s{i}") - top).alias(f"e{i}") for i in range(n)])
    whole = reduce(add, [F.col(f"e{i}") for i in range(n)])
    # cumulated posteriors are rounded, so that the parts add up
    upto = [F.round(reduce(add, [F.col(f"e{j}") for j in range(i + 1)]) / whole * GRID).cast("int") for i in range(n)]
    exact = [(F.col(f"e{i}") / whole).alias(f"p{i}") for i in range(n)]
    return scored.select("doc_id", "text_hash", "n_tokens", *exact, *[(upto[i] - (upto[i - 1] if i else 0)).alias(f"q{i}") for i in range(n)])


def fit_rates(groups: DataFrame, targets: list[float], steps: int = STEPS) -> DataFrame:
    """groups (q0, q1, ..., tokens, m0, m1, ...: tokens by domain) with `rate`: accelerated projected gradient, each step
    one aggregation.

    The rates after k steps are a function of a group's posteriors and of the k residual vectors so far, which are all
    that comes to the driver.
    """
    n, spark = len(targets), groups.sparkSession
    m = [F.col(f"m{i}") for i in range(n)]
    # the posteriors of a cell are those of its tokens, so that this is the gradient of the very problem
    p = [F.coalesce(x / F.nullif("tokens", F.lit(0)), F.col(f"q{i}") / GRID) for i, x in enumerate(m)]
    mass = groups.agg(F.coalesce(F.sum("tokens"), F.lit(0)), *[F.coalesce(F.sum(x), F.lit(0.0)) for x in m]).first()
    total = float(mass[0]) or 1.0
    share = [max(m / total, 1e-9) for m in mass[1:]]
    history: list[list[float]] = []

    kind = ",".join(f"r{i}:double" for i in range(n))
    start = F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("last"), F.lit(0.0).alias("k"))

    def ahead(s: Column) -> Column:
        return s["rate"] + (s["rate"] - s["last"]) * (s["k"] / (s["k"] + 3.0))

    def step(s: Column, h: Column) -> Column:
        y = ahead(s)
        pull = reduce(add, [x * h[f"r{i}"] for i, x in enumerate(p)]) + (y - 1.0) * CLOSENESS
        return F.struct(F.greatest(F.lit(0.0), y - pull / (1.0 + CLOSENESS)).alias("rate"), s["rate"].alias("last"), (s["k"] + 1.0).alias("k"))

    def state() -> Column:
        """The rate, the one before it and the number of steps, folded over the residuals so far."""
        so_far = json.dumps([{f"r{i}": x for i, x in enumerate(res)} for res in history])
        return F.aggregate(F.from_json(F.lit(so_far), f"array<struct<{kind}>>"), start, step)

    for _ in range(steps):
        got = groups.withColumn("y", ahead(state())).agg(*[F.coalesce(F.sum(x * F.col("y")), F.lit(0.0)) for x in m]).first()
        # relative to the domain's own mass: steps of length one converge then
        history.append([(g - t) / total / s for g, t, s in zip(got, targets, share)])
        if len(history) > 1 and max(abs(a - b) for a, b in zip(history[-1], history[-2])) < 1e-6:
            break
    return cut(groups.withColumn("rate", state()["rate"]), "rates")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], total: float | None = None, seed: int = 0) -> DataFrame:
    """doc_id, text_hash, n_tokens, p_<domain>..., rate, copies: one row for each different (doc_id, text) of docs.

    targets are token shares of the mixture by domain, total its tokens (None: as many as docs have). copies is the
    rate rounded up or down by a hash of the document, so that it is rate on average. Null and empty texts have no
    tokens, get the priors, and a rate like all others with these posteriors; texts of any length are read whole. labels:
    doc_id, domain. Columns of docs but doc_id and text are left out. No rows, no result.
    """
    domains = sorted(targets)
    model, priors = train(docs, labels, domains)
    scored = cut(posteriors(docs, model, priors), "posteriors")
    q = [f"q{i}" for i in range(len(domains))]
    held = [F.sum(F.col("n_tokens") * F.col(f"p{i}")).alias(f"m{i}") for i in range(len(domains))]
    groups = cut(scored.groupBy(*q).agg(F.sum("n_tokens").alias("tokens"), *held), "groups")
    size = total if total is not None else float(groups.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    whole = sum(targets.values())
    rates = fit_rates(groups, [targets[d] / whole * size for d in domains])
    out = scored.join(small_or_not(rates.select(*q, "rate")), q)
    draw = F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")
    return out.select("doc_id", "text_hash", "n_tokens", *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)], "rate", copies.alias("copies"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float], total: float | None = None, seed: int = 0) -> DataFrame:
    """docs, each row as often as its document has copies. Columns of any name stay."""
    plan = mix(docs, labels, targets, total, seed).where("copies > 0").select("doc_id", "text_hash", "copies").toDF("_id", "_hash", "_copies")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    met = rows.join(plan, F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("_row.text").cast("string")) == F.col("_hash")))
    return met.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")
