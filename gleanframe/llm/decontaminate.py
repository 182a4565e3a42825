"""Benchmark passages in documents, by spaced-seed hashing; DataFrame functions only.

A mask looks at some of eight neighbouring tokens and ignores the others. Hashes of the looked-at tokens of the test
texts, at every position and for every mask, are joined with those of the documents; around each hit the aligned tokens
are compared. The masks are chosen so that no window of WINDOW tokens with up to SUBSTITUTIONS changed ones escapes all.

Generated code holds all that joins make of one row before it hands on the first. Documents are therefore joined in
stretches, and a hit holds the tokens around it, not its document: a text of any length with any number of hits does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_or_not

#: Places that a mask looks at; each lies within SPAN tokens.
MASKS = ((0, 1, 2, 5, 6, 7), (0, 1, 2, 3, 4, 6), (0, 3, 4, 5, 6, 7))
SPAN = 8
#: Tokens of a window, and how many of them may differ. A test text of SPAN to WINDOW - 1 tokens is a window as a whole,
#: of which one token may differ; shorter ones can't be told from chance and are never found.
WINDOW, SUBSTITUTIONS = 13, 2
#: Seeds of the test texts that are broadcast at a time (some 50 bytes each). More are joined in blocks.
SEEDS = 500_000
#: Words of a document that are hashed and joined at a time, with as many before and behind as a window around a hit holds.
STRETCH, AROUND = 512, WINDOW - 1


def _words(text: Column) -> Column:
    """The runs of letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def tokens(text: Column) -> Column:
    """Their hashes."""
    return F.transform(_words(text), lambda w: F.xxhash64(w))


def _stretches(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, start, head, doc: hashes of STRETCH words of a document and of those around them; `head` of
    these lie before, and the first of the others has place `start` in the document."""
    rows = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.posexplode(F.array(_words(F.col("text")))).alias("_", "words")).drop("_")
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(STRETCH))
    rows = rows.select("doc_id", "text_hash", "words", F.explode(starts).alias("start")).withColumn("head", F.least("start", F.lit(AROUND)))
    held = F.slice("words", F.col("start") - F.col("head") + 1, F.col("head") + STRETCH + AROUND)
    # generators of one row: the optimizer moves nothing through them, so that whole documents end here
    rows = rows.select("doc_id", "text_hash", "start", "head", F.explode(F.array(held)).alias("words"))
    # a function of arrays is where generated code ends, so that each stretch is a row of its own for the joins
    return rows.select("doc_id", "text_hash", "start", "head", F.transform("words", lambda w: F.xxhash64(w)).alias("doc"))


def _seeded(rows: DataFrame, of: str, at: str) -> DataFrame:
    """rows with `at`, `mask` and `seed`, for every position and mask; null where a mask reaches over the end.

    Generators and hashes stay in generated code, which is kept small enough for the compiler. The outer one gets no filter,
    which would make the array once more.
    """
    rows = rows.select("*", F.posexplode_outer(of).alias(at, "_token")).drop("_token")
    seeds = [F.when(F.col(at) + max(m) < F.size(of), F.xxhash64(F.lit(i), *[F.get(F.col(of), F.col(at) + p) for p in m])) for i, m in enumerate(MASKS)]
    return rows.select("*", F.posexplode(F.array(*seeds)).alias("mask", "seed"))


def _around(of: str, at: Column) -> Column:
    """What `of` holds around a place: up to AROUND tokens on either side."""
    return F.slice(of, F.greatest(at - AROUND, F.lit(0)) + 1, F.least(at, F.lit(AROUND)) + 1 + AROUND)


def _agrees(d: str, b: str, p: Column, q: Column, size: str) -> Column:
    """Whether a window around the hit is alike enough in both: document token p + k beside test token q + k, of a test
    text of such a size."""
    n = F.least(F.col(size), F.lit(WINDOW))
    reach = F.sequence(1 - n, n - 1)
    same = F.transform(reach, lambda k: (F.get(F.col(d), p + k) == F.get(F.col(b), q + k)).cast("int"))
    count = lambda part: F.aggregate(part, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    alike = F.exists(F.sequence(F.lit(1), n), lambda s: count(F.slice(same, s, n)) >= n - F.when(n < WINDOW, 1).otherwise(SUBSTITUTIONS))
    return alike


def benchmark_texts(benchmark: DataFrame) -> DataFrame:
    """item, test: equal token sequences once, under their smallest item_id; without an item_id there is nothing to name."""
    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item"), tokens(F.col("text")).alias("test"))
    return rows.where(F.size("test") >= SPAN).groupBy("test").agg(F.min("item").alias("item")).select("item", "test")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, item, shift, first, last: where documents (doc_id, text) repeat test texts, one row for each
    alignment; its outermost hits begin at document token `first` and end before `last`."""
    tests = cut(benchmark_texts(benchmark), "tests")
    widths = F.element_at(F.array(*[F.lit(max(m) + 1) for m in MASKS]), F.col("mask") + 1)
    seeds = cut(_seeded(tests, "test", "q").where("seed is not null").select("seed", "item", "q", widths.alias("width")).distinct(), "seeds")
    blocks = max(1, -(-seeds.count() // SEEDS))
    looked = _seeded(_stretches(docs), "doc", "at").drop("mask")
    # a stretch's own places: what lies around them is the next one's
    looked = looked.where((F.col("at") >= F.col("head")) & (F.col("at") < F.col("head") + STRETCH))
    found = []
    for i in range(blocks):  # each block's seeds and the test texts they lie in have a bounded size
        mine = lambda df: df.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i) if blocks > 1 else df
        hits = looked.join(F.broadcast(mine(seeds)), "seed").join(F.broadcast(mine(tests)), "item")
        place = F.col("start") + F.col("at") - F.col("head")
        around = F.struct(F.size("test").alias("size"), _around("doc", F.col("at")).alias("near"), F.least("at", F.lit(AROUND)).alias("np"), _around("test", F.col("q")).alias("like"), F.least("q", F.lit(AROUND)).alias("nq"))
        hits = hits.select("doc_id", "text_hash", "item", place.alias("p"), "q", "width", F.inline(F.array(around)))
        sure = hits.where(_agrees("near", "like", F.col("np"), F.col("nq"), "size")).select("doc_id", "text_hash", "item", (F.col("p") - F.col("q")).alias("shift"), "p", (F.col("p") + F.col("width")).alias("end"))
        # several blocks: each is written before the next one's seeds are sent out, and then forgotten
        found.append(cut(sure, "hits") if blocks > 1 else sure)
    every = reduce(DataFrame.union, found)
    return every.groupBy("doc_id", "text_hash", "item", "shift").agg(F.min("p").alias("first"), F.max("end").alias("last"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, overlap_tokens, item_ids: one row for each row of docs.

    overlap_tokens spans the hits of the longest alignment; item_ids are the smallest ids of the test texts met, in
    order. Null and empty texts are clean; texts of any length are searched whole; rows that repeat a doc_id are judged each
    by its own text; columns but doc_id and text are left out. No rows, no result; an empty benchmark leaves all clean.
    """
    by_doc = leaks(docs, benchmark).groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set("item")).alias("item_ids"), F.max(F.col("last") - F.col("first")).cast("long").alias("overlap_tokens")
    ).withColumnRenamed("doc_id", "leaked_id").withColumnRenamed("text_hash", "leaked_text")
    rows = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    out = rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("leaked_id")) & (F.col("text_hash") == F.col("leaked_text")), "left")
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("overlap_tokens", F.lit(0).cast("long")).alias("overlap_tokens"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no test text is found. Columns of any name stay; null and empty texts are clean."""
    found = cut(leaks(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "leaked")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    same = F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("_row.text").cast("string")) == F.col("_hash"))
    return rows.join(small_or_not(found), same, "left_anti").select("_row.*")
