"""Near-duplicate documents by bottom-k sketches.

One hash function; a document keeps its k smallest shingle hashes. Inverted lists of the kept values give candidates,
the sketch of a pair's union estimates its similarity, and the exact Jaccard of the full sets decides.

Lists stay short of quadratic work in three ways. Equal sets are one class with one row. A pair that is similar enough
shares at least a given part of its sketches, so that each document is listed only under its rarest values (the prefix
filter), by which a passage that many documents share lists almost nobody. And a list is compared with its leader, not
with itself: members that the leader gathers into its component need no comparison with each other. Only pairs that
still lie in different components after a few leaders are compared one by one, so no link between components is lost.
Long lists are spread over parts by how many hold their value; what one row says of a list is sent to each of its parts.

Joins of what grows with the documents are merge joins: by the size of files, or behind an explode, Spark takes tables for
small that are not, and would send them to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, in_batches, parts, small_or_not
from .components import components
from .shingles import WordHashes, mix, shingle_set

#: Values that a sketch keeps.
SKETCH = 96
#: The part of a union sketch that similar documents are taken to share at least. At a Jaccard of 0.8, 77 of 96 are
#: expected with a standard deviation of 3.9; 0.6 lies five deviations below.
SHARED = 0.6
#: Rounds in which lists choose a leader, before what is left is compared pair by pair.
LEADERS = 3
#: Holders of a value from which its list is split over so many parts of this size.
PART = 1000


def _lists(of: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, of)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*of, np.empty(0, np.uint64)]).view(np.int64)))


def _least(s: np.ndarray, keep: int) -> np.ndarray:
    """Of sorted values the smallest ones as signed longs, in the order in which Spark sorts and cuts union sketches."""
    return np.sort(s.view(np.int64))[:keep].view(np.uint64)


def _sets(words: int, keep: int | None):
    """Arrow batches of (doc_id, text) -> set size, two fingerprints of the set, and its smallest values (None: all)."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for a, b in parts(batch.column(1)):
                part = batch.slice(a, b - a)
                sets = [shingle_set(t, words, hashes) for t in part.column(1).to_pylist()]
                one = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                two = np.array([np.bitwise_xor.reduce(mix(s + np.uint64(0x51ED27))) if len(s) else 0 for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), _lists(sets if keep is None else [_least(s, keep) for s in sets])],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "hashes"],
                )
        hashes.clear()
        give_back()

    return run


_SETS = "doc_id long, n_shingles long, set_a long, set_b long, hashes array<long>"


def document_sets(docs: DataFrame, words: int, keep: int | None) -> DataFrame:
    return in_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_sets(words, keep), _SETS)


def _similar(a: Column, b: Column, threshold: float) -> Column:
    """Of two set sizes: the smaller can be a large enough part of the larger."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * round(threshold * 100)


def _prefixes(sketches: DataFrame) -> DataFrame:
    """node, n, central, held: the rarest values, with their holders, under which a node must be listed; own ones left out.

    Nodes that share too little with all others together are gone.
    """
    kept = sketches.select("node", "n", F.size("hashes").alias("m"), F.explode("hashes").alias("value"))
    common = kept.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    held = kept.join(common.hint("merge"), "value").groupBy("node", "n", "m").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("held"), F.sum(F.log2("df")).alias("central"))
    must = F.ceil(F.col("m") * F.lit(SHARED))  # so many are shared with a similar document
    return held.where(F.size("held") >= must).select("node", "n", "central", F.slice("held", F.lit(1), (F.size("held") - must + 1).cast("int")).alias("held"))


class _Verifier:
    def __init__(self, sketches: DataFrame, full: DataFrame, threshold: float):
        self.sketches, self.full, self.percent = sketches, full, round(threshold * 100)

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of (a, b) the pairs whose full sets are similar enough."""
        near = self._with(pairs, self.sketches)
        union = F.slice(F.array_sort(F.array_union("x", "y")), 1, SKETCH)
        shared = F.size(F.array_intersect(F.array_intersect(union, F.col("x")), F.col("y")))
        near = cut(near.where(shared >= F.size(union) * F.lit(SHARED)).select("a", "b"), "near")
        both = F.size(F.array_intersect("x", "y"))
        sure = self._with(small_or_not(near), self.full).where(both * 100 >= (F.size("x") + F.size("y") - both) * self.percent)
        return sure.select("a", "b").distinct()

    @staticmethod
    def _with(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        x = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
        y = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
        return pairs.join(x, "a").join(y, "b")


def _in_parts(lists: DataFrame) -> DataFrame:
    """lists (value, df, node, ...) with the parts of each list, by how many hold its value, and the part of each row."""
    lists = lists.withColumn("parts", F.floor(F.col("df") / PART) + 1)
    return lists.withColumn("part", F.pmod(F.xxhash64("node"), "parts"))


def _join_parts(lists: DataFrame, known: DataFrame) -> DataFrame:
    """lists with known (value, parts, ...), which has one row of a value: each part of a list meets a row of its own."""
    each = known.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    return lists.join(each.hint("merge"), ["value", "part"])


def _split(lists: DataFrame) -> DataFrame:
    """Of lists (value, parts, part, node, component, ...) the rows of those that still hold two components."""
    split = lists.groupBy("value").agg(F.max("parts").alias("parts"), F.min("component").alias("low"), F.max("component").alias("high"))
    return _join_parts(lists, split.where("low < high").select("value", "parts"))


def _labelled(listed: DataFrame, labels: DataFrame) -> DataFrame:
    return listed.join(small_or_not(labels), "node", "left").withColumn("component", F.coalesce("component", "node"))


def _with_leaders(lists: DataFrame, turn: int, threshold: float) -> DataFrame:
    """(a, b), a < b: each node with the leader of one of its lists that lies in a different component.

    The leader is the member with the most widely shared sketch, which stands in the middle of its group, later a drawn
    one. A node first meets the most central leader of all its lists, then that of its shortest list, where it finds the
    likes of a small group, then any: no more pairs than nodes in a turn.
    """
    rank = F.struct(*(["central"] if turn < 2 else [F.xxhash64("value", "node", F.lit(turn)).alias("draw")]), "node", "n", "component")
    leaders = lists.groupBy("value").agg(F.max(rank).alias("lead"), F.max("parts").alias("parts"), F.count("*").alias("members")).select("value", "parts", "members", F.col("lead").getField("central" if turn < 2 else "draw").alias("rank"), F.col("lead.node").alias("node_2"), F.col("lead.n").alias("n_2"), F.col("lead.component").alias("component_2"))
    met = _join_parts(lists, leaders).where(F.col("component") != F.col("component_2")).where(_similar(F.col("n"), F.col("n_2"), threshold))
    first = F.struct(F.col("rank") if turn == 0 else -F.col("members") if turn == 1 else F.xxhash64("value", F.lit("turn")), "node_2")
    met = met.groupBy("node").agg(F.max_by("node_2", first).alias("node_2"))
    return met.select(F.least("node", "node_2").alias("a"), F.greatest("node", "node_2").alias("b")).distinct()


def _left_over(lists: DataFrame, full: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: all pairs across components that could still be similar, each once.

    Here the full sets are listed under their rarest values: similar sets share at least that part of either, so that
    the rest, and what no other set has, can be left out. Sizes and shared parts bound a pair's similarity.
    """
    percent = round(threshold * 100)
    held = full.join(lists.select("node", "component").distinct(), "node").select("node", "component", F.size("hashes").alias("n"), F.explode("hashes").alias("value"))
    common = held.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    held = held.join(common.hint("merge"), "value").groupBy("node", "component", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("held"))
    must = F.ceil(F.col("n") * percent / 100)
    rare = held.where(F.size("held") >= must).select("node", "component", "n", F.size("held").alias("shared"), F.posexplode(F.slice("held", F.lit(1), (F.size("held") - must + 1).cast("int"))).alias("i", "v"))
    # what a set has for itself comes first in its order, so that `left` values of it are not before this one
    rare = rare.select("node", "component", "n", "shared", (F.col("shared") - F.col("i")).alias("left"), "v.df", "v.value")
    x = cut(_split(_in_parts(rare)).drop("df"), "rare")
    # one side is spread over a list's parts, the other meets each of them
    y = x.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    y = y.select(*[F.col(c).alias(f"{c}_2") for c in ("value", "part", "node", "component", "n", "left")])
    # of the lists that a pair shares, the first has most of both in it or behind it: a pair that fits in any fits there
    fits = (F.least("left", "left_2") * (100 + percent) >= (F.col("n") + F.col("n_2")) * percent) & _similar(F.col("n"), F.col("n_2"), threshold)
    met = x.join(y.hint("merge"), (F.col("value") == F.col("value_2")) & (F.col("part") == F.col("part_2")) & (F.col("node") < F.col("node_2")) & (F.col("component") != F.col("component_2")) & fits)
    return met.select(F.col("node").alias("a"), F.col("node_2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs (doc_id, text, whatever else).

    Documents are linked when the Jaccard of their sets of shingles of so many words is at least threshold (in
    hundredths); component_id is the smallest doc_id reachable. Null, empty and blank texts have an empty set and are
    linked with nothing; a text of fewer words is one shingle. Rows that repeat a doc_id are one document: a link of
    one counts for all. Rows without a doc_id are linked with nothing, have no component and are kept.
    """
    sets = cut(document_sets(docs, words, SKETCH), "sets")
    key = ["set_a", "set_b", "n_shingles"]
    classes = cut(sets.where("n_shingles > 0 and doc_id is not null").groupBy(key).agg(F.min("doc_id").alias("node")), "classes")
    firsts = sets.join(classes.withColumnRenamed("node", "doc_id").hint("merge"), [*key, "doc_id"], "left_semi").dropDuplicates([*key, "doc_id"])
    sketches = cut(firsts.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "hashes"), "sketches")
    listed = _in_parts(_prefixes(sketches).select("node", "n", "central", F.inline("held"))).drop("df")
    met = listed.groupBy("value").agg(F.max("parts").alias("parts"), F.count("*").alias("members")).where("members > 1").select("value", "parts")
    listed = cut(_join_parts(listed, met), "listed")

    asked = small_or_not(cut(listed.select(F.col("node").alias("doc_id")).distinct(), "asked"))
    full = cut(document_sets(docs.join(asked, "doc_id", "left_semi"), words, None).select(F.col("doc_id").alias("node"), "hashes").distinct(), "full")
    verifier, labels = _Verifier(sketches, full, threshold), None
    # rows that repeat a doc_id: their classes belong together
    again = sets.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.count_distinct("set_a", "set_b").alias("sets")).where("sets > 1").select("doc_id")
    links = sets.join(again, "doc_id").join(classes.hint("merge"), key).groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("a", "b")
    for turn in range(LEADERS + 1):
        lists = _split(_labelled(listed, labels)) if labels is not None else listed.withColumn("component", F.col("node"))
        lists = cut(lists, "lists") if turn == LEADERS else lists
        pairs = _with_leaders(lists, turn, threshold) if turn < LEADERS else _left_over(lists, full, threshold)
        links = verifier.links(pairs).union(links)
        labels = cut(components(links), "labels")
        links = labels.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))

    classes = classes.join(small_or_not(labels), "node", "left").select(*key, F.coalesce("component", "node").alias("component_id"))
    out = sets.select("doc_id", *key).join(classes.hint("merge"), key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs with one document of each group: the one with the smallest doc_id, once if it is repeated. Rows without a
    doc_id all stay."""
    found = near_duplicates(docs, words, threshold).where("doc_id is not null").groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n"))
    found = cut(found.where("not kept or n > 1"), "dropped")
    every = [F.col(f"`{c}`") for c in docs.columns]
    out = docs.join(small_or_not(found.where("not kept").select("doc_id")), "doc_id", "left_anti").select(every)
    again = found.where("kept").select("doc_id")
    if again.limit(1).count():
        # of rows that repeat a doc_id, the first text in order stays
        rows = out.join(again, "doc_id", "left_semi").select(F.struct(every).alias("_row"))
        once = rows.groupBy(F.col("_row.doc_id")).agg(F.min_by("_row", F.struct(F.col("_row.text").isNull(), F.col("_row.text"))).alias("_row")).select("_row.*")
        out = out.join(again, "doc_id", "left_anti").select(every).union(once)
    return out
