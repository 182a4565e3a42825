"""Language-model scores of whole texts by prediction by partial matching over bytes.

A trie of byte contexts, counted on the training texts of the whole corpus, predicts each byte from up to ORDER bytes
before it. An unseen byte escapes to the next shorter context with the probability of method C (distinct followers
against all), and what the longer context has seen is excluded there. The code length of a text is the sum over its
bytes and an end mark.

The trie is a table with one row for each context and follower, and is as large as the corpus makes it. No task holds
it: a batch of texts asks for its distinct contexts, they are joined with the trie once, and the batch is scored with its
own slice of the answers, whose size is bounded by the batch. Word counts of the unigram base travel the same way.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, in_batches, new_folder, parts, small_or_not
from .shingles import WordHashes

#: Bytes of the longest context; bits of a symbol (a byte, or the mark that ends a text and stands before it).
ORDER, BITS, MARK = 5, 9, 256
SYMBOLS = 257
#: Bytes of texts that ask for contexts together; bytes whose contexts are made at a time; asked keys in a row.
BATCH_BYTES, STRETCH, KEYS = 64 << 20, 1 << 20, 1 << 16
#: Rows of the trie's short contexts that are broadcast at most; longer levels are joined by shuffle.
SMALL = 200_000
_SEPARATOR = b"\n"  # no word holds it: the end as a token of the base

_GATHERED = "batch long, doc_id long, held_out boolean, text string, keys array<long>, counts array<long>"


def _raw(texts: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts.to_pylist()]


def contexts(raw: list[bytes], order: int):
    """(place of the first, keys) of stretches of all bytes and end marks of the texts, in order: a key is the symbol in
    the low bits and the symbols before it above, the last one lowest."""
    gap = bytes(order)
    symbols = np.frombuffer(gap + b"".join(chain.from_iterable((r, gap) for r in raw)), np.uint8).astype(np.int16)
    ends = order + np.cumsum([len(r) + order for r in raw]) - order
    symbols[:order] = MARK
    for k in range(order):
        symbols[ends + k] = MARK
    asked = np.ones(len(symbols), bool)
    asked[:order] = False
    for k in range(1, order):  # the first mark behind a text is its end
        asked[ends + k] = False
    done = 0
    for a in range(order, len(symbols), STRETCH):
        b = min(a + STRETCH, len(symbols))
        some = symbols[a - order : b].astype(np.int64)
        key = some[order:].copy()
        for k in range(1, order + 1):
            key |= some[order - k : len(some) - k] << (BITS * k)
        key = key[asked[a:b]]
        yield done, key
        done += len(key)


def word_keys(raw: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Negative keys of all words and ends of the texts, and how many belong to each text."""
    words = [[*r.split(), _SEPARATOR] for r in raw]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    found = np.fromiter(map(hashes.__getitem__, chain.from_iterable(words)), np.uint64, int(sizes.sum()))
    return ~(found >> np.uint64(1)).view(np.int64), sizes


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, and for each key its place among them."""
    d = pa.array(keys).dictionary_encode()
    return d.dictionary.to_numpy(), d.indices.to_numpy()


class _Counts:
    """Training counts by key; keys of other texts count zero."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, learns: np.ndarray) -> None:
        known, at = _distinct(keys)
        self.held.append((known, np.bincount(at[learns], minlength=len(known))))
        self.size += len(known)
        if self.size > 4_000_000 and len(self.held) > 1:
            self._merge()

    def _merge(self) -> None:
        keys, at = np.unique(np.concatenate([k for k, _ in self.held]), return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, at, np.concatenate([c for _, c in self.held]))
        self.held, self.size = [(keys, counts)], 0

    def rows(self, batch: int):
        if self.held:
            self._merge()
            keys, counts = self.held[0]
            for a in range(0, len(keys), KEYS):
                lists = [pa.array([x[a : a + KEYS]], pa.list_(pa.int64())) for x in (keys, counts)]
                yield pa.RecordBatch.from_arrays([pa.array([batch]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.string()), *lists], names=[c.split()[0] for c in _GATHERED.split(", ")])
            self.held = []


def _gather(order: int, batch_bytes: int):
    """(doc_id, held_out, text) -> the texts with the number of their batch, and behind each batch its keys."""

    def run(batches):
        hashes, counts, size = WordHashes(), _Counts(), 0
        batch = TaskContext.get().partitionId() << 32
        for rows in batches:
            for a, b in parts(rows.column(2)):
                part = rows.slice(a, b - a)
                raw, held = _raw(part.column(2)), part.column(1).to_numpy(zero_copy_only=False)
                n, none = len(raw), pa.nulls(len(raw), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch)), *part.columns, none, none], names=[c.split()[0] for c in _GATHERED.split(", ")])
                ends = np.cumsum([len(r) + 1 for r in raw])
                for at, keys in contexts(raw, order):
                    owner = np.searchsorted(ends, np.arange(at, at + len(keys)), side="right")
                    counts.add(keys, ~held[owner])
                words, sizes = word_keys(raw, hashes)
                counts.add(words, np.repeat(~held, sizes))
                size += sum(map(len, raw))
                if size >= batch_bytes:
                    yield from counts.rows(batch)
                    batch, size = batch + 1, 0
        yield from counts.rows(batch)

    return run


def _gram(key: Column, k: int) -> Column:
    """A key's last k symbols and its own."""
    return key.bitwiseAND((1 << (BITS * (k + 1))) - 1)


class Trie:
    """Of the contexts of each length k: grams[k] (gram, c), a context with its follower, and nodes[k] (ctx, n, d, nx, dx):
    followers in all, different ones, and both again in the next shorter context without the followers seen here."""

    def __init__(self, counted: DataFrame, order: int):
        """counted: key, n of contexts with n > 0."""
        self.grams, self.nodes = [cut(counted.toDF("gram", "c"), "grams")], []
        for k in range(order - 1, -1, -1):
            shorter = self.grams[0].groupBy(_gram(F.col("gram"), k).alias("gram")).agg(F.sum("c").alias("c"))
            self.grams.insert(0, cut(shorter, "grams"))
        root = self.grams[0].agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        self.root_n, self.root_d = root
        for k in range(1, order + 1):
            here = self.grams[k].select("gram", "c", F.shiftright("gram", BITS).alias("ctx"), _gram(F.col("gram"), k - 1).alias("below"))
            below = small_or_not(self.grams[k - 1], SMALL).toDF("below", "c_below")
            node = here.join(below, "below").groupBy("ctx").agg(F.sum("c").alias("n"), F.count("*").alias("d"), F.sum("c_below").alias("x"))
            if k == 1:
                node = node.withColumn("n_below", F.lit(self.root_n)).withColumn("d_below", F.lit(self.root_d))
            else:
                up = small_or_not(self.nodes[-1].select(F.col("ctx").alias("up"), F.col("n").alias("n_below"), F.col("d").alias("d_below")), SMALL)
                node = node.withColumn("up", _gram(F.col("ctx"), k - 2)).join(up, "up")
            self.nodes.append(cut(node.select("ctx", "n", "d", (F.col("n_below") - F.col("x")).alias("nx"), (F.col("d_below") - F.col("d")).alias("dx")), "nodes"))

    def log_probabilities(self, asked: DataFrame) -> DataFrame:
        """asked: key, n (its training count) -> key, value: log10 of the probability of the symbol after its context."""
        order = len(self.nodes)
        nothing = F.lit(None).cast("long")
        left, found = asked.select("key", F.when(F.col("n") > 0, F.col("n")).alias("c"), F.lit(0.0).alias("value"), nothing.alias("fx"), nothing.alias("gx")), []
        for k in range(order, -1, -1):
            if k < order:
                left = left.drop("c").withColumn("gram", _gram(F.col("key"), k)).join(small_or_not(self.grams[k], SMALL), "gram", "left").drop("gram")
            if k:
                left = left.withColumn("ctx", F.shiftright(_gram(F.col("key"), k), BITS)).join(small_or_not(self.nodes[k - 1], SMALL), "ctx", "left").drop("ctx")
            else:
                seen = F.when(F.lit(self.root_n) > 0, F.lit(self.root_n))
                left = left.select("*", seen.alias("n"), F.lit(self.root_d).alias("d"), nothing.alias("nx"), nothing.alias("dx"))
            n, d = F.coalesce("fx", "n"), F.coalesce("gx", "d")
            step = F.when(F.col("n").isNull(), 0.0).when(F.col("c").isNotNull(), F.log10(F.col("c") / (n + d))).when(d > 0, F.log10(d / (n + d))).otherwise(0.0)
            if not k:
                step += F.when(F.col("c").isNull(), -F.log10(F.lit(float(SYMBOLS - self.root_d)))).otherwise(0.0) if self.root_d < SYMBOLS else F.lit(0.0)
            left = cut(left.select("key", "c", (F.col("value") + step).alias("value"), F.col("nx").alias("fx"), F.col("dx").alias("gx")), "levels")
            found.append(left.where("c is not null").select("key", "value") if k else left.select("key", "value"))
            left = left.where("c is null")
        out = found[0]
        for more in found[1:]:
            out = out.union(more)
        return out


def _slices(folder: str):
    """batch -> its keys in ascending order and their values; the last one is kept."""
    system, root = fs.FileSystem.from_uri(folder)
    last: list = [None, None]

    def of(batch: int):
        if last[0] != batch:
            rows = pads.dataset(f"{root}/batch={batch}", filesystem=system, format="parquet").to_table(columns=["key", "value"])
            keys = rows.column("key").to_numpy()
            order = np.argsort(keys)
            last[:] = batch, (keys[order], rows.column("value").to_numpy()[order])
        return last[1]

    return of


def _scored(folder: str, order: int, tokens: int, different: int):
    def run(batches):
        slices, hashes = _slices(folder), WordHashes()

        def values(known, of):
            return of[1][np.searchsorted(of[0], known)]

        for rows in batches:
            numbers = rows.column(0).to_numpy()
            turns = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for x, y in zip(turns, turns[1:]):
                same = rows.slice(x, y - x)
                if not same.num_rows:
                    continue
                of = slices(int(numbers[x]))
                for a, b in parts(same.column(3)):
                    part = same.slice(a, b - a)
                    raw = _raw(part.column(3))
                    ends, score = np.cumsum([len(r) + 1 for r in raw]), np.zeros(len(raw))
                    for at, keys in contexts(raw, order):
                        known, place = _distinct(keys)
                        owner = np.searchsorted(ends, np.arange(at, at + len(keys)), side="right")
                        score += np.bincount(owner, weights=values(known, of)[place], minlength=len(raw))
                    words, sizes = word_keys(raw, hashes)
                    known, place = _distinct(words)
                    counts = values(known, of)[place]
                    owner = np.repeat(np.arange(len(raw)), sizes)
                    base = np.bincount(owner, weights=np.log10((counts + 1) / (tokens + different + 1)), minlength=len(raw))
                    n_known = np.bincount(owner, weights=counts > 0, minlength=len(raw)).astype(np.int64)
                    n = len(raw)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(1), part.column(2), pa.array(sizes), pa.array(n_known), pa.array(np.full(n, tokens)), pa.array(base), pa.array(score), pa.array(np.array([len(r) for r in raw], np.int64))],
                        names=[c.split()[0] for c in _SCORED.split(", ")],
                    )

    return run


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training: the remainder of its crc32 by seven is two. Null counts as no text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def lm_scores(docs: DataFrame, order: int = ORDER, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes: one row for each row of docs
    (doc_id, text, whatever else).

    score is log10 of the probability of the text's bytes (A-Z lower-cased, white space as it is) and its end, by the trie
    of those that are not held out; base_score that of its words and its end by single words, told apart by 63 bits of a
    hash. Null and empty texts are an end alone; texts of any length are read whole; repeated rows count and are scored
    each; other columns are left out. No rows, no result. Without training texts all 257 symbols are alike.
    """
    rows = in_batches(docs).select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    spark, path = docs.sparkSession, new_folder(docs.sparkSession, "gathered")
    rows.mapInArrow(_gather(order, batch_bytes), _GATHERED).write.option("compression", "zstd").parquet(path)
    gathered = spark.read.schema(_GATHERED).parquet(path)
    asked = gathered.where("keys is not null")
    each = asked.select(F.explode(F.arrays_zip("keys", "counts")).alias("x")).select(F.col("x.keys").alias("key"), F.col("x.counts").alias("n"))
    counted = cut(each.groupBy("key").agg(F.sum("n").alias("n")), "counted")
    tokens, different = counted.where("key < 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()

    trie = Trie(counted.where("key >= 0 and n > 0"), order)
    values = trie.log_probabilities(counted.where("key >= 0")).union(counted.where("key < 0").select("key", F.col("n").cast("double")))
    slices = new_folder(spark, "slices")
    asked.select("batch", F.explode("keys").alias("key")).join(values, "key").repartition("batch").write.partitionBy("batch").option("compression", "zstd").parquet(slices)
    texts = gathered.where("keys is null").select("batch", "doc_id", "held_out", "text")
    return texts.mapInArrow(_scored(slices, order, tokens, different), _SCORED)
