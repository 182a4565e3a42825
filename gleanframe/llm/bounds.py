"""Vector codes (product quantization) with codebooks learned by adaptive distance bounds (Drake and Hamerly, 2012).

A vector is cut into parts, each with a codebook. For each part a row of the state table keeps the assigned entry, an
upper bound of the distance to it, the next closest entries with ascending lower bounds, and one outer bound for all
others. When entries have moved, bounds move by as much; a part whose upper bound stays strictly below the least lower
bound keeps its entry unseen. Otherwise only the entries whose bounds don't rule them out are compared, in integers, or all
when even the outer bound doesn't hold. How many closest entries a part keeps follows from how many were needed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, small_or_not
from .vectors import lists, matrix, mean_floor, scaled

#: Closest entries kept at first and at least, as parts of the codebook; parts of vectors that may need more than are kept.
FIRST, LEAST, BEYOND = 1 / 4, 1 / 8, 0.02
#: Bounds are floats: they are widened by this part of what is added to them, far more than rounding can lose.
SLACK = 1e-5

_STATE = "vec_id long, label string, x array<int>, code array<int>, upper array<float>, near array<int>, low array<float>"


def _squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries, (rows, entries)."""
    out = np.empty((len(x), len(entries)), np.int64)
    for j, e in enumerate(entries):
        d = x - e
        out[:, j] = (d * d).sum(axis=1)
    return out


def _above(d: np.ndarray) -> np.ndarray:
    return (np.sqrt(d.astype(np.float64)) * (1 + SLACK)).astype(np.float32)


def _below(d: np.ndarray) -> np.ndarray:
    return (np.sqrt(d.astype(np.float64)) * (1 - SLACK)).astype(np.float32)


class Part:
    """The bounds of one part of some vectors: code (n), upper (n), near (n, b), low (n, b + 1), the last one outer."""

    def __init__(self, x: np.ndarray, entries: np.ndarray):
        self.x, self.entries = x.astype(np.int64), entries.astype(np.int64)

    def search(self, rows: np.ndarray, b: int) -> tuple[np.ndarray, ...]:
        """Everything anew for some rows, by comparing all entries."""
        d = _squared(self.x[rows], self.entries)
        ranked = np.argsort(d, axis=1, kind="stable")  # ties to the lower index
        far = np.take_along_axis(d, ranked, axis=1)
        # without others, an outer bound that nothing reaches
        outer = _below(far[:, b + 1 : b + 2]) if b + 1 < d.shape[1] else np.full((len(d), 1), 1e30, np.float32)
        return ranked[:, 0], _above(far[:, 0]), ranked[:, 1 : b + 1], np.concatenate([_below(far[:, 1 : b + 1]), outer], axis=1)

    def start(self, b: int) -> None:
        self.code, self.upper, self.near, self.low = self.search(np.arange(len(self.x)), b)
        self.needed = np.zeros(len(self.entries) + 1, np.int64)

    def move(self, code, upper, near, low, moved: np.ndarray, b: int) -> None:
        """From the bounds before entries moved so far to the right ones now, with b closest entries (no more than before)."""
        had, n = near.shape[1], len(code)
        self.code, self.near = code.copy(), near
        self.upper = ((upper + moved[code]) * (1 + SLACK)).astype(np.float32)
        fall = np.concatenate([moved[near], np.full((n, 1), moved.max(initial=0.0))], axis=1)
        low = low.astype(np.float64)
        self.low = (low - fall - SLACK * (low + fall)).astype(np.float32)
        ordered = np.minimum.accumulate(self.low[:, ::-1], axis=1)[:, ::-1]
        needed = (ordered <= self.upper[:, None]).sum(axis=1)
        unsure = np.flatnonzero(needed)
        if len(unsure):  # the true distance to the present entry may settle it
            d = self.x[unsure] - self.entries[self.code[unsure]]
            self.upper[unsure] = _above((d * d).sum(axis=1))
            needed[unsure] = (ordered[unsure] <= self.upper[unsure, None]).sum(axis=1)
        self.low = np.ascontiguousarray(ordered)
        for z in range(1, had + 1):
            rows = np.flatnonzero(needed == z)
            if len(rows):
                self._among(rows, z)
        self.needed = np.bincount(needed, minlength=len(self.entries) + 1)
        if b < had:
            self.low = np.concatenate([self.low[:, :b], self.low[:, b:].min(axis=1, keepdims=True)], axis=1)
            self.near = self.near[:, :b]
        every = np.flatnonzero(needed == had + 1)
        if len(every):
            self.near, self.low = self.near.copy(), self.low.copy()
            self.code[every], self.upper[every], self.near[every], self.low[every] = self.search(every, b)

    def _among(self, rows: np.ndarray, z: int) -> None:
        """Compare the present entry and the z closest ones; they change places by their exact distances."""
        self.near = self.near.copy() if not self.near.flags.writeable else self.near
        names = np.concatenate([self.code[rows, None], self.near[rows, :z]], axis=1)
        d = ((self.x[rows, None, :] - self.entries[names]) ** 2).sum(axis=2)
        ranked = np.lexsort((names, d), axis=1)
        names, d = np.take_along_axis(names, ranked, axis=1), np.take_along_axis(d, ranked, axis=1)
        self.code[rows], self.upper[rows] = names[:, 0], _above(d[:, 0])
        self.near[rows, :z] = names[:, 1:]
        # not above the bounds that follow, which stay
        self.low[rows, :z] = np.minimum(_below(d[:, 1:]), self.low[rows, z, None])


def _assign(books: np.ndarray, kept: list[int], moved: np.ndarray | None, before: list[int] | None):
    """State or (vec_id, label, x) -> state under the present codebooks, with a first row by task of what it needed."""
    parts, k, wide = books.shape

    def run(batches):
        for batch in batches:
            n, x = batch.num_rows, matrix(batch.column(2), parts * wide)
            code, upper = np.empty((n, parts), np.int32), np.empty((n, parts), np.float32)
            near, low, needed = [], [], []
            if moved is not None:
                had = [matrix(batch.column(c), w) for c, w in ((3, parts), (4, parts), (5, sum(before)), (6, sum(before) + parts))]
            for p in range(parts):
                part = Part(x[:, p * wide : (p + 1) * wide], books[p])
                if moved is None:
                    part.start(kept[p])
                else:
                    a, b = sum(before[:p]), sum(before[: p + 1])
                    part.move(had[0][:, p], had[1][:, p], had[2][:, a:b], had[3][:, a + p : b + p + 1], moved[p], kept[p])
                code[:, p], upper[:, p] = part.code, part.upper
                near.append(part.near), low.append(part.low), needed.append(part.needed)
            count = pa.array([np.concatenate(needed)] + [None] * (n - 1), pa.list_(pa.int64())) if n else pa.nulls(0, pa.list_(pa.int64()))
            arrays = [batch.column(0), batch.column(1), batch.column(2), lists(code), lists(upper), lists(np.concatenate(near, axis=1).astype(np.int32)), lists(np.concatenate(low, axis=1).astype(np.float32)), count]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "label", "x", "code", "upper", "near", "low", "needed"])

    return run


def _summed(parts: int, k: int, wide: int):
    """(x, code) -> part, entry, n, sums: one row for each entry that a task met."""

    def run(batches):
        counts, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, wide), np.int64)
        for batch in batches:
            x, code = matrix(batch.column(0), parts * wide), matrix(batch.column(1), parts)
            for p in range(parts):
                counts[p] += np.bincount(code[:, p], minlength=k)
                for i in range(wide):  # sums in floats are exact below 2**53: LARGEST times the rows of a batch
                    sums[p, :, i] += np.bincount(code[:, p], weights=x[:, p * wide + i], minlength=k).astype(np.int64)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(counts[p, e]), lists(sums[p, e])], names=["part", "entry", "n", "sums"])

    return run


def _coded(books: np.ndarray):
    parts, _, wide = books.shape

    def run(batches):
        for batch in batches:
            x, code = matrix(batch.column(2), parts * wide).astype(np.int64), matrix(batch.column(3), parts)
            error = np.zeros(len(x), np.int64)
            for p in range(parts):
                d = x[:, p * wide : (p + 1) * wide] - books[p][code[:, p]]
                error += (d * d).sum(axis=1)
            text = [bytes(c).hex() for c in code.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def _adapted(needed: np.ndarray, kept: int, k: int) -> int:
    """How many closest entries to keep: so many that few parts need more, no more than before."""
    beyond = needed.sum() - np.cumsum(needed)  # parts that needed more than 0, 1, 2, ...
    enough = int(np.argmax(beyond <= BEYOND * max(1, needed.sum())))
    return min(kept, max(enough, round(k * LEAST), 1))


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, dims: int = 64, column: str = "embedding") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: one row for each vector of dims components that are all finite;
    other rows are left out, as are other columns.

    Components count as floor(scale * x). The codebook of each part starts as that part of the vectors with the smallest
    vec_ids (of repeated ones the smaller vector first, null vec_ids last; fewer vectors give fewer entries). In each round
    every part goes to its nearest entry (ties to the lower index) and an entry becomes the floor of the mean of its parts;
    an unused one stays. Then parts are assigned again. code has two hex digits for each part, error is the squared distance
    in all, label_error its sum over equal labels (nulls together). Repeated rows count each. No vectors, no rows.
    """
    spark, wide = vectors.sparkSession, dims // parts
    start = cut(scaled(vectors, column, scale, dims, F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label")), "vectors")
    first = start.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").collect()  # as many rows as entries
    if not first:
        return start.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))])
    k = len(first)
    books = np.array([r.x for r in first], np.int64).reshape(k, parts, wide).transpose(1, 0, 2).copy()
    kept = [min(k - 1, max(1, round(k * FIRST)))] * parts
    state = cut(start.mapInArrow(_assign(books, kept, None, None), _STATE + ", needed array<long>"), "bounds")
    for _ in range(rounds):
        each = state.select("x", "code").mapInArrow(_summed(parts, k, wide), "part long, entry long, n long, sums array<long>")
        new = books.copy()
        for r in each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(wide)]).collect():  # parts * entries rows
            new[r.part, r.entry] = mean_floor(list(r[3:]), r.n)
        moved = np.sqrt(((new - books) ** 2).sum(axis=2).astype(np.float64)) * (1 + SLACK)
        counted = state.where("needed is not null").select(F.posexplode("needed").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()
        needed = np.zeros(parts * (k + 1), np.int64)
        needed[[r.i for r in counted]] = [r.n for r in counted]
        before, books, last = kept, new, state
        if needed.any():  # the first search says nothing of what is needed
            kept = [_adapted(m, b, k) if m.any() else b for m, b in zip(needed.reshape(parts, k + 1), kept)]
        state = cut(last.drop("needed").mapInArrow(_assign(books, kept, moved, before), _STATE + ", needed array<long>"), "bounds")
        drop_cut(last)
    out = cut(state.mapInArrow(_coded(books), "vec_id long, label string, code string, error long"), "codes")
    drop_cut(state), drop_cut(start)
    by_label = small_or_not(cut(out.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")).withColumnRenamed("label", "_label")
    name = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return out.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(name).alias("codebooks_sha256"))
