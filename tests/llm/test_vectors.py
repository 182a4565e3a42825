import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanframe.llm import bounds, threshold
from gleanframe.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, x string, `a.code` int"


def _rows(spark, n=None, dims=64):
    rng = np.random.default_rng(5)
    centre = rng.normal(0, 0.3, (7, dims))
    rows = [(int(i), [float(np.float32(c)) for c in centre[i % 7] + rng.normal(0, 0.05, dims)], int(i % 5) if i % 4 else None, None, 1) for i in range(100, 300)]
    rows += [rows[3], rows[3], (2, rows[9][1], 1, "x", 2), (2, rows[8][1], 1, "x", 2), (None, rows[20][1], None, None, None)]
    rows += [(1, None, 1, "", 1), (3, [], 1, "", 1), (4, [1.0] * 63 + [None], 1, "", 1), (5, [1.0] * 63 + [float("nan")], 1, "", 1), (6, [float("-inf")] + [0.0] * 63, 1, "", 1), (7, [0.5] * 63, 1, "", 1)]
    rows += [(8, [float(v)] * 64, 9, "", 1) for v in (0, 0.5, -0.25)]
    return rows if n is None else rows[:n]


def _kept(rows, scale):
    ok = [(r[0], np.floor(np.array(r[1], np.float64) * scale).astype(int).tolist(), r[2]) for r in rows if r[1] is not None and len(r[1]) == 64 and None not in r[1] and np.isfinite(r[1]).all()]
    return ok


def _codes(rows, parts=8, k=16, rounds=6):
    ok = sorted(_kept(rows, 4096), key=lambda r: (r[0] is None, r[0], r[1]))
    x = np.array([r[1] for r in ok]).reshape(len(ok), parts, -1)
    books = x[:k].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        d = np.stack([((x[:, p, None, :] - books[p]) ** 2).sum(2) for p in range(parts)], axis=1)
        code = d.argmin(2)
        if turn < rounds:
            for p in range(parts):
                for e in set(code[:, p].tolist()):
                    mine = x[code[:, p] == e, p]
                    books[p, e] = [int(s) // len(mine) for s in mine.sum(0)]
    name = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    error, by_label = d.min(2).sum(1).tolist(), {}
    for r, e in zip(ok, error):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    return [(r[0], "".join(f"{c:02x}" for c in row), e, by_label[r[2]], name) for r, row, e in zip(ok, code.tolist(), error)]


def _clusters(rows, k=16, rounds=3):
    ok = _kept(rows, 64)
    x = np.array([r[1] for r in ok])
    drawn = [hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else None for r in ok]
    first = sorted(range(len(ok)), key=lambda i: (drawn[i] is None, drawn[i], ok[i][1]))[:k]
    c = x[first].copy()
    for turn in range(rounds + 1):
        d = ((x[:, None] - c) ** 2).sum(2)
        who = d.argmin(1)
        for j in set(who.tolist()) if turn < rounds else ():
            c[j] = [int(s) // int((who == j).sum()) for s in x[who == j].sum(0)]
    far = d.min(1)
    name = [hashlib.sha256(",".join(map(str, e.tolist())).encode()).hexdigest() for e in c]
    return [(r[0], int(j), int(f), int(far[who == j].sum()), int(far.sum()), name[j]) for r, j, f in zip(ok, who, far)]


def _sorted(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("n", [None, 9, 1])
def test_codes_as_brute_force(spark, n):
    rows = _rows(spark, n)
    got = bounds.vector_codes(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert _sorted(got.collect()) == _sorted(_codes(rows))


@pytest.mark.parametrize("n", [None, 9, 1])
def test_clusters_as_brute_force(spark, n):
    rows = _rows(spark, n)
    got = threshold.clusters(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert _sorted(got.collect()) == _sorted(_clusters(rows))


def test_whole_tables(spark):
    t = table(spark, SF.replace("0.001", "0.1"), "embeddings")
    rows = [tuple(r) for r in t.select("vec_id", "embedding", "label").collect()]
    assert _sorted(bounds.vector_codes(t).collect()) == _sorted(_codes(rows))
    assert _sorted(threshold.clusters(t).collect()) == _sorted(_clusters(rows))


def test_nothing_in_nothing_out(spark):
    none = spark.createDataFrame([], SCHEMA)
    for run in (bounds.vector_codes, threshold.clusters):
        assert run(none).count() == 0 == run(spark.createDataFrame([(1, None, 1, "", 1)], SCHEMA)).count()


def test_what_is_too_large_is_an_error(spark):
    huge = spark.createDataFrame([(1, [1e30] * 64, 1, "", 1)], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        threshold.clusters(huge).collect()


def test_bounds_hold_and_spare_comparisons():
    rng = np.random.default_rng(1)
    x = (rng.normal(0, 1, (3000, 8)) + rng.integers(0, 9, (3000, 1)) * 4).round(2) * 100 // 1
    x, books = x.astype(np.int64), x[:16].astype(np.int64)
    part, b = bounds.Part(x, books), 4
    part.start(b)
    for turn in range(8):
        new = books.copy()
        for e in range(16):
            if (part.code == e).any():
                new[e] = x[part.code == e].sum(0) // (part.code == e).sum()
        moved = np.sqrt(((new - books) ** 2).sum(1)) * (1 + bounds.SLACK)
        last, books, part = part, new, bounds.Part(x, new)
        part.move(last.code, last.upper, last.near, last.low, moved, b)
        d = ((x[:, None] - books) ** 2).sum(2)
        assert (part.code == d.argmin(1)).all()
        far = np.sqrt(d)
        assert (part.upper >= far[np.arange(len(x)), part.code]).all()
        assert (part.low[:, :-1] <= np.take_along_axis(far, part.near, 1)).all() and (np.diff(part.low, axis=1) >= 0).all()
        far[np.arange(len(x)), part.code] = np.inf
        np.put_along_axis(far, part.near.astype(np.int64), np.inf, 1)
        assert (part.low[:, -1] <= far.min(1)).all()
        b = bounds._adapted(part.needed, b, 16)
    assert part.needed[0] > 0.5 * len(x) and b <= 4


def test_walks_end_early_and_see_ties():
    rng = np.random.default_rng(2)
    c = rng.integers(-50, 50, (40, 3)) * np.array([30, 1, 1])
    c[7] = c[3]  # a tie at every vector
    x = c[rng.integers(0, 40, 2000)] + rng.integers(-3, 4, (2000, 3))
    nearest = threshold.Nearest(c)
    who, far = nearest.of(x)
    d = ((x[:, None] - c) ** 2).sum(2)
    assert (who == d.argmin(1)).all() and (far == d.min(1)).all()
    assert nearest.exact < 0.5 * d.size
