import numpy as np

from gleanframe.llm import mixing as M
from gleanframe.llm.common import table
from gleanframe.llm.queries import MIX, domain_labels


def test_totals_match_targets(spark):
    docs, sf = table(spark, "/root/testdata/sf0.01", "documents"), "/root/testdata/sf0.01"
    out = M.mix(docs, domain_labels(table(spark, sf, "labels")), MIX).toPandas()
    assert len(out) == docs.count() and (out.rate >= 0).all()
    total = out.n_tokens.sum()
    for d, share in MIX.items():
        assert abs((out.rate * out.n_tokens * out[f"p_{d}"]).sum() / total - share) < 0.005  # by posteriors as they are
    assert np.allclose(out[[f"p_{d}" for d in MIX]].sum(axis=1), 1)
    assert abs(out.copies.sum() - out.rate.sum()) < 4 * np.sqrt(len(out))
    labelled = out.merge(domain_labels(table(spark, sf, "labels")).toPandas(), on="doc_id")
    assert (labelled[["p_good", "p_poor", "p_toxic"]].idxmax(axis=1) == "p_" + labelled.domain).mean() > 0.8


def test_rates_are_the_least_squares_solution(spark):
    rng = np.random.default_rng(3)
    q = rng.multinomial(M.GRID, [0.6, 0.3, 0.1], 40)
    q = np.unique(np.concatenate([q, [[64, 0, 0], [0, 64, 0], [0, 10, 54]]]), axis=0)
    tokens = rng.integers(10, 1000, len(q))
    target = tokens.sum() * np.array([0.5, 0.1, 0.4])
    # the documents of a cell have posteriors of their own near its rounded ones
    p = np.maximum(0, q / M.GRID + rng.uniform(-0.5, 0.5, q.shape) / M.GRID)
    p /= p.sum(axis=1, keepdims=True)
    groups = spark.createDataFrame([(*map(int, r), int(t), *map(float, t * x)) for r, t, x in zip(q, tokens, p)], "q0 int, q1 int, q2 int, tokens long, m0 double, m1 double, m2 double")
    rows = M.fit_rates(groups, target.tolist(), 120).toPandas()
    got = rows.rate.to_numpy()
    p, w = rows[["m0", "m1", "m2"]].to_numpy() / rows[["tokens"]].to_numpy(), rows.tokens.to_numpy() / rows.tokens.sum()
    mass = w @ p
    cost = lambda r: (((w * r) @ p - target / tokens.sum()) ** 2 / mass).sum() + M.CLOSENESS * (w * (r - 1) ** 2).sum()
    want = np.ones(len(got))
    for _ in range(60_000):
        want = np.maximum(0, want - (p @ (((w * want) @ p - target / tokens.sum()) / mass) + M.CLOSENESS * (want - 1)) / 1.001)
    assert (got >= 0).all() and cost(got) < cost(want) + 1e-5 and np.abs(got - want).max() < 0.2


def test_odd_rows(spark):
    rows = [(i, "good word here" if i % 2 else "bad thing there") for i in range(40)] + [(50, None), (51, ""), (None, "good word"), (3, "good word here"), (3, "other"), (52, "long " * 40_000)]
    df = spark.createDataFrame([(*r, 1, "x", 2, 3, "y") for r in rows], "doc_id long, text string, q0 int, bucket string, rate int, copies int, `a.b` string")
    labels = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(0, 30)] + [(None, "a"), (31, None), (32, "zz"), (1, "a"), (1, "b")], "doc_id long, domain string")
    out = M.mix(df, labels, {"a": 3.0, "b": 1.0}).toPandas()
    assert len(out) == len({(d, t) for d, t in rows}) and out.n_tokens[out.doc_id == 52].item() == 40_000
    assert set(out.n_tokens[out.doc_id.isin([50, 51])]) == {0}
    kept = M.mixed(df, labels, {"a": 3.0, "b": 1.0})
    assert kept.columns == df.columns and set(kept.collect()) <= set(df.collect())
    assert M.mix(df.where("false"), labels, {"a": 1.0}).count() == 0
    assert M.mix(df, labels.where("false"), {"a": 1.0, "b": 1.0}).count() == len(out)


def test_posteriors_against_a_plain_classifier(spark):
    """Naive Bayes written out, on a small table."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["a", "b", "c", "d"], 6, p=[0.5, 0.3, 0.1, 0.1] if i % 2 else [0.1, 0.1, 0.4, 0.4])) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, "xy"[i % 2]) for i in range(30)], "doc_id long, domain string")
    counts = {d: {w: sum(t.split().count(w) for i, t in enumerate(texts[:30]) if "xy"[i % 2] == d) for w in "abcd"} for d in "xy"}
    got = {r.doc_id: r for r in M.mix(docs, labels, {"x": 1.0, "y": 1.0}).collect()}
    for i, t in enumerate(texts):
        log = {d: np.log(16 / 32) + np.mean([np.log((counts[d][w] + M.PSEUDO) / (sum(counts[d].values()) + M.PSEUDO * M.BUCKETS)) for w in t.split()]) * 6**M.EVIDENCE for d in "xy"}
        assert abs(got[i].p_x - 1 / (1 + np.exp(log["y"] - log["x"]))) < 1e-9
