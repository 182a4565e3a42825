import math
from itertools import product

import numpy as np
import pytest

from gleanframe.llm import toxicity as X
from gleanframe.llm.common import table


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    fit_on = labels.where("doc_id % 3 <> 0")
    return X.toxicity(docs, fit_on).toPandas().merge(labels.toPandas(), on="doc_id", suffixes=("", "_label")).merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")


def test_recall_by_language_on_all_labels_left_out(scored):
    held = scored[scored.doc_id % 3 == 0]
    line = held.severity[held.toxic_label == 0].quantile(0.9)  # a tenth of the others are false alarms
    bad = held[held.toxic_label == 1]
    recall = (bad.severity > line).groupby(bad.lang).mean().to_dict()
    print("recall at 10 % false alarms:", recall)
    assert (bad.severity > line).mean() > 0.93, recall
    assert recall["en"] > 0.95 and min(recall.values()) > 0.8, recall
    assert held.toxic[held.toxic_label == 0].mean() < 0.01 and held.toxic[held.toxic_label == 1].mean() > 0.7


def test_severity_is_the_sum_of_the_thresholds(scored):
    assert ((scored.severity >= scored.p_toxic - 1e-9) & (scored.severity <= X.GRADES * scored.p_toxic + 1e-9)).all()


def _plain_loss(docs, counts, grams, grade, w, t):
    """The likelihood written out, document by document."""
    total = X.RIDGE / 2 * sum(v * v for v in w.values())
    for at, n, g in zip(docs, counts, grade):
        x = [math.log1p(k) for k in n]
        norm = math.sqrt(sum(v * v for v in x)) or 1.0
        s = sum(v / norm * sum(w[b] for b in grams[i]) / math.sqrt(len(grams[i])) for i, v in zip(at, x))
        above = [1.0, *(1 / (1 + math.exp(k - s)) for k in t), 0.0]
        total -= math.log(above[g] - above[g + 1])
    return total


def test_likelihood_and_gradient_against_brute_force():
    rng = np.random.default_rng(3)
    grams = [[100 + i, *np.unique(rng.integers(0, 9, 4)).tolist()] for i in range(12)]
    docs = [np.unique(rng.integers(0, 12, 5)) for _ in range(20)]
    counts = [rng.integers(1, 4, len(d)) for d in docs]
    grade = rng.integers(0, X.GRADES + 1, 20)
    data = X.Training(docs, counts, grams, grade)
    w, t = rng.normal(size=len(data.buckets)), np.array([-0.5, 0.4, 1.3])
    none = {b: 0.0 for g in grams for b in g}
    plain = lambda w, t: _plain_loss(docs, counts, grams, grade, none | dict(zip(data.buckets.tolist(), w)), t)
    loss, by_w, by_t = data.loss(w, t)
    assert loss == pytest.approx(plain(w, t))
    for i, (which, got) in product(range(3), (("w", by_w), ("t", by_t))):
        e = np.zeros_like(w if which == "w" else t)
        e[i] = 1e-5
        numeric = (plain(w + e, t) - plain(w - e, t) if which == "w" else plain(w, t + e) - plain(w, t - e)) / 2e-5
        assert got[i] == pytest.approx(numeric, rel=1e-3, abs=1e-5)
    m = X.train(docs, counts, grams, grade)
    assert (np.diff(m.thresholds) > 0).all()
    assert data.loss(m.weights[data.buckets].astype(float), m.thresholds)[0] < data.loss(np.zeros(len(w)), np.array([-0.5, 0.0, 0.5]))[0]


def test_every_toxic_document_is_learned_from():
    docs = [np.array([0]), np.array([1]), np.array([2]), np.empty(0, np.int64)]
    assert (X.grades(docs, [np.ones(len(d), int) for d in docs], np.array([1, 0, 1, 1])) >= [1, 0, 1, 1]).all()


def test_words_share_their_parts():
    a, b, c = (set(X.features(w)) for w in ("verächtlich", "verächtlicher", "freundlich"))
    assert len(a & b) > 0.6 * len(a) and len(a & c) < 0.3 * len(a)
    assert len(X.features("é")) == 1


def test_odd_rows(spark):
    rows = [(i, "you idiot there" if i % 2 else "fine day there") for i in range(60)] + [(70, None), (71, ""), (72, "12 ?!"), (None, "idiot"), (73, "idiot " * 50_000), (1, "fine day there"), (74, "漢" * 20_000)]
    df = spark.createDataFrame([(*r, 3.0, "x") for r in rows], "doc_id long, text string, severity double, `a.b` string")
    labels = spark.createDataFrame([(i, i % 2, "y") for i in range(40)] + [(None, 1, ""), (41, None, ""), (42, 7, ""), (3, 0, "")], "doc_id long, toxic int, text string")
    got = {(r.doc_id, r.toxic) for r in X.toxicity(df, labels).collect()}
    assert {(70, False), (71, False), (72, False), (None, True), (73, True), (1, False), (1, True)} <= got
    assert X.toxicity(df.where("false"), labels).count() == 0
    assert X.toxicity(df, labels.where("false")).count() == len(rows)
