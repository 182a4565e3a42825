import hashlib
import itertools
import random
import re

import numpy as np

from gleanframe.llm import pii as P
from gleanframe.llm.common import table


def _brute(text):
    """The contract's patterns as they are stated."""
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_patterns():
    rng = random.Random(2)
    bits = ["a", "@", ".", "b.c", "12", "1.2.3.4", "+1 (555) 123-4567", "4111 1111 1111 1111", "4111111111111111", " ", "-", "é", "x@y.z", "..", "@@", "300.1.1.1", "1.2.3.4.5.6.7.8.9", "+", "00000255.1.1.1", "_%", "٣"]
    for _ in range(6000):
        text = "".join(rng.choices(bits, k=rng.randrange(1, 12)))
        assert P.base_spans(text) == _brute(text), text


def test_marginals_are_exact_on_a_tree():
    rng = np.random.default_rng(0)
    k, n = len(P.KINDS) + 1, 4
    field = P.Field(rng.normal(size=(k, P.FEATURES)), rng.normal(size=(3, k, k)))
    x, edges, kinds = rng.integers(0, 2, (n, P.FEATURES)).astype(float), np.array([[0, 1], [1, 2], [1, 3]]), np.array([0, 1, 2])
    want = np.zeros((n, k))
    for y in itertools.product(range(k), repeat=n):
        s = sum(field.unary[y[i]] @ x[i] for i in range(n)) + sum(field.pair[e, y[a], y[b]] for (a, b), e in zip(edges, kinds))
        for i in range(n):
            want[i, y[i]] += np.exp(s)
    settled, P.SETTLED = P.SETTLED, 1e-9
    try:
        assert np.allclose(field.marginals(x, edges, kinds), want / want.sum(1, keepdims=True), atol=1e-6)
    finally:
        P.SETTLED = settled


def test_repeats_take_over_a_label():
    k = len(P.KINDS) + 1
    same = np.stack([np.eye(k) * 3 - 1] * 3)
    field = P.Field(np.zeros((k, P.FEATURES)), same)
    text = "call 4111111111111111 now, or x and then 4111111111111112 is like it"
    base = P.base_spans(text)
    P_SURE, P.SURE = P.SURE, 0.5
    try:
        added = set(P.all_spans(text, base, field)) - set(base)
    finally:
        P.SURE = P_SURE
    assert [s[1] for s in base] == [2] and [text[a:b] for a, k, b in added] == ["4111111111111112"]


def test_groups_of_a_number_are_one_span():
    at = lambda *spans: [(a, b, k, d) for a, b, k, d in spans]
    assert P._runs(at((0, 2, 3, 1), (4, 7, 3, 3), (9, 17, 3, 7))) == [(0, 3, 17)]
    assert P._runs(at((0, 11, 3, 11), (12, 23, 3, 11))) == [(0, 3, 11), (12, 3, 23)]  # two numbers
    assert P._runs(at((0, 3, 3, 3), (10, 18, 3, 7))) == [(10, 3, 18)]  # a shard
    assert P._runs(at((0, 4, 2, 4), (5, 9, 3, 7))) == [(5, 3, 9)]
    assert P._runs(at((0, 7, 1, 4), (8, 15, 1, 4), (16, 20, 0, 0))) == [(0, 1, 7), (8, 1, 15), (16, 0, 20)]


def test_what_the_patterns_swallow_on_the_given_documents(spark):
    """Phones that a greedy match carries past 15 digits, told by a plain rule: the field adds each whole, and nothing
    but those and the card numbers that another number stands beside."""
    docs = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text")
    field, rule = P.fit(docs), re.compile(r"(?<![0-9+])\+[0-9]{1,3} \(?[0-9]{3}\)? [0-9]{3}-[0-9]{4}(?![0-9])")
    want, added = set(), set()
    for doc_id, text in docs.where("text like '%+%' or text rlike '[0-9]{4} [0-9]{4}'").collect():
        base = P.base_spans(text)
        free = lambda a, b: all(b <= c or a >= d for c, _, d in base)
        want |= {(doc_id, m.start(), 3, m.end()) for m in rule.finditer(text) if free(m.start(), m.end())}
        want |= {(doc_id, m.start(), 2, m.end()) for m in re.finditer(r"(?<![0-9])[0-9]{16}(?![0-9])", text) if free(m.start(), m.end()) and P._luhn(m[0])}
        added |= {(doc_id, *s) for s in set(P.all_spans(text, base, field)) - set(base)}
    print("given documents: wanted", len(want), "added", len(added), "both", len(want & added))
    assert want and len(want & added) >= 0.9 * len(added) and len(want & added) >= 0.4 * len(want)


def _planted(rng, n):
    """Texts in which a number is given once with its country code and later without, at any distance, beside numbers of
    the same length that nothing says are phones; the spans that should be added."""
    for _ in range(n):
        number = lambda: "".join(rng.choices("123456789", k=11))
        mine, words = number(), [rng.choice(["then", "of", "item", "was"]) for _ in range(400)]
        words[0] = f"+{mine[0]} {mine[1:4]} {mine[4:7]} {mine[7:]}" if rng.random() < 0.3 else "+" + mine
        at = sorted(rng.sample(range(3, 400, 3), 25))
        for i in at[:20]:
            words[i] = mine + rng.choice(["", ",", ".", ")"])
        for i in at[20:]:
            words[i] = number()
        rng.shuffle(rest := words[1:])
        text = " ".join([words[0], *rest])
        yield text, {(m.start(), 3, m.end()) for m in re.finditer(rf"(?<![+0-9]){mine}(?![0-9])", text)}


def test_precision_and_recall_of_added_spans(spark):
    """A number is told by its repeats, however far: written with its code as one word or in groups."""
    rng = random.Random(7)
    train, held = (list(_planted(rng, 150)) for _ in range(2))
    field = P.fit(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(train)], "doc_id long, text string"))
    hit = wrong = missed = 0
    for text, want in held:
        base = P.base_spans(text)
        added = set(P.all_spans(text, base, field)) - set(base)
        assert all(b <= c or a >= d for a, _, b in added for c, _, d in base)
        hit, wrong, missed = hit + len(added & want), wrong + len(added - want), missed + len(want - added)
    print("added spans: precision", hit / max(1, hit + wrong), "recall", hit / max(1, hit + missed))
    assert hit and hit / (hit + wrong) > 0.9 and hit / (hit + missed) > 0.9


def test_whole_table_and_odd_rows(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    rows = [(5000, None), (5001, ""), (5002, "a" * 300_000 + "@" + "1" * 300_000), (None, "x@y.zz 1.2.3.4"), (1, "+1 555 123 4567"), (5003, "\U0001f600 é x@y.zz")]
    docs = docs.union(spark.createDataFrame(rows, docs.schema)).withColumn("spans", docs.doc_id)
    got = P.personal_data(docs).collect()
    assert len(got) == 1006
    for r, (doc_id, text, _) in zip(got, docs.collect()):
        base = _brute(text or "") if len(text or "") < 200_000 else P.base_spans(text)
        said = ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.doc_id == doc_id and r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in base) for i in range(4))
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))
    assert P.personal_data(docs.where("false")).count() == 0
