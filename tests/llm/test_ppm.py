import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gleanframe.llm import ppm
from gleanframe.llm.common import table

ODD = [(None, "no id"), (1, None), (2, ""), (3, " \n\t"), (4, "Ab ab AB"), (4, "Ab ab AB"), (5, "é漢 x"), (6, "ab " * 3000), (7, "zq"), (8, "\x00\x01"), (-9, "banana bandana"), (11, "abracadabra abracadabra"), (12, "unseen ünseen")]


def _symbols(text):
    return [*(text or "").encode().lower(), 256]


class Brute:
    """Contexts as tuples, exclusion by sets."""

    def __init__(self, texts, order):
        self.order, self.follow = order, defaultdict(Counter)
        for t in texts:
            s = [256] * order + _symbols(t)
            for i in range(order, len(s)):
                for k in range(order + 1):
                    self.follow[tuple(s[i - k : i])][s[i]] += 1

    def p(self, context, symbol):
        out, seen = 1.0, set()
        for k in range(self.order, -1, -1):
            here = self.follow.get(tuple(context[len(context) - k :]))
            if here is None:
                continue
            new = {s: c for s, c in here.items() if s not in seen}
            whole = sum(new.values()) + len(new)
            if symbol in new:
                return out * new[symbol] / whole
            if new:
                out *= len(new) / whole
            seen |= set(here)
        return out / (257 - len(seen))

    def score(self, text):
        s = [256] * self.order + _symbols(text)
        return sum(math.log10(self.p(s[i - self.order : i], s[i])) for i in range(self.order, len(s)))


def _held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def _brute(rows, order):
    learned = [t for d, t in rows if not _held(d)]
    words = lambda t: [*(t or "").encode().lower().split(), None]
    counts = Counter(w for t in learned for w in words(t))
    total, model = sum(counts.values()), Brute(learned, order)
    for d, t in rows:
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in words(t))
        yield d, _held(d), len(words(t)), sum(counts[w] > 0 for w in words(t)), total, base, model.score(t), len(_symbols(t)) - 1


def _same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[7], r[6])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] + r[7:] for r in got] == [r[:5] + r[7:] for r in want]
    assert [x for r in got for x in r[5:7]] == pytest.approx([x for r in want for x in r[5:7]], rel=1e-9)


def test_probabilities_of_the_brute_force_sum_to_one():
    model = Brute(["abracadabra", "banana"], 3)
    for context in ([256] * 3, list(b"abr"), list(b"zzz"), list(b"zna")):
        assert sum(model.p(context, s) for s in range(257)) == pytest.approx(1)


@pytest.mark.parametrize("order,batch", [(5, 1 << 26), (5, 50), (2, 1)])
def test_odd_rows_as_brute_force(spark, monkeypatch, order, batch):
    monkeypatch.setattr(ppm, "STRETCH", 1000)
    monkeypatch.setattr(ppm, "KEYS", 100)
    docs = spark.createDataFrame([(*r, 1.0, "x") for r in ODD], "doc_id long, text string, score double, `a.batch` string").repartition(3)
    _same(ppm.lm_scores(docs, order, batch).collect(), _brute(ODD, order))


def test_joined_by_shuffle_alike(spark, monkeypatch):
    monkeypatch.setattr(ppm, "SMALL", 0)
    _same(ppm.lm_scores(spark.createDataFrame(ODD, "doc_id long, text string")).collect(), _brute(ODD, 5))


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = ppm.lm_scores(docs).collect()
    _same(got, _brute(rows, ppm.ORDER))
    short = {(r.doc_id, r.n_bytes): r.score for r in ppm.lm_scores(docs, order=1).collect()}
    unseen = [r for r in got if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in unseen) > 0.75 * sum(short[r.doc_id, r.n_bytes] for r in unseen)


def test_empty_table_and_no_training_texts(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ppm.lm_scores(docs).count() == 0
    out = next(d for d in range(100) if _held(d))
    got = ppm.lm_scores(spark.createDataFrame([(out, "ab")], "doc_id long, text string")).first()
    assert got.score == pytest.approx(3 * -math.log10(257)) and got.base_score == pytest.approx(0) and got.train_tokens == 0


def test_long_text_in_stretches(spark):
    text = "lorem ipsum dolor " * 150_000
    got = ppm.lm_scores(spark.createDataFrame([(1, text), (2, "lorem")], "doc_id long, text string")).where(F.col("doc_id") == 1).first()
    assert got.n_bytes == len(text) and got.n_tokens == 450_001 and got.score > -30_000
