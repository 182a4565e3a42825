"""Toxicity by cumulative-link ordinal regression on sparse features of words and parts of words.

P(grade > k) = sigmoid(w.x - t_k) with one weight vector for all thresholds t_1 < t_2 < ...; the expected severity is
the sum of these probabilities. Labels say toxic or not; a toxic training document's grade, 1 at least, comes from how
densely it uses the words that toxic documents use far more than others do.

A word's features are the word itself and its character n-grams, so that inflected and compound forms share weights. A
text's score is then the sum of its different words' own scores, each times log(1 + count), divided by the length of
the vector of these logarithms.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_batches, small_or_not

#: Buckets of features; labelled documents used (on average, drawn by a hash of doc_id); grades above 0.
BUCKETS, SAMPLE, GRADES = 1 << 20, 6_000, 3
#: Lengths of a word's character n-grams, its two ends marked.
SHORTEST, LONGEST = 5, 7
#: A word marks toxic documents if it is so many times likelier in them, by the lower end of its error band, and at
#: least in so many.
MARK_RATIO, MARK_DOCS = 3.0, 3
#: Gradient steps at most, their length at first, and the weight of squared weights.
STEPS, RATE, RIDGE = 100, 5.0, 0.02
_WORD = re.compile(r"[^\W\d_]+")
_MAX_WORDS, _MAX_CHARS = 200_000, 8_000_000


def words(text: str | None) -> Counter:
    """The runs of letters of a text, lower-cased, and how often each occurs."""
    return Counter(_WORD.findall((text or "").lower()))


def features(word: str) -> list[int]:
    """Buckets of a word, marked at its ends (first), and of its n-grams; each counts as one over the root of their number."""
    s = f"<{word}>".encode("utf-32-le", "surrogatepass")
    parts = {s[4 * i : 4 * (i + n)] for n in range(SHORTEST, LONGEST + 1) for i in range(len(s) // 4 - n + 1)}
    whole = xxhash.xxh3_64_intdigest(s) % BUCKETS
    return [whole, *sorted({xxhash.xxh3_64_intdigest(p) % BUCKETS for p in parts} - {whole})]


class Model:
    """weights by bucket, and the thresholds in rising order."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights.astype(np.float32), thresholds

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score (rows) and threshold (columns)."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


class _WordScores(dict):
    """word -> its part of the score; forgets all when it gets large. Lives as long as a task."""

    def __init__(self, model: Model):
        self.model, self.chars = model, 0

    def __missing__(self, word: str) -> float:
        if len(self) >= _MAX_WORDS or self.chars >= _MAX_CHARS:
            self.clear()
            self.chars = 0
        at = features(word)
        self.chars += len(word)
        self[word] = score = float(self.model.weights[at].sum()) / len(at) ** 0.5
        return score


def score(text: str | None, scores: _WordScores) -> float | None:
    """None for texts without a word."""
    counts = words(text)
    if not counts:
        return None
    x = np.log1p(np.fromiter(counts.values(), float, len(counts)))
    return float(x @ np.fromiter(map(scores.__getitem__, counts), float, len(counts)) / np.sqrt(x @ x))


class Training:
    """Documents as (row, word, x) and words as (word, bucket, x); weights are of the buckets that can be told apart.

    n-grams that a single word has say no more than the word itself, and get no weight.
    """

    def __init__(self, docs: list[np.ndarray], counts: list[np.ndarray], vocabulary: list[list[int]], grade: np.ndarray):
        """docs: numbers of different words, of whose features vocabulary gives the buckets (an iterable will do);
        counts: how often each occurs."""
        self.n, self.grade = len(docs), grade
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), list(map(len, docs)))
        self.word = np.concatenate([*docs, np.empty(0, np.int32)]).astype(np.int32)
        x = np.log1p(np.concatenate([*counts, np.empty(0)]).astype(float))
        self.x = x / np.sqrt(np.maximum(np.bincount(self.row, x * x, minlength=max(1, self.n)), 1e-9))[self.row]
        flat, sizes = array("i"), array("i")
        for buckets in vocabulary:
            flat.extend(buckets)
            sizes.append(len(buckets))
        flat, sizes = np.array(flat, np.int32), np.array(sizes, np.int32)
        self.n_words = len(sizes)
        keep = np.bincount(flat, minlength=BUCKETS)[flat] > 1
        keep[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        self.of = np.repeat(np.arange(self.n_words, dtype=np.int32), sizes)[keep]
        self.part = (1 / np.sqrt(np.maximum(sizes, 1)))[self.of]
        self.buckets, self.gram = np.unique(flat[keep], return_inverse=True)

    def scores(self, w: np.ndarray) -> np.ndarray:
        by_word = np.bincount(self.of, w[self.gram] * self.part, minlength=self.n_words)
        return np.bincount(self.row, by_word[self.word] * self.x, minlength=self.n)

    def loss(self, w: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The sum of -log P(grade) over documents and half the weighted squares of w, and its gradients by w and t."""
        above = np.concatenate([np.ones((self.n, 1)), _sigmoid(self.scores(w)[:, None] - t), np.zeros((self.n, 1))], 1)
        rows = np.arange(self.n)
        low, high = above[rows, self.grade], above[rows, self.grade + 1]
        p = np.maximum(low - high, 1e-12)
        by_word = np.bincount(self.word, self.x * (low + high - 1)[self.row], minlength=self.n_words)
        by_w = np.bincount(self.gram, by_word[self.of] * self.part, minlength=len(w))
        slope = above[:, 1:-1] * (1 - above[:, 1:-1]) / p[:, None]
        k = np.arange(len(t))
        by_t = (slope * ((self.grade[:, None] == k + 1).astype(float) - (self.grade[:, None] == k))).sum(0)
        return float(-np.log(p).sum() + RIDGE / 2 * (w @ w)), by_w + RIDGE * w, by_t


def grades(docs: list[np.ndarray], counts: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """0 for other documents; 1 to GRADES for toxic ones, by thirds of their density of marking words (none: 1)."""
    at, words_seen = np.concatenate([*docs, np.empty(0, np.int64)]).astype(np.int64), max((int(d.max()) + 1 for d in docs if len(d)), default=0)
    of = np.repeat(toxic, list(map(len, docs)))
    yes, no = np.bincount(at[of == 1], minlength=words_seen), np.bincount(at[of == 0], minlength=words_seen)
    bad, good = max(1, int((toxic == 1).sum())), max(1, int((toxic == 0).sum()))
    ratio = np.log((yes + 0.5) / bad) - np.log((no + 0.5) / good)
    marks = (yes >= MARK_DOCS) & (ratio - 2 * np.sqrt(1 / (yes + 0.5) + 1 / (no + 0.5)) > np.log(MARK_RATIO))
    density = np.array([n[marks[d]].sum() / max(1, n.sum()) for d, n in zip(docs, counts)])
    out, mine = np.zeros(len(docs), np.int64), density[(toxic == 1) & (density > 0)]
    cuts = np.quantile(mine, np.arange(1, GRADES) / GRADES) if len(mine) else np.zeros(GRADES - 1)
    out[toxic == 1] = 1 + np.searchsorted(cuts, density[toxic == 1], side="left")
    return out


def train(docs: list[np.ndarray], counts: list[np.ndarray], vocabulary: list[list[int]], grade: np.ndarray) -> Model:
    """Scaled gradient descent with momentum; steps that make the loss larger are taken back and halved."""
    data = Training(docs, counts, vocabulary, grade)
    goal = (grade[:, None] > np.arange(GRADES)[None, :]).mean(0) if len(docs) else np.full(GRADES, 0.5)
    share = np.clip(goal, 1e-3, 1 - 1e-3)
    gap = 1e-3 * np.arange(GRADES)  # thresholds stay apart
    w, t, rate = np.zeros(len(data.buckets)), np.maximum.accumulate(np.log((1 - share) / share) - gap) + gap, RATE
    seen = np.bincount(data.word, minlength=data.n_words)
    scale = 4 / np.sqrt(np.bincount(data.gram, seen[data.of] * data.part**2, minlength=len(w)) + 10) / np.sqrt(max(1, data.n))
    best = (np.inf, w, t)
    speed_w, speed_t = np.zeros_like(w), np.zeros_like(t)
    for _ in range(STEPS if len(docs) else 0):
        loss, by_w, by_t = data.loss(w, t)
        if loss > best[0] + 1e-3 * data.n:
            _, w, t = best
            rate, speed_w, speed_t = rate / 2, np.zeros_like(w), np.zeros_like(t)
            continue
        best = min(best, (loss, w, t), key=lambda b: b[0])
        speed_w = 0.9 * speed_w - rate * by_w * scale
        speed_t = 0.9 * speed_t - min(rate, 1.0) * by_t / data.n
        w, t = w + speed_w, np.maximum.accumulate(t + speed_t - gap) + gap
    weights = np.zeros(BUCKETS)
    weights[data.buckets] = best[1]
    return Model(weights, best[2])


def _sampled(batches):
    """Hashes of each document's words, their counts, and the words that this task has not named before."""
    known: set[str] = set()
    for batch in batches:
        found = [words(t) for t in batch.column(0).to_pylist()]
        fresh = []
        for counts in found:
            fresh.append([w for w in counts if w not in known])
            known.update(fresh[-1])
        at = [[xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) - (1 << 63) for w in c] for c in found]
        columns = [pa.array(at, pa.list_(pa.int64())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32())), pa.array([[w.encode("utf-8", "surrogatepass") for w in f] for f in fresh], pa.list_(pa.binary())), batch.column(1)]
        yield pa.RecordBatch.from_arrays(columns, names=["at", "n", "fresh", "toxic"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """labels: doc_id, toxic (0 or 1; others and nulls are left out; the larger of a doc_id's labels holds). About
    `sample` labelled documents count, all of these; their words come to the driver."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    rate = min(1.0, sample / max(1, known.count()))
    drawn = cut(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(rate * 1_000_000)), "judged")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(small_or_not(drawn), "doc_id").select("text", "toxic")
    got = rows.mapInArrow(_sampled, "at array<long>, n array<int>, fresh array<binary>, toxic long").toArrow()
    vocabulary = sorted({w.as_py() for part in got.column("fresh").chunks for w in part.values})
    hashes = np.array([xxhash.xxh3_64_intdigest(w) - (1 << 63) for w in vocabulary], np.int64)
    order = np.argsort(hashes).astype(np.int32)
    take = lambda c: [v.values.to_numpy() for v in got.column(c)]
    docs_at = [order[np.searchsorted(hashes, at, sorter=order)] for at in take("at")]
    counts, toxic = take("n"), got.column("toxic").to_numpy()
    # whatever order rows and words came in
    sort = [np.argsort(at) for at in docs_at]
    docs_at, counts = [at[s] for at, s in zip(docs_at, sort)], [n[s] for n, s in zip(counts, sort)]
    rows_by = sorted(range(len(docs_at)), key=lambda i: (docs_at[i].tobytes(), counts[i].tobytes(), toxic[i]))
    docs_at, counts, toxic = [docs_at[i] for i in rows_by], [counts[i] for i in rows_by], toxic[rows_by]
    return train(docs_at, counts, (features(w.decode("utf-8", "surrogatepass")) for w in vocabulary), grades(docs_at, counts, toxic))


def severity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (0 to GRADES), grade (the likeliest), toxic (grade over 0 is likelier than not), p_toxic.

    One row for each row of docs, other columns are left out; texts without a word, and null ones, have severity 0.
    Rows that repeat a doc_id are judged each by its own text, of whatever length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        known = _WordScores(m)
        for batch in batches:
            found = [score(text.as_py(), known) for text in batch.column(1)]
            empty = np.array([s is None for s in found], bool)
            above = m.above(np.array([s or 0.0 for s in found])) * ~empty[:, None]
            each = np.concatenate([1 - above[:, :1], above[:, :-1] - above[:, 1:], above[:, -1:]], 1)
            columns = [pa.array(above.sum(1)), pa.array(each.argmax(1)), pa.array(above[:, 0] > 0.5), pa.array(above[:, 0])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "severity", "grade", "toxic", "p_toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(docs).select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, severity double, grade long, toxic boolean, p_toxic double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """severity of docs by a model of the documents that labels has. No usable label: severity is the same for all."""
    return severity(docs, fit(docs, labels))
