"""Language identification by bit-sliced Bloom filters of character n-grams.

Each slot of one table holds a bit for every language; the AND of an n-gram's slots is the set of all languages that
contain it. A text's score for a language is the part of its n-grams that the language contains, corrected for the
filter's false positives.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, in_batches, parts
from .shingles import mix

#: Characters of an n-gram; white space and all else that isn't a letter is one blank.
GRAM = 3
#: n-grams that a language keeps, slots of the table, slots that an n-gram sets.
KEEP, SLOTS, HASHES = 3000, 1 << 18, 2
UNKNOWN = "und"
#: A text is like none of a language below that part of the score which this quantile of its training documents has.
PART, LOW = 0.75, 0.05


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts, how many each text has, and whether it has a letter.

    An n-gram of blanks alone counts as none; a text is taken with a blank at either end.
    """
    points = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32) if t else np.full(2, 32, np.uint32) for t in texts]
    sizes = np.fromiter(map(len, points), np.int64, len(points))
    ends = np.cumsum(sizes)
    c = np.concatenate([*points, np.empty(0, np.uint32)])
    letter = _letters()[c]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of others, the first stands for all
    keep[ends - sizes] = True
    c = np.where(letter, c, 32)[keep].astype(np.uint64)
    per = np.add.reduceat(keep, ends - sizes, dtype=np.int64) if len(texts) else sizes
    has = np.add.reduceat(letter, ends - sizes, dtype=np.int64) > 0 if len(texts) else sizes > 0
    c, per = np.concatenate([c, np.full(GRAM, 32, np.uint64)]), np.maximum(per - GRAM + 1, 0) * has
    h = c[: len(c) - GRAM + 1].copy()
    for i in range(1, GRAM):
        h = (h << np.uint64(21)) | c[i : len(c) - GRAM + 1 + i]
    kept = np.add.reduceat(keep, ends - sizes, dtype=np.int64) if len(texts) else sizes
    begins = np.cumsum(kept) - kept
    at = np.repeat(begins - (np.cumsum(per) - per), per) + np.arange(per.sum())
    return h[at], per, has


def _slots(h: np.ndarray) -> list[np.ndarray]:
    mixed = mix(h)
    return [((mixed >> np.uint64(32 * i)) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(HASHES)]


def _count(batches):
    for batch in batches:
        for a, b in parts(batch.column(1)):
            langs = np.array(batch.column(0)[a:b].to_pylist(), object)
            texts = batch.column(1)[a:b].to_pylist()
            for lang in sorted(set(langs)):
                found, n = np.unique(grams([texts[i] for i in np.flatnonzero(langs == lang)])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
    give_back()


class Filters:
    """Of each language in order: its bit in the table's slots, and how often the filter errs."""

    def __init__(self, languages: list[str], kept: dict[str, np.ndarray]):
        self.languages = languages
        self.table = np.zeros((SLOTS, max(1, -(-len(languages) // 8))), np.uint8)
        for i, lang in enumerate(languages):
            for slots in _slots(kept[lang].view(np.uint64)):
                self.table[slots, i // 8] |= np.uint8(1 << i % 8)
        self.errs = np.array([((self.table[:, i // 8] >> (i % 8)) & 1).mean() ** HASHES for i in range(len(languages))])

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, language) -> corrected part of n-grams, 0 to 1; and whether each text has a letter."""
        h, per, has = grams(texts)
        masks = np.bitwise_and.reduce([self.table[s] for s in _slots(h)]) if len(h) else np.zeros((0, self.table.shape[1]), np.uint8)
        text = np.repeat(np.arange(len(texts)), per)
        out = np.zeros((len(texts), len(self.languages)))
        for i, err in enumerate(self.errs):
            hits = np.bincount(text, (masks[:, i // 8] >> (i % 8)) & 1, minlength=len(texts))
            out[:, i] = np.clip((hits / np.maximum(per, 1) - err) / max(1 - err, 1e-9), 0, 1)
        return out, has


def held_out():
    """No training document: the contract's fold, and documents without a doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))


def _known(docs: DataFrame) -> DataFrame:
    """The training fold (doc_id, text, lang)."""
    return docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))


def fit(docs: DataFrame) -> Filters:
    """Filters of all languages that training documents of docs (doc_id, text, lang) are labelled with.

    Every training document counts; to the driver come KEEP n-grams for each language.
    """
    known = _known(docs)
    counted = in_batches(known).select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    # as many rows as languages: one may have documents, but no n-gram
    best: dict[str, list[int]] = {r.lang: [] for r in known.select("lang").distinct().collect()}
    for lang, gram in counted.withColumn("place", first).where(F.col("place") <= KEEP).select("lang", "gram").collect() if best else []:
        best[lang].append(gram)
    return Filters(sorted(best), {k: np.array(sorted(v), np.int64) for k, v in best.items()})


def _judge(docs: DataFrame, filters: Filters):
    """A column over texts: struct(lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = shared.value
        names = np.array([*f.languages, UNKNOWN], object)
        for texts in batches:
            found, top = np.empty(len(texts), object), np.zeros(len(texts))
            for a, b in parts(texts):
                scores, has = f.scores(texts[a:b].to_pylist())
                found[a:b] = names[np.where(has, scores.argmax(1), len(f.languages)) if f.languages else np.zeros(b - a, np.int64)]
                top[a:b] = scores.max(1, initial=0) * has
            yield pa.StructArray.from_arrays([pa.array(found.tolist(), pa.string()), pa.array(top)], names=["lang_pred", "score"])
        give_back()

    return F.arrow_udf(run, "struct<lang_pred:string,score:double>")(F.col("text").cast("string"))


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """docs without text, with lang_pred and score (which replace columns of these names).

    Null texts and texts without a letter are `und` with score 0, as are all if no language was learned; of equal scores
    the first language by name decides. Each row is judged by its own whole text, so rows that repeat a doc_id may differ;
    no rows, no result.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "lang_pred", "score")]
    judged = in_batches(docs).select(*kept, _judge(docs, filters).alias("_judged"))
    return judged.select(*kept, F.col("_judged")["lang_pred"].alias("lang_pred"), F.col("_judged")["score"].alias("score"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the training fold of docs, predicted for every row of it."""
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), fit(docs))


def thresholds(docs: DataFrame, least: float = 0.1) -> dict[str, float]:
    """Language -> the score below which a text is like none of it: from the scores that all of one half of the training
    fold has by filters learned from all of the other half.

    A language without such scores takes the lowest threshold of the others.
    """
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0
    scored = predict(_known(docs.where(~half)), fit(docs.where(half))).where("lang_pred = lang")
    # scores to six digits, counted: the quantile is of every score, and a language's counts are bounded
    each = scored.groupBy("lang", F.round("score", 6).alias("score")).agg(F.count("*").alias("n"))
    by_lang = Window.partitionBy("lang")
    ranked = each.select("lang", "score", F.sum("n").over(by_lang.orderBy("score")).alias("upto"), F.sum("n").over(by_lang).alias("all"))
    found = ranked.where(F.col("upto") >= F.ceil(F.col("all") * F.lit(LOW))).groupBy("lang").agg(F.min("score").alias("low"))
    out = {r.lang: max(least, PART * r.low) for r in found.collect()}
    return {"": min(out.values(), default=least), **out}


def recognised(docs: DataFrame, least: float = 0.1) -> DataFrame:
    """The rows of docs whose language is one of those learned from it, by a part of their n-grams that is usual for its
    training documents (`thresholds`), and this part at least. All columns stay, whatever their names; texts of any
    length are judged whole; null texts and texts without a letter go, and so do all if there is nothing to learn from."""
    lines = thresholds(docs, least)
    judged = _judge(docs, fit(docs))
    line = F.coalesce(F.create_map(*[F.lit(x) for kv in lines.items() for x in kv])[judged["lang_pred"]], F.lit(lines[""]))
    return in_batches(docs).where((judged["lang_pred"] != UNKNOWN) & (judged["score"] >= line))
