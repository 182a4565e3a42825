import itertools
import random

import regex

from gleanframe.llm import decontaminate as D


def _tokens(t):
    return regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())


def _brute(docs, tests):
    out = {}
    for doc_id, text in docs:
        d, hit = _tokens(text), set()
        for item, t in tests:
            b = _tokens(t)
            w = min(len(b), D.WINDOW)
            if w < D.SPAN:
                continue
            for i, j in itertools.product(range(len(d) - w + 1), range(len(b) - w + 1)):
                if sum(x != y for x, y in zip(d[i : i + w], b[j : j + w])) <= (D.SUBSTITUTIONS if w == D.WINDOW else 1):
                    hit.add(min(k for k, u in tests if _tokens(u) == b))
                    break
        out[doc_id] = sorted(hit)
    return out


def test_no_window_escapes():
    def caught(length, changed):
        return any(not {o + p for p in m} & set(changed) for m in D.MASKS for o in range(length - max(m)))

    assert all(caught(D.WINDOW, c) for c in itertools.combinations(range(D.WINDOW), D.SUBSTITUTIONS))
    assert all(caught(n, [c]) for n in range(D.SPAN, D.WINDOW) for c in range(n))


def test_same_as_all_windows(spark, monkeypatch):
    rng = random.Random(4)
    vocab = ["the", "of", "Été", "x1", *(f"w{i}" for i in range(40))]
    tests = [(i, " ".join(rng.choices(vocab, k=rng.choice([3, 7, 8, 10, 12, 13, 20, 40])))) for i in range(30)] + [(30, None), (31, "")]
    tests.append((50, tests[5][1].upper() + "!"))
    docs = []
    for i in range(250):
        words = rng.choices(vocab, k=rng.choice([0, 5, 40, 100]))
        if rng.random() < 0.7:
            part = rng.choice(tests)[1] or ""
            part = part.split()[rng.choice([0, 0, 3]) :]
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                if part:
                    part[rng.randrange(len(part))] = "other"
            words[len(words) // 2 : len(words) // 2] = part
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(words)))
    bench = spark.createDataFrame([(*t, "x") for t in tests], "item_id long, text string, seed string")
    df = spark.createDataFrame([(*d, 1, "y") for d in docs], "doc_id long, text string, item int, p string")
    want = _brute(docs, tests)
    for seeds in (D.SEEDS, 300):
        monkeypatch.setattr(D, "SEEDS", seeds)
        got = {r.doc_id: r.item_ids for r in D.decontaminate(df, bench).collect()}
        assert got == want and sum(map(bool, want.values())) > 50


def test_odd_rows(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    bench = spark.createDataFrame([(1, text), (None, "a b c d e f g h i j k l m n"), (2, None)], "item_id long, text string")
    rows = [(1, None), (2, ""), (3, "word " * 30_000 + text), (4, text), (4, text), (4, "clean"), (None, text), (5, "a b c d e f g h i j k l m n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.contaminated, r.overlap_tokens) for r in D.decontaminate(df, bench).collect())
    assert got == [(0, True, 14), (1, False, 0), (2, False, 0), (3, True, 14), (4, False, 0), (4, True, 14), (4, True, 14), (5, False, 0)]
    assert D.decontaminate(df.where("false"), bench).count() == 0
    assert {r.contaminated for r in D.decontaminate(df, bench.where("false")).collect()} == {False}


def test_clean_rows_keep_odd_columns(spark):
    from gleanframe.llm.decontaminate import clean

    words = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"x {words} y", 1, "p"), (1, "fine", 2, "q"), (None, words, 3, "r"), (2, None, 4, "s"), (3, "", 5, "t")], "doc_id long, text string, `a.b` int, item string")
    got = clean(docs, spark.createDataFrame([(7, words)], "item_id long, text string"))
    assert got.columns == docs.columns
    assert sorted(r["a.b"] for r in got.collect()) == [2, 4, 5]


def test_a_long_text_of_many_hits_is_not_held_once_for_each(spark):
    passage = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(passage * 200)), (2, " ".join([*["x"] * 600, *passage[:13], *["y"] * 495, *passage[50:63], "z"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(passage))], "item_id long, text string")
    got = {r.doc_id: (r.item_ids, r.overlap_tokens) for r in D.decontaminate(df, bench).collect()}
    assert got == {1: ([7], 100), 2: ([7], 13)}
