import random
import zlib

import numpy as np

from gleanframe.llm import language
from gleanframe.llm.common import table


def test_grams_one_by_one():
    texts = ["Ab, c!! d", "", None, "12 34", "x", "\U00020000é", "a-b"]
    h, per, has = language.grams(texts)
    want = []
    for t in texts:
        s = "".join(c if c.isalpha() else " " for c in f" {(t or '').lower()} ")
        s = " " + " ".join(s.split()) + " "
        mine = [sum(ord(s[i + j]) << 21 * (2 - j) for j in range(3)) for i in range(len(s) - 2)] if s.strip() else []
        want.append(mine)
    assert per.tolist() == list(map(len, want)) and h.tolist() == sum(want, [])
    assert has.tolist() == [True, False, False, False, True, True, True]


def test_filters_hold_all_and_err_as_stated():
    rng = np.random.default_rng(0)
    kept = {f"l{i:02}": rng.integers(0, 2**62, 3000) for i in range(11)}
    f = language.Filters(sorted(kept), kept)
    for i, lang in enumerate(f.languages):
        hit = np.bitwise_and.reduce([f.table[s] for s in language._slots(kept[lang].view(np.uint64))])
        assert (hit[:, i // 8] >> (i % 8) & 1).all()
        miss = np.bitwise_and.reduce([f.table[s] for s in language._slots(rng.integers(0, 2**62, 200_000).view(np.uint64))])
        assert abs((miss[:, i // 8] >> (i % 8) & 1).mean() - f.errs[i]) < 0.001


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) > 0.98 * len(held)


def test_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["der", "und", "ich"] if i % 2 else ["the", "and", "one"], k=20)), "de" if i % 2 else "en") for i in range(60)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "123 !?", "en"), (103, "und " * 50_000, None), (None, "the and", "xx"), (100, "one", None)]
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, lang string, score double, gram string")
    got = {(r.doc_id, r.lang_pred) for r in language.identify(df).collect()}
    assert {(100, "und"), (101, "und"), (102, "und"), (103, "de"), (None, "en"), (100, "en")} <= got
    assert language.identify(df.where("false")).count() == 0
    assert {r.lang_pred for r in language.identify(df.withColumn("lang", df.text.substr(0, 0)).where("lang is null")).collect()} <= {"und"}


def test_junk_and_unlearned_languages_are_rejected(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    rng = random.Random(2)
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. "
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. "
    letters = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz     ", k=600)) for _ in range(20)]
    odd = spark.createDataFrame([(10**9 + i, t, None) for i, t in enumerate([polish * 3, finnish * 3, *letters])], docs.schema)
    kept = {r.doc_id for r in language.recognised(docs.union(odd)).select("doc_id").collect()}
    assert not any(d >= 10**9 for d in kept)
    assert len(kept) > 0.999 * docs.count()
