import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as C
from gleanframe.llm import decontaminate as D
from gleanframe.llm import language
from gleanframe.llm.common import cut, table
from gleanframe.llm.queries import tokenizer

from .test_decontaminate import _tokens
from .test_near_dup import _brute as brute_components

SF = "/root/testdata/sf0.001"


def _leaks(text, tests):
    """Whether any window of a test text is in the document but for the substitutions allowed: all alignments."""
    code: dict = {}
    number = lambda t: np.array([code.setdefault(w, len(code)) for w in _tokens(t)], int)
    d = number(text)
    for _, test in tests:
        b = number(test)
        w = min(len(b), D.WINDOW)
        if w < D.SPAN or len(d) < w:
            continue
        same = (d[:, None] == b[None, :]).astype(int)
        n, m = len(d) - w + 1, len(b) - w + 1
        if sum(same[k : n + k, k : m + k] for k in range(w)).max() >= w - (D.SUBSTITUTIONS if w == D.WINDOW else 1):
            return True
    return False


def test_each_stage_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    extra = spark.createDataFrame([(9000, None, "en", "s", 0), (9001, "12 34", "en", "s", 5), (9002, "日本語 だけ の 文", None, None, 8)], docs.schema)
    docs = docs.union(extra)
    columns, stages = docs.columns, dict(C.STAGES)
    known = cut(stages["language"](spark, docs, SF), "t")
    scores = {r.doc_id: r for r in language.identify(docs).collect()}
    assert known.columns == columns
    assert {r.doc_id for r in known.collect()} == {d for d, r in scores.items() if r.lang_pred != "und" and r.score >= 0.1}
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in known.collect()} == {9000, 9001, 9002}

    single = cut(stages["near_copies"](spark, known, SF), "t")
    rows = [(r.doc_id, r.text) for r in known.collect()]
    assert single.columns == columns
    assert sorted(r.doc_id for r in single.collect()) == sorted(d for d, _, c in brute_components(rows, 5, 80) if d == c)

    clean = cut(stages["decontamination"](spark, single, SF), "t")
    tests = [tuple(r) for r in table(spark, SF, "benchmark").collect()]
    found = {r.doc_id: _leaks(r.text, tests) for r in single.collect()}
    assert clean.columns == columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, leaked in found.items() if not leaked)

    mixed = cut(stages["mixing"](spark, clean, SF), "t")
    assert mixed.columns == columns and set(mixed.collect()) <= set(clean.collect())

    t, start, want = Tokenizer.from_file(tokenizer()), 0, []
    for r in sorted(mixed.collect(), key=lambda r: r.doc_id):
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in stages["token_files"](spark, mixed, SF).collect()) == sorted(want)
