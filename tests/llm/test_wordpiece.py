from functools import lru_cache

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanframe.llm import wordpiece as W
from gleanframe.llm.common import table


def _greedy(word, first, rest):
    n, at = 0, 0
    while at < len(word):
        known = first if at == 0 else rest
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in known), 0)
        if not size:
            return 0
        n, at = n + 1, at + size
    return n


piece = st.text("abc", min_size=1, max_size=5)


@settings(max_examples=300, deadline=None)
@given(st.sets(piece, max_size=12), st.sets(piece, max_size=12), st.lists(st.text("abcd", min_size=1, max_size=14), max_size=8))
def test_same_as_greedy(first, rest, words):
    a = W.Automaton(sorted(first), sorted(rest))
    assert [a.count(w) for w in words] == [_greedy(w, first, rest) for w in words]


def test_whole_table_and_odd_rows(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(259, model.get_piece_size())}
    longest = max(map(len, pieces))
    rows = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "x" * 100_000), (None, "a"), (1, "a"), (1004, "\U00012345 a")]
    got = [(r.doc_id, r.n_words, r.n_tokens, r.n_unknown) for r in W.token_counts(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int"), path).collect()]
    count = lru_cache(None)(lambda w: _greedy_whole(w, pieces, longest, True))
    assert got == [(d, len((t or "").split()), sum(map(count, (t or "").split())), 0) for d, t in rows]
    assert W.token_counts(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def _greedy_whole(word, pieces, longest, has_bytes):
    n = unknown = at = 0
    word = "▁" + word
    while at < len(word):
        size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in pieces), 0)
        n += 1 if size or not has_bytes else len(word[at].encode())
        unknown += not size and not has_bytes
        at += size or 1
    return n + (unknown << 40)


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("ab▁é", min_size=1, max_size=4), max_size=12), st.lists(st.text("abcé▁漢", max_size=14), max_size=8), st.booleans())
def test_same_as_greedy_over_all_pieces(pieces, words, has_bytes):
    v = W.Vocabulary(sorted(pieces), frozenset(range(256) if has_bytes else ()))
    assert [v.count(w) for w in words] == [_greedy_whole(w, pieces, 4, has_bytes) for w in words]


def test_whole_vocabulary_with_bare_mark_and_bytes(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(259, model.get_piece_size())}
    longest = max(map(len, pieces))
    rows = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    rows += [(1001, "ñandú ça ßa"), (1002, "\U00012345 a"), (1003, "日本語" * 30), (1004, "a▁b ▁")]
    got = [(r.doc_id, r.n_words, r.n_tokens, r.n_unknown) for r in W.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()]
    assert got == [(d, len(t.split()), sum(_greedy_whole(w, pieces, longest, True) for w in t.split()), 0) for d, t in rows]
    assert got[-3][2] > 5
