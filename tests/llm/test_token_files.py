import heapq
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gleanframe.llm import huffman
from gleanframe.llm.token_files import WordIds, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    for n in (2, 3, 50, 700):
        counts = np.concatenate([[0], (rng.pareto(0.7, n) * 3).astype(np.int64) + 1])
        heap = [(int(c), i) for i, c in enumerate(counts) if c]
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a[0] + b[0]
            heapq.heappush(heap, (a[0] + b[0], 0))
        free = huffman.code_lengths(counts, 60)
        assert int((counts * free).sum()) == cost and free[0] == 0
        tight = huffman.code_lengths(counts, int(np.ceil(np.log2(n))) + 1)
        assert tight.max() <= int(np.ceil(np.log2(n))) + 1 and (0.5 ** tight[tight > 0]).sum() <= 1


def test_round_trip_and_single_blocks():
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 1), (5, 1), (1024, 9), (1025, 60000), (5000, 300)):
        ids = (rng.random(n) ** 4 * top).astype(np.uint16)
        counts = np.bincount(ids, minlength=3)
        data = huffman.write(7, np.array([4, 5]), np.array([n, 0]), ids, huffman.code_lengths(counts))
        f = huffman.File(data)
        assert f.start == 7 and f.doc_ids.tolist() == [4, 5]
        assert np.array_equal(f.ids(), ids)
        for b in range(-(-n // huffman.BLOCK)):
            assert np.array_equal(f.ids(b, b + 1), ids[b * huffman.BLOCK : (b + 1) * huffman.BLOCK])


def test_ids_are_the_tokenizers():
    rng, t = random.Random(5), Tokenizer.from_file(PATH)
    pool = ["don't", "It's,", "end.", "a.,", "b..", "<|EndOfText|>", "<|endoftext|>.", "THE,", "Été", "İstanbul", "a b", "x<|endoftext|>y", "12ab", "你好", "\U0001f600!!", "́", "\x1c", "ΣΑΣ", " ", "the", "'s"]
    texts = ["".join(rng.choice(pool) + rng.choice([" ", "", "\n", "\t ", "\x0b", "\x0c"]) for _ in range(30)) for _ in range(300)] + ["", " "]
    ids, sizes = WordIds(PATH).ids(texts)
    assert np.split(ids, np.cumsum(sizes)[:-1])[0].tolist() == t.encode(texts[0], add_special_tokens=False).ids
    for got, e in zip(np.split(ids, np.cumsum(sizes)[:-1]), t.encode_batch(texts, add_special_tokens=False)):
        assert got.tolist() == e.ids


def test_files_hold_all_documents(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["the", "cat", "Zwölf", "x9", "été"], k=rng.choice([0, 1, 20, 2000])))) for i in range(0, 400, 2)] + [(401, None), (403, "a"), (403, "a"), (None, "b"), (None, None), (-5, "cat the"), (-1, ""), (405, "the " * 60_000)]
    t = Tokenizer.from_file(PATH)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, `start` int").repartition(5)
    want, start = [], 0
    for d, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is None)):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_files(df, PATH).sort("start").collect()]
    nulls = lambda rows: sorted((r[0], r[2], r[3]) for r in rows if r[0] is None)
    assert got[2:] == want[2:] and nulls(got[:2]) == nulls(want[:2]) and got[0][1] == 0  # two nulls, in the order of their hashes
    assert token_files(df.where("false"), PATH).count() == 0


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
def test_packed_in_slices_alike(monkeypatch, n):
    ids = np.random.default_rng(n).geometric(0.05, n).astype(np.uint16)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=2))
    whole = huffman.write(7, np.array([1]), np.array([n]), ids, lengths)
    monkeypatch.setattr(huffman, "SLICE", huffman.BLOCK)
    assert huffman.write(7, np.array([1]), np.array([n]), ids, lengths) == whole
    assert n == 0 or (huffman.File(whole).ids() == ids).all()


def test_letters_with_a_sign_behind_are_tokenised_once():
    words, met = WordIds(PATH), []
    plain = words.model

    class Model:
        def tokenize(self, text):
            met.append(text)
            return plain.tokenize(text)

    words.model = Model()
    for texts in (["Lorem lorem. lorem, ipsum."], ["ipsum ipsum, lorem LOREM. dolor"]):
        ids, _ = words.ids(texts)
        assert ids.tolist() == words.tokenizer.encode(texts[0], add_special_tokens=False).ids
    assert sorted(met) == ["dolor", "ipsum", "ipsum", "lorem"]
