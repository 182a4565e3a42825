"""Greedy word-piece lengths by a linear longest-match automaton (Song et al., Fast WordPiece Tokenization, 2021).

A trie over the vocabulary has, for every node, a failure link and the number of pieces that are complete when it is
followed. One pass over a word's characters then gives the number of its pieces; the pieces are never built. A word
starts with the blank mark; a character that no piece covers stands as its bytes, or as an unknown token without them.
"""

from __future__ import annotations

from collections import deque
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a word starts with; words that are remembered; what an unknown token adds to a count besides itself.
MARK = "▁"
_MAX_WORDS, _UNKNOWN = 400_000, 1 << 40


class Automaton:
    """first: pieces that may begin a word; rest: pieces that may go on with one; weights: pieces that count other than 1."""

    START, INSIDE, NONE = 0, 1, -1

    def __init__(self, first: list[str], rest: list[str], weights: dict[str, int] | None = None):
        self.next: dict[tuple[int, str], int] = {}
        children: list[list[tuple[str, int]]] = [[], []]
        final, weights = [0, 0], weights or {}
        for root, pieces in ((self.START, first), (self.INSIDE, rest)):
            for piece in pieces:
                at = root
                for c in piece:
                    to = self.next.get((at, c))
                    if to is None:
                        to = self.next[at, c] = len(final)
                        children[at].append((c, to))
                        children.append([])
                        final.append(0)
                    at = to
                if at > 1:
                    final[at] = weights.get(piece, 1)
        self.fail, self.pops = [self.NONE] * len(final), [0] * len(final)
        queue = deque([self.START, self.INSIDE])
        while queue:
            at = queue.popleft()
            for c, to in children[at]:
                if final[to]:
                    self.fail[to], self.pops[to] = self.INSIDE, final[to]
                else:
                    back, pops = self.fail[at], self.pops[at]
                    while back != self.NONE and (back, c) not in self.next:
                        pops += self.pops[back]
                        back = self.fail[back]
                    if back != self.NONE:
                        self.fail[to], self.pops[to] = self.next[back, c], pops
                queue.append(to)

    def count(self, word: str) -> int:
        """Pieces of a word; 0 if the greedy match gets stuck."""
        step, fail, pops, at, n = self.next, self.fail, self.pops, self.START, 0
        for c in word:
            while (to := step.get((at, c))) is None:
                n += pops[at]
                at = fail[at]
                if at < 0:
                    return 0
            at = to
        while at != self.INSIDE:
            n += pops[at]
            at = fail[at]
            if at < 0:
                return 0
        return n


class Vocabulary:
    """Counts of greedy longest matches over mark + word, with unknown tokens in the high bits.

    Where no piece matches, one character stands as its bytes if the vocabulary has them, as one unknown token if not.
    """

    def __init__(self, pieces: list[str], known_bytes: frozenset[int] = frozenset()):
        self.known_bytes, self.alphabet = known_bytes, {MARK}.union(*pieces)
        alone = {c: self._alone(c) for c in self.alphabet - set(pieces)}
        every = sorted({*pieces, *alone})
        self.automaton = Automaton(every, every, alone)

    def _alone(self, c: str) -> int:
        parts = c.encode("utf-8", "surrogatepass")
        return len(parts) if self.known_bytes.issuperset(parts) else 1 + _UNKNOWN

    def count(self, word: str) -> int:
        word = MARK + word
        if self.alphabet.issuperset(word):
            return self.automaton.count(word)
        n, begin = 0, 0
        for i, c in enumerate(word):
            if c not in self.alphabet:
                n += self.automaton.count(word[begin:i]) + self._alone(c)
                begin = i + 1
        return n + self.automaton.count(word[begin:])


class _Counts(dict):
    """word -> pieces, with unknown tokens in the high bits."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        if len(self) >= _MAX_WORDS:
            self.clear()
        n = self.vocabulary.count(word)
        if len(word) < 100:
            self[word] = n
        return n


@lru_cache(2)
def load(path: str) -> Vocabulary:
    """All pieces of a sentencepiece vocabulary, the bare blank mark and the bytes with them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))]
    known_bytes = frozenset(int(model.id_to_piece(i)[3:5], 16) for i in ids if model.is_byte(i))
    return Vocabulary([model.id_to_piece(i) for i in ids if not model.is_byte(i)], known_bytes)


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown for each row of docs; words are parted by white space.

    Null, empty and blank texts have no words. path: a sentencepiece model at the same place on every machine.
    """

    def run(batches):
        counts = _Counts(load(path))
        for batch in batches:
            words, tokens, unknown = [], [], []
            for text in batch.column(1):
                parts = (text.as_py() or "").split()
                n = sum(map(counts.__getitem__, parts))
                words.append(len(parts))
                tokens.append(n % _UNKNOWN)
                unknown.append(n // _UNKNOWN)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long, n_unknown long")
