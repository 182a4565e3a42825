"""Length-limited canonical Huffman codes over integer ids, and a block format that numpy reads and writes."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Ids of a block. Blocks are decoded side by side, each from its own bit offset. Ids packed at a time: whole blocks.
BLOCK = 1024
SLICE = 256 * BLOCK
_HEAD = struct.Struct("<4sIQQQQQIQI")  # magic, block, start, documents, those of them (the first) without an id, ids, symbols, bytes of lengths, bytes of bits, crc
_MAGIC = b"HUF2"


def code_lengths(counts: np.ndarray, most: int = 16) -> np.ndarray:
    """Bits of each symbol (0: it doesn't occur), at most `most`, of least total length: package-merge."""
    present = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(present) < 2:
        out[present] = 1
        return out
    most = max(most, int(np.ceil(np.log2(len(present)))))
    order = np.argsort(counts[present], kind="stable")
    weights = counts[present][order].astype(np.int64)
    n, levels, merged = len(weights), [], weights
    for _ in range(most - 1):
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, packages])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < n)  # which of this list are symbols
        merged = both[rank]
    bits, take = np.zeros(n, np.int64), 2 * n - 2
    for is_symbol in reversed(levels):
        symbols = int(is_symbol[:take].sum())
        bits[:symbols] += 1
        take = 2 * (take - symbols)
    bits[:take] += 1
    out[present[order]] = bits
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Codes of each symbol; the symbols in code order; the longest length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    sorted_lengths = lengths[order].astype(np.int64)
    longest = int(sorted_lengths.max(initial=1))
    steps = 1 << (longest - sorted_lengths)
    codes = np.zeros(len(lengths), np.int64)
    codes[order] = (np.cumsum(steps) - steps) >> (longest - sorted_lengths)
    return codes, order, longest


def _pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits, and the bit offset of every block. SLICE ids at a time are in wide numbers."""
    sizes = lengths.astype(np.int64)
    total = sum(int(sizes[ids[a : a + SLICE]].sum()) for a in range(0, len(ids), SLICE))
    words, offsets, begin = np.zeros(total // 32 + 2, np.uint32), [], 0
    for a in range(0, len(ids), SLICE):
        some = ids[a : a + SLICE]
        size = sizes[some]
        at = np.cumsum(size)
        end = begin + int(at[-1])
        at += begin - size
        offsets.append(at[::BLOCK].astype(np.uint64))
        first = begin >> 5
        value = codes[some].astype(np.uint64) << (64 - size - (at & 31)).astype(np.uint64)
        word, n = (at >> 5) - first, (end >> 5) - first + 2
        high = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), minlength=n)
        high[1:] += np.bincount(word, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)[: n - 1]
        words[first : first + n] += high[: len(words) - first].astype(np.uint32)  # bits don't overlap
        begin = end
    return words.astype(">u4").tobytes(), np.concatenate([np.empty(0, np.uint64), *offsets])


def write(start: int, doc_ids: np.ndarray, doc_lengths: np.ndarray, ids: np.ndarray, lengths: np.ndarray, nulls: int = 0) -> bytes:
    """One file: header, code lengths, documents (id, ids), bit offsets of the blocks, bits."""
    codes, _, longest = canonical(lengths)
    if longest > 32:
        raise ValueError("codes of over 32 bits")
    bits, offsets = _pack(ids, lengths, codes)
    table = zlib.compress(lengths.astype(np.uint8).tobytes())
    body = table + doc_ids.astype("<i8").tobytes() + doc_lengths.astype("<u8").tobytes() + offsets.astype("<u8").tobytes() + bits
    return _HEAD.pack(_MAGIC, BLOCK, start, len(doc_ids), nulls, len(ids), len(lengths), len(table), len(bits), zlib.crc32(body)) + body


class File:
    """A file's parts; nothing is decoded before ids() is called."""

    def __init__(self, data: bytes):
        magic, self.block, self.start, docs, self.nulls, self.n, symbols, table, bits, crc = _HEAD.unpack_from(data)
        if magic != _MAGIC or zlib.crc32(memoryview(data)[_HEAD.size :]) != crc:
            raise ValueError("not a whole token file")
        at = _HEAD.size
        self.lengths = np.frombuffer(zlib.decompress(data[at : at + table]), np.uint8)
        at += table
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.doc_lengths = np.frombuffer(data, "<u8", docs, at + 8 * docs)
        at += 16 * docs
        blocks = -(-self.n // self.block)
        self.offsets = np.frombuffer(data, "<u8", blocks, at)
        self.bits = np.frombuffer(data, ">u4", bits // 4, at + 8 * blocks)

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of blocks first (inclusive) to last (exclusive), all blocks in step with each other."""
        _, order, longest = canonical(self.lengths)
        steps = 1 << (longest - self.lengths[order].astype(np.int64))
        table = np.repeat(order.astype(np.int32), steps)  # what the next `longest` bits begin with
        at = self.offsets[first:last].astype(np.int64)
        words = np.concatenate([self.bits.astype(np.uint64), np.zeros(2, np.uint64)])
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        sizes = self.lengths[table].astype(np.int64)
        if len(table) < 1 << longest:  # one symbol only
            table, sizes = np.resize(table, 1 << longest), np.resize(sizes, 1 << longest)
        out, shift = np.empty((self.block, len(at)), np.int32), np.uint64(64 - longest)
        full = min(self.block, self.n)
        for step in range(full):
            window = ((pairs[at >> 5] << (at & 31).astype(np.uint64)) >> shift).astype(np.int64)
            out[step] = table[window]
            at = np.minimum(at + sizes[window], 32 * len(pairs) - 1)
        whole = out[:full].T.reshape(-1) if len(at) > 1 or full == self.block else out[:full, 0] if len(at) else out[0, :0]
        stop = self.n - first * self.block if last is None else min(self.n, last * self.block) - first * self.block
        return whole[:stop]
