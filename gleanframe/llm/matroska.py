"""Matroska files: a parser from bytes to packet tables, and a writer of uncompressed 8-bit audio.

The parser reads variable-length EBML elements (unknown sizes too), clusters, simple blocks and block groups in all four
kinds of lacing, and cues, and gives for each packet its track, time and byte range. The payload of a document is stored
as samples, read back by those ranges, and described.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element ids of the Matroska specification (RFC 9559) that are read or written here: fixed values.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x2AD7B1, 0x4489, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, RATE, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, VERSION, READ_VERSION = 0x4282, 0x4287, 0x4285
_PARENTS = {SEGMENT, CLUSTER, BLOCK_GROUP, TRACKS, TRACK_ENTRY, CUES, CUE_POINT, CUE_POSITIONS, INFO}
_TOP = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, EBML}

#: Samples a second and of a packet (64 ms), packets of a block, blocks of a cluster.
SAMPLES, PACKET, LACED, BLOCKS = 8000, 512, 8, 32


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    offset: int
    size: int
    key: bool
    cluster: int


class Parsed(NamedTuple):
    packets: list[Packet]
    cues: list[tuple[int, int, int]]  # time in ns, track, byte offset of the cluster
    codecs: dict[int, str]


def _vint(data: bytes, at: int, marked: bool = False) -> tuple[int, int]:
    """A variable-length number and where it ends; marked: with its length bit, as ids are. -1: an unknown size."""
    first = data[at]
    if not first:
        raise ValueError("an EBML number of over eight bytes")
    size = 9 - first.bit_length()
    if at + size > len(data):
        raise ValueError("cut off in an EBML number")
    value = int.from_bytes(data[at : at + size], "big")
    if marked:
        return value, at + size
    value &= (1 << 7 * size) - 1
    return (-1 if value == (1 << 7 * size) - 1 else value), at + size


def elements(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(id, offset of the element, offset of its content, end), parents before their children."""
    stack = [len(data) if end is None else end]
    while at < stack[-1] or len(stack) > 1:
        while len(stack) > 1 and at >= stack[-1]:
            stack.pop()
        if at >= stack[-1]:
            break
        kind, body = _vint(data, at, True)
        size, body = _vint(data, body)
        stop = stack[-1] if size < 0 else body + size
        if stop > stack[-1] and kind not in _TOP:
            raise ValueError("an element reaches over its parent's end")
        yield kind, at, body, min(stop, stack[0])
        if kind in _PARENTS:
            # a cluster of unknown size ends where the next element of the top level begins
            stack.append(min(stop, stack[0]))
            at = body
        else:
            at = stop


def _laces(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(offset, size) of the frames of a block whose lacing bits are kind."""
    if not kind:
        return [(at, end - at)]
    n, at, sizes = data[at] + 1, at + 1, []
    if kind == 1:  # Xiph: sums of bytes, of which all but the last are 255
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif kind == 3:  # EBML: a size, then signed differences
        for i in range(n - 1):
            before = at
            value, at = _vint(data, at)
            sizes.append(value if not i else sizes[-1] + value - ((1 << 7 * (at - before) - 1) - 1))
    else:
        if (end - at) % n:
            raise ValueError("frames of a block with fixed lacing differ in size")
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("frames are larger than their block")
    ends = np.cumsum([at, *sizes]).tolist()
    return list(zip(ends, sizes))


def parse(data: bytes) -> Parsed:
    """Packets in file order. Laced frames follow each other by the track's default duration."""
    scale, base, cluster, packets, cues, codecs, lasts = 1_000_000, 0, 0, [], [], {}, {}
    track, cue, segment = 0, [0, 0], 0
    for kind, start, at, end in elements(data):
        number = lambda: int.from_bytes(data[at:end], "big")  # noqa: B023, E731
        if kind == SEGMENT:
            segment = at
        elif kind == TIMESTAMP_SCALE:
            scale = number()
        elif kind == TRACK_NUMBER:
            track = number()
        elif kind == CODEC_ID:
            codecs[track] = data[at:end].decode("ascii")
        elif kind == DEFAULT_DURATION:
            lasts[track] = number()
        elif kind == CLUSTER:
            cluster = start
        elif kind == TIMESTAMP:
            base = number()
        elif kind == CUE_TIME:
            cue[0] = number() * scale
        elif kind == CUE_TRACK:
            cue[1] = number()
        elif kind == CUE_CLUSTER:
            cues.append((cue[0], cue[1], segment + number()))
        elif kind == REFERENCE and packets:
            packets[-1] = packets[-1]._replace(key=False)
        elif kind in (SIMPLE_BLOCK, BLOCK):
            number_, body = _vint(data, at)
            time, flags = int.from_bytes(data[body : body + 2], "big", signed=True), data[body + 2]
            key = bool(flags & 0x80) or kind == BLOCK
            for i, (offset, size) in enumerate(_laces(data, body + 3, end, flags >> 1 & 3)):
                packets.append(Packet(number_, (base + time) * scale + i * lasts.get(number_, 0), offset, size, key, cluster))
    return Parsed(packets, cues, codecs)


def _size(n: int) -> bytes:
    width = next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(kind: int, body: bytes | int | str) -> bytes:
    if isinstance(body, int):
        body = body.to_bytes(max(1, (body.bit_length() + 7) // 8), "big")
    elif isinstance(body, str):
        body = body.encode("ascii")
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _lace(frames: list[bytes]) -> tuple[int, bytes]:
    """Lacing bits and body: none, fixed, or EBML sizes if frames differ."""
    if len(frames) == 1:
        return 0, frames[0]
    sizes = [len(f) for f in frames]
    if len(set(sizes)) == 1:
        return 2, bytes([len(frames) - 1]) + b"".join(frames)
    head = _size(sizes[0])
    for a, b in zip(sizes, sizes[1:-1]):
        width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
        head += (b - a + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")
    return 3, bytes([len(frames) - 1]) + head + b"".join(frames)


_HEADER = _element(EBML, _element(VERSION, 1) + _element(READ_VERSION, 1) + _element(DOC_TYPE, "matroska"))
_TRACKS = _element(TRACKS, _element(TRACK_ENTRY, _element(TRACK_NUMBER, 1) + _element(TRACK_UID, 1) + _element(TRACK_TYPE, 2) + _element(DEFAULT_DURATION, PACKET * 10**9 // SAMPLES) + _element(CODEC_ID, "A_PCM/INT/LIT") + _element(AUDIO, _element(RATE, np.array(SAMPLES, ">f4").tobytes()) + _element(CHANNELS, 1) + _element(BIT_DEPTH, 8))))


def write(payload: bytes) -> bytes:
    """payload as one audio track; the same bytes for the same payload."""
    ms = lambda sample: sample * 1000 // SAMPLES
    info = _element(INFO, _element(TIMESTAMP_SCALE, 1_000_000) + _element(DURATION, np.array(ms(len(payload)), ">f8").tobytes()))
    body, cues, per_block = bytearray(info + _TRACKS), b"", PACKET * LACED
    for at in range(0, len(payload), per_block * BLOCKS):
        blocks = _element(TIMESTAMP, ms(at))
        for b in range(at, min(len(payload), at + per_block * BLOCKS), per_block):
            frames = [payload[f : f + PACKET] for f in range(b, min(len(payload), b + per_block), PACKET)]
            kind, laced = _lace(frames)
            blocks += _element(SIMPLE_BLOCK, b"\x81" + (ms(b) - ms(at)).to_bytes(2, "big") + bytes([0x80 | kind << 1]) + laced)
        cues += _element(CUE_POINT, _element(CUE_TIME, ms(at)) + _element(CUE_POSITIONS, _element(CUE_TRACK, 1) + _element(CUE_CLUSTER, len(body))))
        body += _element(CLUSTER, blocks)
    return _HEADER + _element(SEGMENT, bytes(body + _element(CUES, cues)))


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and these with zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)


def feature(samples: np.ndarray, parsed: Parsed) -> str:
    """Packets and cues, sum, energy, crossings of the middle, and a histogram of eight levels; whole numbers all."""
    wide = samples.astype(np.int64)
    turns = int(np.count_nonzero(np.diff(samples > 127)))
    levels = np.bincount(samples >> 5, minlength=8)
    return f"packets={len(parsed.packets)};cues={len(parsed.cues)};sum={wide.sum()};energy={(wide * wide).sum()};turns={turns};levels={'.'.join(map(str, levels))}"


_MEDIA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _describe(batches):
    for batch in batches:
        rows = []
        for text in batch.column(1):
            n, payload = payload_of(text.as_py())
            media = write(payload)
            parsed = parse(media)
            back = b"".join([media[p.offset : p.offset + p.size] for p in parsed.packets])
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(np.frombuffer(back, np.uint8), parsed)))
        columns = list(zip(*rows)) or [()] * 7
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", *(c.split()[0] for c in _MEDIA.split(", "))])


def media_columns(docs: DataFrame) -> DataFrame:
    """Every text of docs stored as a Matroska file, read back and described; null texts count as empty."""
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_describe, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_MEDIA}")


def packet_table(files: DataFrame, key: str = "doc_id", content: str = "media") -> DataFrame:
    """(key, content) -> one row for each packet; error says why a file can't be parsed (its only row then).

    A null file has no rows.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [(k, *p, None) for p in parse(data).packets] if data is not None else []
                except (ValueError, IndexError, UnicodeDecodeError) as e:
                    rows.append((k, None, None, None, None, None, None, str(e)))
            types = (batch.schema.types[0], pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string())
            names = [key, "track", "timestamp_ns", "offset", "size", "key", "cluster", "error"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 8, types)], names=names)

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, content).mapInArrow(run, f"{key} {kind}, track long, timestamp_ns long, offset long, size long, key boolean, cluster long, error string")
