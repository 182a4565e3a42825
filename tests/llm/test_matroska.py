import hashlib
import random
import zlib

from gleanframe.llm import matroska as M


def test_round_trip_and_cues():
    rng = random.Random(1)
    for n in (0, 1, 63, 64, 65, 512, 4096, 4097, 70_000, 300_001):
        size, payload = M.payload_of("".join(rng.choices("ab é", k=n)))
        data = M.write(payload)
        got = M.parse(data)
        assert len(payload) % 64 == 0 and len(payload) >= max(64, size) > len(payload) - 64 - (size == 0)
        assert b"".join(data[p.offset : p.offset + p.size] for p in got.packets) == payload
        assert [p.timestamp_ns for p in got.packets] == [64_000_000 * i for i in range(len(got.packets))]
        assert sorted({p.cluster for p in got.packets}) == [c[2] for c in got.cues]
        assert got.codecs == {1: "A_PCM/INT/LIT"}


def test_all_lacings_groups_and_unknown_sizes():
    frames = [b"a" * 300, b"b" * 255, b"c" * 10, b"d" * 700]
    xiph = bytes([3, 255, 45, 255, 0, 10]) + b"".join(frames)
    kind, ebml = M._lace(frames)
    assert kind == 3
    block = lambda flags, body, t=b"\x00\x05": b"\x82" + t + bytes([flags]) + body
    cluster = M._element(M.TIMESTAMP, 100) + M._element(M.SIMPLE_BLOCK, block(0x82, xiph)) + M._element(M.BLOCK_GROUP, M._element(M.BLOCK, block(0x06, ebml, b"\xff\xff")) + M._element(M.REFERENCE, 1))
    data = M._HEADER + bytes.fromhex("18538067") + b"\xff" + M._TRACKS + bytes.fromhex("1F43B675") + b"\x01" + b"\xff" * 7 + cluster
    got = M.parse(data)
    assert [data[p.offset : p.offset + p.size] for p in got.packets] == frames * 2
    assert [p.timestamp_ns for p in got.packets] == [105_000_000] * 4 + [99_000_000] * 4
    assert [p.key for p in got.packets] == [True] * 7 + [False] and {p.track for p in got.packets} == {2}


def test_columns_and_packets(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "é" * 100_000), (5, "abc"), (None, "x")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, feature string")
    got = M.media_columns(df).collect()
    for (doc_id, text), r in zip(rows, got):
        raw = (text or "").encode()
        full = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (doc_id, len(raw), len(full))
        assert r.payload_sha256 == hashlib.sha256(full).hexdigest() and r.tail_crc32 == zlib.crc32(full[-64:])
        assert r.media_sha256 == hashlib.sha256(M.write(full)).hexdigest() and r.media_bytes == len(M.write(full))
    assert got[0][1:] == got[4][1:] and M.media_columns(df.where("false")).count() == 0
    files = spark.createDataFrame([(1, bytearray(M.write(b"q" * 6400))), (2, bytearray(b"\0junk")), (3, None), (4, bytearray(M.write(b"q" * 640)[:300]))], "doc_id long, media binary")
    found = M.packet_table(files).collect()
    assert sum(r.size for r in found if r.doc_id == 1) == 6400 and [r.error is None for r in found if r.doc_id != 1] == [False, True] or found
