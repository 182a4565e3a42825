"""Token ids of a corpus in canonical length-limited Huffman files.

Documents are dealt by ranges of doc_id and sorted, tokenised once, and counted; one code, made from the counts of the
whole corpus, is used in all files. A file holds about FILE_IDS ids in blocks that can be decoded on their own from
their bit offsets.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import huffman
from .common import cut, give_back, in_batches, new_folder, parts

#: Ids after which a file ends (with the document that reaches it).
FILE_IDS = 4_000_000
#: Parts whose ids a Python worker remembers, from one task to the next of a stage (the next stage forgets them).
_MAX_WORDS, _MAX_BYTES = 300_000, 6_000_000
_CHUNK = "part int, chunk int, before long, nulls long, doc_ids array<long>, lengths array<long>, ids binary, symbols array<int>, counts array<long>"


@lru_cache(2)
def _tokenizer(path: str):
    # tasks fill the cores: threads of one task's own would only take time from the others
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: The printable character that stands for each byte in byte-level vocabularies (the public GPT-2 rule).
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = dict(zip(_PRINTABLE, _PRINTABLE)) | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}


class _Index(dict):
    """part -> number, counting on for parts that are new."""

    def __missing__(self, part: bytes) -> int:
        self[part] = n = len(self)
        self.fresh.append(part)
        return n


class WordIds:
    """Ids of whole texts, a part apart at a time; each part is given to the tokenizer once, until memory is used up.

    For tokenizers that drop white space, never merge across it or between letters and signs, and lower-case: a text's
    ids are then those of its parts in order. Parts are runs of other than ASCII white space, lower-cased unless the
    text may spell a special token. What is but letters goes to the tokenizer's model without the steps before it; a
    full stop or comma at the end stands for itself. Other tokenizers get whole texts.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        # the states of these two alone: the whole tokenizer as text is large
        kinds = lambda step, n: [x["type"] for x in json.loads(step.__getstate__() if step is not None else "{}").get(n, [])]
        self.by_part = kinds(self.tokenizer.normalizer, "normalizers") == ["NFC", "Replace", "Lowercase"] and kinds(self.tokenizer.pre_tokenizer, "pretokenizers") == ["Split", "ByteLevel"]
        self.model = self.tokenizer.model
        self._forget()

    def _forget(self):
        self.index, self.bytes = _Index(), 0
        self.index.fresh = []
        self.flat, self.starts, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int32), np.empty(0, np.int32)

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _letters(self, part: bytes) -> list[int] | None:
        """Ids of a part of letters alone; None for others."""
        if not part.isalpha():
            text = part.decode("utf-8", "replace")
            if not text.isalpha() or "Σ" in text or "İ" in text:
                return None
            part = text.lower().encode()
            if not is_normalized("NFC", text) or not is_normalized("NFC", part.decode()):
                return None
        return [t.id for t in self.model.tokenize(part.lower().decode("latin-1").translate(_BYTES))]

    def _known(self, part: bytes) -> list[int] | None:
        """Ids of a part that is remembered from earlier texts."""
        n = self.index.get(part)
        return self.flat[self.starts[n] : self.starts[n] + self.sizes[n]].tolist() if n is not None and n < len(self.sizes) else None

    def _parts(self, fresh: list[bytes]) -> list[list[int]]:
        """Ids of new parts."""
        stop, comma = self._encoded([".", ","])
        found: list = []
        tokenize, plain = self.model.tokenize, {}
        for part in fresh:
            end = stop if part[-1] == 46 else comma if part[-1] == 44 else None
            bare = part[:-1] if end and len(part) > 1 else part
            if bare.isalpha():  # ASCII letters stand for themselves; with and without a sign behind they are met once
                ids = plain.get(bare)
                if ids is None:
                    ids = plain[bare] = self._known(bare) or [t.id for t in tokenize(bare.lower().decode())]
            else:
                ids = self._letters(bare)
            found.append(ids if ids is None or not end or len(part) == 1 else ids + end)
        slow = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(slow, self._encoded([fresh[i].decode("utf-8", "replace") for i in slow])):
            found[i] = ids
        return found

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and how many belong to each text."""
        if not self.by_part:
            found = self._encoded(texts)
            return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))
        if len(self.index) > _MAX_WORDS or self.bytes > _MAX_BYTES:
            self._forget()
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        parts = [(r if b"<|" in r else r.lower()).split() for r in raw]
        words = np.fromiter(map(self.index.__getitem__, chain.from_iterable(parts)), np.int32, sum(map(len, parts)))
        if fresh := self.index.fresh:
            self.index.fresh = []
            self.bytes += sum(map(len, fresh))
            found = self._parts(fresh)
            sizes = np.fromiter(map(len, found), np.int32, len(found))
            self.starts = np.concatenate([self.starts, (len(self.flat) + np.cumsum(sizes) - sizes).astype(np.int32)])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))])
        sizes = self.sizes[words]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(ends[-1], dtype=np.int32)
        at += np.repeat(self.starts[words] - ends[:-1].astype(np.int32), sizes)
        return self.flat[at], np.diff(ends[np.cumsum([0, *map(len, parts)])])


@lru_cache(1)
def _words(path: str) -> WordIds:
    return WordIds(path)


def _tokenise(path: str, end_id: int, file_ids: int):
    def run(batches):
        words, part, chunk, before = _words(path), TaskContext.get().partitionId(), 0, 0
        held: list[tuple[np.ndarray, ...]] = []
        kind = "<u2" if words.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"

        def close():
            nonlocal chunk, before, held
            known, doc_ids, lengths, ids = (np.concatenate([h[i] for h in held]) for i in range(4))
            counts = np.zeros(int(ids.max()) + 1, np.int64)
            for a in range(0, len(ids), huffman.SLICE):  # counting widens the ids
                some = np.bincount(ids[a : a + huffman.SLICE])
                counts[: len(some)] += some
            symbols = np.flatnonzero(counts)
            row = [part, chunk, before, int((~known).sum()), doc_ids, lengths, ids.tobytes(), symbols, counts[symbols]]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())))], names=[c.split()[0] for c in _CHUNK.split(", ")])
            chunk, before, held = chunk + 1, before + len(ids), []

        for batch in batches:
            for a, b in parts(batch.column(2)):
                rows = batch.slice(a, b - a)
                ids, sizes = words.ids([t or "" for t in rows.column(2).to_pylist()])
                ids = np.insert(ids, np.cumsum(sizes), end_id).astype(kind)
                held.append((rows.column(0).to_numpy(zero_copy_only=False), rows.column(1).to_numpy(), sizes + 1, ids))
                if sum(len(h[3]) for h in held) >= file_ids:
                    yield from close()
        if held:
            yield from close()
        give_back()

    return run


def _encode(folder: str, lengths: bytes):
    def run(batches):
        _words.cache_clear()
        system, root = fs.FileSystem.from_uri(folder)
        code = np.frombuffer(lengths, np.uint8)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                part, chunk, start, nulls = (row.column(k)[0].as_py() for k in range(4))
                doc_ids, sizes = (row.column(k)[0].values.to_numpy() for k in (4, 5))
                blob = row.column(6)[0].as_buffer()
                ids = np.frombuffer(blob, "<u2" if len(blob) == 2 * int(sizes.sum()) else "<u4")
                data = huffman.write(start, doc_ids, sizes, ids, code, nulls)
                name = f"{root}/{part:06d}-{chunk:06d}.huf"
                mine = f"{name}.{TaskContext.get().taskAttemptId()}.tmp"
                with system.open_output_stream(mine) as f:
                    f.write(data)
                system.move(mine, name)  # a task that runs again writes the same bytes
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(data)], pa.int64()), pa.array([len(ids)], pa.int64())], names=["file", "bytes", "ids"])
        row = doc_ids = sizes = blob = ids = data = None
        give_back()

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the files of docs (doc_id, text) into folder, a URI that pyarrow opens; file, bytes, ids of each.

    Documents lie in ascending order of doc_id (null first), equal doc_ids in a fixed order of their texts. Null and empty
    texts have the end id alone; texts of any length are encoded whole; repeated rows stay. No rows, no files. Other
    columns are left out.
    """
    spark = docs.sparkSession
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    rows = in_batches(docs).select(F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("known"), F.col("doc_id"), F.xxhash64("text")]
    chunks = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_tokenise(tokenizer_path, end_id, file_ids), _CHUNK)
    path = new_folder(spark, "ids")
    chunks.write.option("compression", "zstd").parquet(path)
    chunks = spark.read.schema(chunks.schema).parquet(path)

    # as many rows as the vocabulary has ids, and as many as there are partitions
    found = chunks.select(F.explode(F.arrays_zip("symbols", "counts")).alias("x")).groupBy("x.symbols").agg(F.sum("x.counts").alias("n")).collect()
    counts = np.zeros(max((r[0] for r in found), default=0) + 1, np.int64)
    for symbol, n in found:
        counts[symbol] = n
    sizes = sorted(tuple(r) for r in chunks.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).collect())
    total, firsts = 0, []
    for part, n in sizes:
        firsts.append((part, total))
        total += n
    firsts = spark.createDataFrame(firsts, "part int, first long")
    placed = chunks.join(F.broadcast(firsts), "part").select("part", "chunk", (F.col("first") + F.col("before")).alias("start"), "nulls", "doc_ids", "lengths", "ids")
    return cut(placed.mapInArrow(_encode(folder, huffman.code_lengths(counts).tobytes()), "file string, bytes long, ids long"), "files")


def _decode(batches):
    _words.cache_clear()
    for batch in batches:
        for data in batch.column(0):
            f = huffman.File(data.as_py())
            ids = f.ids().astype("<u4")
            ends = np.cumsum(f.doc_lengths.astype(np.int64))
            begins = ends - f.doc_lengths.astype(np.int64)
            view = memoryview(ids).cast("B")
            crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
            doc_ids = pa.array(f.doc_ids, mask=np.arange(len(f.doc_ids)) < f.nulls)
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(f.start + begins), pa.array(f.doc_lengths.astype(np.int64)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
    f = ids = ends = begins = view = crcs = doc_ids = None
    give_back()


def read_token_files(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.huf").load(folder).select("content").mapInArrow(_decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write docs as token files in the shared folder and return what the files say, one row for each document."""
    folder = new_folder(docs.sparkSession, "token-files")
    if not write_token_files(docs, tokenizer_path, folder, end_id).limit(1).count():
        return docs.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(docs.sparkSession, folder)
