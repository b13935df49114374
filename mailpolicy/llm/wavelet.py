"""Token ids in wavelet-matrix files, one for each shard.

A shard holds whole documents. Its ids lie in bit planes, from the highest bit down; after each plane the ids are dealt, in order, into those
with a 0 and those with a 1. A plane takes n bits and a directory of counts, so one file of about 16 bits a token answers: the
token at a place, how often an id comes before a place, where its k-th occurrence is.

File: 8 bytes ``WAVEMAT1``; five uint64 (tokens, planes, documents, task, number in the task); the documents' token counts as
uint64; a byte for each document (1: it has an id) and the ids as int64; for each plane its zeros as uint64, its words as uint64 and the ones
before each eighth word as uint32. All little-endian.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailpolicy.llm.common import kept, mapped, new_path
from mailpolicy.llm.tokens import encoder

MAGIC, SUFFIX = b"WAVEMAT1", ".wavemat"
SHARD_TOKENS = 1 << 20
#: Pieces that a worker keeps in mind between the tasks that write.
REMEMBERED = 400_000
_BLOCK = 8  # words to an entry of the directory


class Wavelet:
    """Sequence of ids with rank and select."""

    def __init__(self, n: int, zeros: list[int], words: list[np.ndarray], ones: list[np.ndarray]):
        self.n, self.zeros, self.words, self.ones = n, zeros, words, ones

    @classmethod
    def of(cls, ids: np.ndarray, planes: int | None = None) -> Wavelet:
        planes = planes or max(1, int(ids.max(initial=0)).bit_length())
        x = ids.astype(np.uint16 if planes <= 16 else np.uint32)
        zeros, words, ones = [], [], []
        for level in reversed(range(planes)):
            bit = (x & x.dtype.type(1 << level)) != 0
            packed = np.zeros(-(-len(x) // 64) * 8, np.uint8)
            bits = np.packbits(bit, bitorder="little")
            packed[: len(bits)] = bits
            w = packed.view("<u8")
            counts = np.bitwise_count(w)
            sums = np.add.reduceat(counts, np.arange(0, len(w), _BLOCK), dtype=np.uint32) if len(w) else np.empty(0, np.uint32)
            words.append(w)
            ones.append(np.r_[0, np.cumsum(sums)].astype("<u4"))
            zeros.append(int(len(x) - ones[-1][-1]))
            # By places: dealing by them takes less time than by the bits.
            x = np.concatenate([x.take(np.flatnonzero(~bit)), x.take(np.flatnonzero(bit))])
        return cls(len(ids), zeros, words, ones)

    def _ones(self, level: int, i: int) -> int:
        """Ones before place ``i`` of a plane."""
        w, block = i >> 6, (i >> 6) // _BLOCK
        n = int(self.ones[level][block]) + sum(int(x).bit_count() for x in self.words[level][block * _BLOCK : w])
        return n + (int(self.words[level][w]) & ((1 << (i & 63)) - 1)).bit_count() if i & 63 else n

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level, zeros in enumerate(self.zeros):
            bit = int(self.words[level][i >> 6]) >> (i & 63) & 1
            ones = self._ones(level, i)
            out, i = out << 1 | bit, zeros + ones if bit else i - ones
        return out

    def _range(self, symbol: int, i: int) -> tuple[int, int]:
        """Where the occurrences of an id before place ``i`` lie below the last plane."""
        lo, hi, last = 0, i, len(self.zeros) - 1
        if symbol >> len(self.zeros):
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (zeros + a, zeros + b) if symbol >> (last - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of an id before place ``i``."""
        lo, hi = self._range(symbol, i)
        return hi - lo

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) ``bit`` of a plane."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._ones(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def select(self, symbol: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of an id."""
        lo, hi = self._range(symbol, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i, last = lo + k, len(self.zeros) - 1
        for level in reversed(range(len(self.zeros))):
            bit = symbol >> (last - level) & 1
            i = self._select_bit(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def ids(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        x = np.zeros(self.n, np.uint16 if len(self.zeros) <= 16 else np.uint32)
        for shift, level in enumerate(reversed(range(len(self.zeros)))):
            bit = np.unpackbits(self.words[level].view(np.uint8), count=self.n, bitorder="little").view(bool)
            y, x = x, np.empty_like(x)
            y[self.zeros[level] :] |= x.dtype.type(1 << shift)
            x[np.flatnonzero(~bit)] = y[: self.zeros[level]]
            x[np.flatnonzero(bit)] = y[self.zeros[level] :]
        return x.astype("<u4")


def to_file(ids: np.ndarray, doc_ids: list[int | None], counts: list[int], task: int = 0, number: int = 0, planes: int | None = None) -> bytes:
    w = Wavelet.of(ids, planes)
    head = [MAGIC, struct.pack("<5Q", w.n, len(w.zeros), len(counts), task, number), np.array(counts, "<u8").tobytes()]
    head += [bytes(d is not None for d in doc_ids), np.array([d or 0 for d in doc_ids], "<i8").tobytes()]
    for zeros, words, ones in zip(w.zeros, w.words, w.ones):
        head += [struct.pack("<Q", zeros), words.tobytes(), ones.tobytes()]
    return b"".join(head)


def from_file(data: bytes) -> tuple[Wavelet, list[int | None], np.ndarray, int, int]:
    """The wavelet matrix, doc_ids, token counts, task and number of a file."""
    if data[:8] != MAGIC:
        raise ValueError("not a wavelet-matrix file")
    n, planes, docs, task, number = struct.unpack_from("<5Q", data, 8)
    at = 48

    def take(kind: str, many: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, many, at)
        at += out.nbytes
        return out

    counts, has, ids = take("<u8", docs), take("u1", docs), take("<i8", docs)
    n_words = -(-n // 64)
    zeros, words, ones = [], [], []
    for _ in range(planes):
        zeros.append(int(take("<u8", 1)[0]))
        words.append(take("<u8", n_words))
        ones.append(take("<u4", -(-n_words // _BLOCK) + 1))
    doc_ids = [i if h else None for i, h in zip(ids.tolist(), has.tolist())]
    return Wavelet(n, zeros, words, ones), doc_ids, counts, task, number


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, cut: str, end_id: int, shard: int, planes: int) -> Iterator[pa.RecordBatch]:
    known, task = encoder(path, cut), TaskContext.get().partitionId()
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    end, parts, doc_ids, counts, number, held = np.array([end_id], "<u4").tobytes(), [], [], [], 0, 0

    def flush() -> pa.RecordBatch:
        data = to_file(np.frombuffer(b"".join(parts), "<u4"), doc_ids, counts, task, number, planes)
        name = f"{root}/{task:06d}-{number:06d}"
        # A task that runs twice writes the same bytes; the move makes each file appear whole.
        with store.open_output_stream(part := f"{name}.{uuid.uuid4().hex}.part") as f:
            f.write(data)
        store.move(part, name + SUFFIX)
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (task, number, sum(counts))], names=["task", "number", "n"])

    for b in batches:
        for d, ids in zip(b.column(0).to_pylist(), known.encode_all(t.as_py() for t in b.column(1))):
            ids += end
            parts.append(ids)
            doc_ids.append(d)
            counts.append(len(ids) // 4)
            held += counts[-1]
            if held >= shard:
                yield flush()
                parts, doc_ids, counts, number, held = [], [], [], number + 1, 0
    if parts:
        yield flush()
    known.settle(REMEMBERED)


def write(docs: DataFrame, folder: str, path: str, cut: str = "none", end_id: int = 2, shard: int = SHARD_TOKENS) -> DataFrame:
    """Writes ids of all ``docs`` by ascending doc_id to files in ``folder``; task, number, n (tokens) of each file.

    A document is its ids by the tokenizers file ``path``, then ``end_id``; null and empty texts are the end token alone. A null
    doc_id goes first; rows of one doc_id in any order. A document is never divided: a shard ends with the one that fills it. An
    empty table writes no files. Other columns are not looked at.
    """
    planes = 16 if max(encoder(path, cut).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 32
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").orderBy("doc_id")
    return kept(mapped(ordered, lambda it: _write(it, folder, path, cut, end_id, shard, planes), "task long, number long, n long"), "shards")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b.column(0):
            w, doc_ids, counts, task, number = from_file(content.as_py())
            ids = w.ids()
            ends = np.cumsum(counts.astype(np.int64))
            starts = ends - counts.astype(np.int64)
            crcs = [zlib.crc32(ids[a:e].tobytes()) for a, e in zip(starts.tolist(), ends.tolist())]
            n = len(crcs)
            yield pa.RecordBatch.from_arrays([pa.array([task] * n, pa.int64()), pa.array([number] * n, pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(counts.astype(np.int64)), pa.array(crcs, pa.int64())], names=["task", "number", "doc_id", "inside", "n_tokens", "ids_crc32"])


def read(folder: str, shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that ``shards`` (the result of ``write``) lists."""
    spark = shards.sparkSession
    totals = shards.groupBy("task").agg(F.sum("n").alias("total"))  # a row for each task of the writing job
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("task").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    first = totals.select("task", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("of_task"))
    starts = shards.select("task", "number", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("of_shard")).join(first, "task")
    if shards.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder).select("content")
    found = mapped(files, _read, "task long, number long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["task", "number"]).select("doc_id", (F.col("of_task") + F.col("of_shard") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str, cut: str = "none", end_id: int = 2, shard: int = SHARD_TOKENS) -> DataFrame:
    """Writes ``docs`` to a new folder among the shared ones and reads its files back; columns of ``read``, edge cases of ``write``."""
    folder = new_path(docs.sparkSession, "wavelet")
    return read(folder, write(docs, folder, path, cut, end_id, shard))
