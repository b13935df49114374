"""Importance resampling towards a target: hashed n-gram features, a gain for each bucket, Gumbel noise, the highest scores drawn.

A feature's bucket is the CRC-32 of its bytes. CRCs are worked out for many features at once: distinct features of equal length form
a two-dimensional array of bytes, one row a feature, whose CRCs are updated column by column and scattered back to the features.
Features beyond a fixed length are rows of several chunks, whose CRCs are put together by the linear map that a chunk of zeros is.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailpolicy.llm.common import WORD_BYTES, kept, mapped

BUCKETS = 10_000
#: The polynomial of CRC-32, bits reversed: a fixed value.
POLYNOMIAL = 0xEDB88320
#: Longer features are cut into chunks of this many bytes.
CHUNK = 256
#: Bytes of text whose words are held at a time, and features whose buckets a worker remembers.
PIECE, REMEMBERED = 1 << 20, 300_000
#: Rows in a task of the ranking.
RANKED_ROWS = 1 << 20


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The CRC step of each byte, and the CRC registers that ``CHUNK`` zero bytes make of each byte of a register."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = (step >> np.uint32(1)) ^ np.where(step & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    passed = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for _ in range(CHUNK):
        passed = step[passed & np.uint32(255)] ^ (passed >> np.uint32(8))
    return step, passed


def _columns(rows: np.ndarray, state: int) -> np.ndarray:
    """CRC registers of all rows of a matrix of bytes, updated column by column."""
    step = _tables()[0]
    crc = np.full(len(rows), state, np.uint32)
    for column in np.ascontiguousarray(rows.T):
        crc = step[(crc ^ column) & np.uint32(255)] ^ (crc >> np.uint32(8))
    return crc


def crc32s(features: list[bytes]) -> np.ndarray:
    """Unsigned CRC-32 of each feature, by matrices of features of equal length."""
    lengths = np.fromiter(map(len, features), np.int64, len(features))
    out = np.zeros(len(features), np.uint32)
    # Long ones: a register of zeros passes over zero bytes unchanged, so chunks are filled up in front; the usual first register,
    # all ones, is the same as four inverted first bytes.
    size = np.where(lengths > CHUNK, -(-lengths // CHUNK), -lengths)
    order = np.argsort(size, kind="stable")
    for same in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else []:
        n = int(size[same[0]])
        if n <= 0:
            rows = np.frombuffer(b"".join([features[i] for i in same]), np.uint8).reshape(len(same), -n)
            out[same] = ~_columns(rows, 0xFFFFFFFF)
            continue
        filled = np.frombuffer(b"".join([features[i].rjust(n * CHUNK, b"\0") for i in same]), np.uint8).reshape(len(same), n * CHUNK).copy()
        at = n * CHUNK - lengths[same]
        filled[np.arange(len(same))[:, None], at[:, None] + np.arange(4)] ^= np.uint8(255)
        chunks = _columns(filled.reshape(-1, CHUNK), 0).reshape(len(same), n)
        passed = _tables()[1]
        crc = np.zeros(len(same), np.uint32)
        for j in range(n):
            moved = passed[0, crc & np.uint32(255)]
            for byte in (1, 2, 3):
                moved = moved ^ passed[byte, (crc >> np.uint32(8 * byte)) & np.uint32(255)]
            crc = moved ^ chunks[:, j]
        out[same] = ~crc
    return out


class _Buckets(dict):
    """Bucket of each feature met; forgets all when it has grown to ``REMEMBERED``, so memory stays bounded."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def of(self, held: list[list[bytes]]) -> list[np.ndarray]:
        distinct = set().union(*held)
        if len(self) + len(distinct) > REMEMBERED:
            self.clear()
        fresh = [x for x in distinct if x not in self]
        self.update(zip(fresh, (crc32s(fresh) % np.uint32(self.buckets)).tolist()))
        return [np.fromiter(map(self.__getitem__, x), np.int64, len(x)) for x in held]


def _cuts(text: bytes) -> Iterator[bytes]:
    """A text of words and spaces in pieces of about ``PIECE`` bytes, cut at spaces."""
    start = 0
    while len(text) - start > PIECE:
        end = text.find(b" ", start + PIECE)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:]


def _features(text: str | None, most: int) -> Iterator[tuple[list[bytes], int]]:
    """Features of a text, a piece at a time, with the number of new words; runs of words over a border belong to the later piece."""
    before: list[bytes] = []
    for piece in _cuts(text.encode("utf-8", "surrogatepass").translate(WORD_BYTES)) if text else ():
        new = piece.split()
        found = list(new)
        w = before + new
        for n in range(2, most + 1):
            begin = max(0, len(before) - n + 1)
            found += [b" ".join(w[i : i + n]) for i in range(begin, len(w) - n + 1)]
        before = w[max(0, len(w) - most + 1) :] if most > 1 else []
        yield found, len(new)


def _bucketed(texts, most: int, buckets: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """Of pieces of the texts: number of the text, buckets of its features, number of words. Each text has one piece at least."""
    known, held, size = _Buckets(buckets), [], 0

    def done():
        return zip([x[0] for x in held], known.of([x[1] for x in held]), [x[2] for x in held])

    for number, text in enumerate(texts):
        empty = True
        for found, n in _features(text, most):
            held.append((number, found, n))
            size += n
            empty = False
            if size >= PIECE // 4:
                yield from done()
                held, size = [], 0
        if empty:
            held.append((number, [], 0))
    yield from done()


def _count(batches: Iterator[pa.RecordBatch], most: int, buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        for _, found, _ in _bucketed((t.as_py() for t in batch.column(0)), most, buckets):
            total += np.bincount(found, minlength=buckets)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])


def counted(docs: DataFrame, most: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all texts; a task gives one row a bucket at most, so what moves is bounded by tasks times buckets."""
    rows = mapped(docs.select("text"), lambda it: _count(it, most, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    out[[r.bucket for r in rows]] = [r.n for r in rows]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight: thousand times the log of the smoothed ratio of its shares, rounded down."""
    s, t, buckets = float(raw.sum()), float(target.sum()), len(raw)
    ratio = [(b + 1.0) * (s + buckets) / ((a + 1.0) * (t + buckets)) for a, b in zip(raw.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    """Gumbel noise of a document in thousandths, from a digest of its id; without an id, of nothing behind the colon."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weigh(batches: Iterator[pa.RecordBatch], gain: np.ndarray, most: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        sums = np.zeros((3, len(ids)), np.int64)
        for number, found, n in _bucketed((t.as_py() for t in batch.column(1)), most, len(gain)):
            sums[:, number] += (len(found), n, gain[found].sum())
        noises = np.fromiter(map(noise, repeat(seed), ids), np.int64, len(ids))
        columns = [pa.array(ids, pa.int64()), *map(pa.array, (sums[0], sums[1], sums[2], sums[2] + noises))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_features", "n_words", "weight", "score"])


def ranked(scored: DataFrame, percent: int) -> DataFrame:
    """``rank`` (from 1) of the floor(``percent`` * rows / 100) highest scores, ties to the smaller doc_id; null for the rest.

    Rows are dealt into ranges of their order, which ends in a row number, so that no value can make a range large; a rank is the
    place in the range behind the rows of the ranges before it.
    """
    rows = kept(scored.withColumn("__row", F.monotonically_increasing_id()), "scored")
    n = rows.count()
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("__row")]
    dealt = rows.repartitionByRange(max(1, -(-n // RANKED_ROWS)), *order).sortWithinPartitions(*order)
    # Part and place in it, from the one number that Spark gives to rows in their order.
    placed = kept(dealt.withColumn("__at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    # One row a range of a million rows.
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("__part", before.alias("__before")))
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    rank = F.when(place <= percent * n // 100, place)
    return placed.join(starts, part == F.col("__part")).select(*scored.columns, rank.alias("rank"))


def resample(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = BUCKETS, least: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, n_words, weight, score, rank of every row of ``docs``; drawn are the rows with a rank.

    Features are all runs of 1 to ``most`` consecutive words of the whole text, repeats counted. A weight is the sum of its features'
    gains, the log ratio of a bucket's share in ``target`` (with column text) and in ``docs``; a score is the weight and Gumbel noise, so
    the highest scores are a draw without replacement in proportion to exp(weight / 1000). Of the documents of ``least`` words or more,
    ``percent`` in a hundred are drawn.

    Null and empty texts have no features and weight 0. Rows without doc_id share one noise and come last among ties; repeated rows have
    equal scores and ranks next to each other. Empty tables give no rows, and without target texts shares are smoothed to equal ones. Other
    columns are not looked at. Two passes over the texts; what moves is a row a bucket and task, and a row of numbers a document.
    """
    gain = gains(counted(docs, most, buckets), counted(target, most, buckets))
    weighed = mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lambda it: _weigh(it, gain, most, seed), "doc_id long, n_features long, n_words long, weight long, score long")
    scored = kept(weighed, "weighed")
    few = F.col("n_words") < least
    return ranked(scored.filter(~few), percent).union(scored.filter(few).withColumn("rank", F.lit(None).cast("long")))
