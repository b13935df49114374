"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

A vector's components are its terms. For a block of queries and a batch of candidates, each term's query weights are scattered,
times its postings in the batch, into a dense score array; the k best of every batch go on, and the best of those are the result.
Queries are few against the candidates but grow with them, so they are broadcast in blocks of a fixed number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailpolicy.llm.common import kept, mapped, scaled_integers

QUERY_BLOCK = 2048
#: Scores held at a time are at most this many.
SCORES = 4_000_000
_FOUND = "query_row long, query_id long, vec_id long, score long, key binary"


def usable(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and terms, the components as doubles; rows without id, or with a null or non-finite component, are left out."""
    v = F.col(vector)
    fits = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.filter(fits & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("vec_id"), F.transform(v, lambda x: x.cast("double")).alias("terms"))


def _matrix(terms: list, width: int, scale: int) -> np.ndarray:
    """floor(scale * component), exact at any size; what is beyond a vector's end is 0."""
    out = np.zeros((len(terms), width))
    for i, row in enumerate(terms):
        out[i, : min(len(row), width)] = row[:width]
    return scaled_integers(out, scale)


def _largest(m: np.ndarray) -> int:
    return max((abs(int(x)) for x in (m.min(), m.max())), default=0) if m.size else 0


def _key(score: int) -> bytes:
    """Bytes in the order of the scores, whatever their size: length and sign before the number, turned over below 0."""
    n = abs(score)
    size = (n.bit_length() + 7) // 8
    if score >= 0:
        return (0x8000 + size).to_bytes(2) + n.to_bytes(size)
    return (0x8000 - size).to_bytes(2) + bytes(255 - b for b in n.to_bytes(size))


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k best scores whose id is not ``own``; ties go to the smaller id."""
    allowed = np.flatnonzero(ids != own)
    s = scores[allowed]
    if s.dtype == object:
        return np.array(sorted(allowed.tolist(), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    if len(s) > k:
        least = np.partition(s, len(s) - k)[len(s) - k]
        near = np.flatnonzero(s >= least)
        allowed, s = allowed[near], s[near]
    return allowed[np.lexsort((ids[allowed], -s))[:k]]


def _search(batches: Iterator[pa.RecordBatch], block, k: int, scale: int) -> Iterator[pa.RecordBatch]:
    rows, query_ids, q = block.value
    step = max(1, SCORES // max(1, len(rows)))
    for whole in batches:
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            c = _matrix(batch.column(1).to_numpy(zero_copy_only=False), q.shape[1], scale)
            # 64-bit numbers where no score can leave them, Python's beyond.
            kind = np.int64 if q.shape[1] * _largest(q) * _largest(c) < 2**62 else object
            w, c = q.astype(kind), c.astype(kind)
            scores = np.zeros((len(rows), len(ids)), kind)
            for term in range(q.shape[1]):
                weights, postings = np.flatnonzero(w[:, term]), np.flatnonzero(c[:, term])
                if len(weights) == len(rows) and len(postings) == len(ids):
                    scores += w[:, term, None] * c[None, :, term]
                elif len(weights) and len(postings):
                    scores[np.ix_(weights, postings)] += w[weights, term][:, None] * c[postings, term][None, :]
            found = [_best(scores[i], ids, query_ids[i], k) for i in range(len(rows))]
            n = [len(x) for x in found]
            at_row = np.repeat(np.arange(len(rows)), n)
            places = np.concatenate(found) if found else np.empty(0, np.int64)
            best = scores[at_row, places].tolist()
            columns = [pa.array(x, pa.int64()) for x in (rows[at_row], query_ids[at_row], ids[places], [x if -(2**63) <= x < 2**63 else None for x in best])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(map(_key, best)), pa.binary())], names=["query_row", "query_id", "vec_id", "score", "key"])


def search(vectors: DataFrame, queries, k: int = 10, scale: int = 1024, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` best rows for every row of ``vectors`` for which ``queries`` holds.

    Score: inner product of floor(``scale`` * component); ties go to the smaller vec_id; a query is no candidate for itself, nor
    is any row of its id. Rows with a null id, a null vector or a null, NaN or infinite component take no part. Vectors of different
    lengths are multiplied over the components both have. Scores of any size are exact and ranked; one that is no long is null. Equal rows of one query id are
    one query; different vectors under one id are ranked apart, under that id. A repeated candidate row counts as often as it occurs.
    Fewer than ``k`` candidates give as many rows; an empty table or no query gives none. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    terms = usable(vectors)
    asked = kept(terms.filter(queries).distinct().withColumn("row", F.monotonically_increasing_id()), "queries")
    # Query rows come to the driver a block at a time; a hash deals them out, so a block holds about `block` rows however many there are.
    blocks = max(1, -(-asked.count() // block))
    found = None
    for number in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == number).collect()
        if not mine:
            continue
        width = max(len(r.terms) for r in mine)
        value = (np.array([r.row for r in mine]), np.array([r.vec_id for r in mine]), _matrix([r.terms for r in mine], width, scale))
        shared = spark.sparkContext.broadcast(value)
        part = mapped(terms, lambda it, b=shared: _search(it, b, k, scale), _FOUND)
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], _FOUND)
    ranked = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("key"), "vec_id"))
    return found.withColumn("rank", ranked).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
