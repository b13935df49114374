"""SimHash near-duplicates with a bit-sliced comparison.

Fingerprints are made distinct first. Of six parts of the 64 bits, two fingerprints that differ in at most two bits share at least
four, so they meet in one of fifteen buckets, each named by four parts: every link is found. A bucket fixes at least 42 bits, so it
holds at most 2^22 distinct fingerprints however many documents there are. In a bucket the bits of all fingerprints lie in vertical
planes, 64 fingerprints to a machine word; a query adds its difference planes into carry-save counters, and blocks in which every lane
has exceeded the radius are dropped. A link is given by one bucket only. Groups are the components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailpolicy.llm.common import kept, mapped

#: First bit and number of bits of the six parts.
PARTS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
MASKS = tuple(((1 << n) - 1) << at for at, n in PARTS)
SHARED = tuple(combinations(range(6), 4))
RADIUS = 2


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash over word shingles; words are split at ASCII white space and A-Z lower-cased. No words: 0."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return 0
    h = xxhash.xxh64_intdigest
    if len(w) <= shingle:
        return h(b" ".join(w), 42)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = (ends - np.fromiter(map(len, w), np.int64, len(w)) - 1).tolist()
    ends = (ends - 1).tolist()
    hashes = np.fromiter((h(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :])), np.uint64, len(w) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(values.view(np.int64))], names=["doc_id", "fp"])


def _planes(values: np.ndarray) -> np.ndarray:
    """Row b: bit b of all values, 64 of them to a word; the last word is filled up with zeros."""
    words = -(-len(values) // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _within(planes: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """A word of lanes for each query and block of 64 values: the lanes that are within the radius.

    ``counters[j]`` has the lanes in which bit j of the distance is set; a carry out of the last counter that the radius needs stays in ``over``.
    """
    n, full = planes.shape[1], np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.zeros((len(queries), n), np.uint64)
    q, block = (x.ravel() for x in np.indices((len(queries), n)))
    counters = [np.zeros(len(q), np.uint64) for _ in range(max(1, radius.bit_length()))]
    over = np.zeros(len(q), np.uint64)
    for bit in range(64):
        carry = planes[bit, block] ^ (full * ((queries[q] >> np.uint64(bit)) & np.uint64(1)))
        for j, c in enumerate(counters):
            counters[j], carry = c ^ carry, c & carry
        over |= carry
        if bit % 8 == 7:
            past = over | _above(counters, radius)
            alive = past != full
            if not alive.all():
                q, block, over = q[alive], block[alive], over[alive]
                counters = [c[alive] for c in counters]
            if not len(q):
                return out
    out[q, block] = ~(over | _above(counters, radius))
    return out


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is over the radius."""
    above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], 0xFFFFFFFFFFFFFFFF)
    for j in reversed(range(len(counters))):
        if radius >> j & 1:
            equal &= counters[j]
        else:
            above |= equal & counters[j]
            equal &= ~counters[j]
    return above


def _bucket_links(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of values within the radius."""
    planes, lo, hi = _planes(values), [], []
    step = max(1, 200_000 // planes.shape[1])
    for at in range(0, len(values), step):
        lanes = _within(planes, values[at : at + step], radius)
        qi, word = np.nonzero(lanes)
        bits = np.unpackbits(lanes[qi, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        k, lane = np.nonzero(bits)
        i, j = qi[k] + at, word[k] * 64 + lane
        good = (i < j) & (j < len(values))
        lo.append(i[good])
        hi.append(j[good])
    return np.concatenate(lo), np.concatenate(hi)


def _first_shared(x: np.ndarray) -> np.ndarray:
    """Number of the first bucket in which two values of difference ``x`` meet; 15 if they meet in none."""
    out = np.full(len(x), len(SHARED))
    for number in reversed(range(len(SHARED))):
        mask = np.uint64(sum(MASKS[p] for p in SHARED[number]))
        out[(x & mask) == 0] = number
    return out


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """From rows that are sorted by (bucket, key), links within each bucket. The last, maybe open, bucket of a batch is carried on."""
    names, rest = ["a", "b"], None

    def linked(bucket, key, fp, node):
        edges = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1])]) if len(key) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[edges, len(key)])
        out_a, out_b = [], []
        for start, n in zip(edges[sizes > 1], sizes[sizes > 1]):
            v, d = fp[start : start + n], node[start : start + n]
            i, j = _bucket_links(v, radius)
            mine = _first_shared(v[i] ^ v[j]) == bucket[start]
            out_a.append(d[i[mine]])
            out_b.append(d[j[mine]])
        if out_a:
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=names)

    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        now[2] = now[2].view(np.uint64)
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now)]
        if not len(now[0]):
            continue
        same = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
        cut = len(same) if not same.any() else int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        yield from linked(*(x[:cut] for x in now))
        rest = [x[cut:] for x in now]
    if rest is not None:
        yield from linked(*rest)


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): nodes whose fingerprints differ in at most ``radius`` (0 to 2) bits. ``nodes``: node, fp, both distinct and not null."""
    if not 0 <= radius <= RADIUS:
        raise ValueError("the six parts serve a radius of 0 to 2")
    masks = [sum(MASKS[p] for p in s) for s in SHARED]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    buckets = F.array(*(F.struct(F.lit(i).alias("bucket"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("key")) for i, m in enumerate(masks)))
    rows = nodes.select("fp", "node", F.explode(buckets).alias("x")).select("x.bucket", "x.key", "fp", "node")
    sorted_rows = rows.repartition("bucket", "key").sortWithinPartitions("bucket", "key")
    return mapped(sorted_rows, lambda it: _links(it, radius), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches. Nodes without edges are not among them.

    Rounds of: take the smallest label among the neighbours, then the label of that label. A written table ends each round's lineage.
    """
    both = kept(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other").distinct(), "edges")
    labels = kept(both.groupBy("node").agg(F.min("other").alias("o")).select("node", F.least("node", "o").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("near")), "other").groupBy("node").agg(F.min("near").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        lower = kept(lower, "lower")
        onward = lower.select(F.col("node").alias("label"), F.col("label").alias("onward"))
        fresh = kept(lower.join(onward, "label", "left").select("node", "was", F.least("label", "onward").alias("label")), "labels")
        labels = fresh.select("node", "label")
        if fresh.filter(F.col("was") != F.col("label")).isEmpty():
            return labels.withColumnRenamed("label", "component")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp, the SimHash as a signed long."""
    return mapped(docs.select("doc_id", "text"), lambda it: _fingerprints(it, shingle), "doc_id long, fp long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id for each row of ``docs``: the smallest doc_id reached over links of at most ``radius`` bits.

    Null and empty texts have fingerprint 0 and link like any other. Rows without a doc_id get the component of their fingerprint,
    but reach nobody by themselves: where no row with a doc_id has that fingerprint, component_id is null. Repeated rows are
    returned as often as they occur. An empty table gives no rows. Other columns are not looked at.
    """
    prints = kept(fingerprints(docs, shingle), "prints")
    classes = kept(prints.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "classes")
    nodes = classes.filter(F.col("node").isNotNull()).select("node", "fp")
    found = components(kept(links(nodes, radius), "links"))
    # Only classes of several rows or with links say something that a row does not know by itself.
    linked = classes.join(found, "node", "left").filter((F.col("n") > 1) | F.col("component").isNotNull())
    linked = kept(linked.select("fp", F.coalesce("component", "node").alias("component")), "linked")
    return prints.join(linked, "fp", "left").select("doc_id", "fp", F.coalesce("component", "doc_id").alias("component_id"))
