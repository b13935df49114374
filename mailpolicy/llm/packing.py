"""Packing of documents into training sequences by patterns that non-negative least squares chooses.

Documents become token ids with an end token; longer ones are cut. The histogram of piece lengths, of at most ``size`` rows however many
documents there are, is all that packing needs: patterns of up to four lengths (in steps of 1/64 of a sequence) that fill a sequence are
enumerated, non-negative least squares fits how often each is used, counts are rounded down and real lengths put into them. What is
left over goes, longest first, into the smallest gap that takes it. The outcome is a list of runs: so many equal sequences. A piece
finds its place from its rank among pieces of its length, which partial counts give without a sort.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailpolicy.llm.common import kept, mapped
from mailpolicy.llm.tokens import encoder

STEPS, MOST_PARTS = 64, 4
#: Tried one after the other: pieces of under this share of a sequence are left to fill gaps. The plan of fewest sequences is taken.
LEFT_OUT = (0.0, 1 / 16, 1 / 8, 1 / 4, 3 / 8, 1 / 2)


def patterns(steps: int = STEPS, parts: int = MOST_PARTS) -> np.ndarray:
    """Columns: how many of each length 1..steps a pattern of at most ``parts`` lengths that add up to ``steps`` has."""
    out: list[tuple[int, ...]] = []

    def add(rest: int, largest: int, chosen: tuple[int, ...]) -> None:
        if rest == 0:
            out.append(chosen)
        elif len(chosen) < parts:
            for x in range(min(rest, largest), 0, -1):
                if x * (parts - len(chosen)) < rest:
                    break
                add(rest - x, x, (*chosen, x))

    add(steps, steps, ())
    table = np.zeros((steps, len(out)))
    for j, p in enumerate(out):
        for x in p:
            table[x - 1, j] += 1
    return table


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that makes |a x - b| least, by an active set."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    gram, right = a.T @ a, a.T @ b
    tolerance = 1e-9 * max(1.0, np.abs(right).max(initial=0))
    for _ in range(rounds):
        slope = np.where(active, -np.inf, right - gram @ x)
        j = int(slope.argmax())
        if slope[j] <= tolerance:
            break
        active[j] = True
        while True:
            at = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            ratio = x[at][low] / np.maximum(x[at][low] - s[low], 1e-300)
            x[at] += ratio.min() * (s - x[at])
            active[at[(x[at] <= 1e-12) & low]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def _from_patterns(left: Counter, size: int, least: float, table: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Runs (lengths, how often) that the fitted patterns make; takes their lengths out of ``left``."""
    steps = table.shape[0]
    bin_of = lambda n: -(-n * steps // size)  # noqa: E731  rounded up, so a pattern always fits
    bins: dict[int, list[int]] = defaultdict(list)
    goal = np.zeros(steps)
    for n in sorted(left):
        if n >= least * size:
            bins[bin_of(n)].append(n)
            goal[bin_of(n) - 1] += left[n]
    weight = np.sqrt(np.arange(1, steps + 1) / steps)  # short ones fill gaps as well
    possible = ((table > 0) <= (goal > 0)[:, None]).all(axis=0)
    chosen = np.flatnonzero(possible)
    if not len(chosen) or not goal.any():
        return []
    times = np.zeros(table.shape[1])
    times[chosen] = nnls(table[:, chosen] * weight[:, None], goal * weight / goal.max()) * goal.max()
    runs = []
    for j in np.flatnonzero(times >= 1):
        rest = int(times[j])
        parts = [b + 1 for b in np.flatnonzero(table[:, j]) for _ in range(int(table[b, j]))]
        while rest > 0:
            # From the long and the short end of the bins in turn, so that sums stay near each other.
            lengths = tuple(bins[b][-1 if i % 2 == 0 else 0] for i, b in enumerate(parts) if bins[b])
            if len(lengths) < len(parts):
                break
            need = Counter(lengths)
            n = min(rest, *(left[x] // c for x, c in need.items()))
            if n == 0:
                break
            runs.append((lengths, n))
            rest -= n
            for x, c in need.items():
                left[x] -= n * c
                if not left[x]:
                    bins[bin_of(x)].remove(x)
    return runs


def packed(histogram: dict[int, int], size: int, least: float = 0.0, table: np.ndarray | None = None) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Runs: ((length, copies), ...) of a sequence, and how many sequences are like that. Each length is at most ``size``."""
    left = Counter({n: c for n, c in histogram.items() if c})
    gaps: list[int] = []  # sorted; open[gap] has the runs of that gap
    opened: dict[int, Counter] = defaultdict(Counter)

    def put(content: tuple, gap: int, n: int) -> None:
        if gap not in opened or not opened[gap]:
            insort(gaps, gap)
        opened[gap][content] += n

    for lengths, n in _from_patterns(left, size, least, patterns() if table is None else table):
        put(tuple(sorted(Counter(lengths).items(), reverse=True)), size - sum(lengths), n)
    for length in sorted((n for n in left if left[n]), reverse=True):
        rest = left[length]
        while rest:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                put((), size, -(-rest // (size // length)))
                continue
            gap = gaps[at]
            content, n = next(iter(opened[gap].items()))
            each = min(gap // length, rest)
            used = min(n, rest // each)
            opened[gap][content] -= used
            if not opened[gap][content]:
                del opened[gap][content]
            if not opened[gap]:
                gaps.pop(at)
            put((*content, (length, each)), gap - each * length, used)
            rest -= used * each
    return [(content, n) for runs in opened.values() for content, n in runs.items() if content]


def fewest(histogram: dict[int, int], size: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """The plan of fewest sequences among those of LEFT_OUT."""
    table = patterns()
    return min((packed(histogram, size, least, table) for least in LEFT_OUT), key=lambda runs: sum(n for _, n in runs))


def _places(runs) -> np.ndarray:
    """Rows (length, first rank, copies, first sequence, offset), sorted: where pieces of a length go from that rank on."""
    rank, sequence, rows = Counter(), 0, []
    for content, n in runs:
        offset = 0
        for length, copies in content:
            rows.append((length, rank[length], copies, sequence, offset))
            rank[length] += n * copies
            offset += length * copies
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, cut: str, end_id: int, size: int, keep_ids: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
    known, task, seen = encoder(path, cut), TaskContext.get().partitionId(), Counter()
    end = np.array([end_id], "<u4").tobytes()
    for b in batches:
        row, out = [], []
        for i, ids in enumerate(known.encode_all(t.as_py() for t in b.column(2))):
            ids += end
            for piece, at in enumerate(range(0, len(ids), 4 * size)):
                part = ids[at : at + 4 * size]
                n = len(part) // 4
                row.append(i)
                out.append((piece, at // 4, n, zlib.crc32(part), seen[n], part if keep_ids else None))
                seen[n] += 1
        columns = list(zip(*out)) if out else [()] * 6
        arrays = [b.column(j).take(pa.array(row, pa.int32())) for j in range(2)]
        arrays += [pa.array(columns[0], pa.int32()), *(pa.array(columns[j], pa.int64()) for j in range(1, 5)), pa.array([task] * len(out), pa.int32())]
        yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(columns[5], pa.binary())] if keep_ids else [])], names=names)
    known.settle()


def pack(docs: DataFrame, path: str, cut: str = "none", end_id: int = 1, size: int = 4096, keep_ids: bool = False) -> DataFrame:
    """Per piece: row (a number of its document), doc_id, piece, start, length, ids_crc32, sequence_id, offset; with ``keep_ids`` ids.

    A document is its ids by the tokenizers file ``path``, then ``end_id``; null and empty texts are the end token alone. Only documents
    of more than ``size`` tokens are cut, into pieces of ``size`` and a shorter last one. Pieces of a sequence lie side by side from
    offset 0; equal lengths are dealt out in any order. Null doc_ids and repeated rows are packed like others; an empty table gives
    no rows; other columns are not looked at. ``ids`` are little-endian unsigned 32-bit numbers; ``sequences`` puts them together.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shape = [("row", "long"), ("doc_id", id_type), ("piece", "int"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("nth", "long"), ("task", "int"), *([("ids", "binary")] if keep_ids else [])]
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    names = [c for c, _ in shape]
    pieces = kept(mapped(numbered, lambda it: _pieces(it, path, cut, end_id, size, keep_ids, names), ", ".join(map(" ".join, shape))), "pieces")

    counts = kept(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    places = spark.sparkContext.broadcast(_places(fewest(histogram, size)))  # a few thousand rows, bounded by lengths and patterns
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(counts.select("task", "length", before.alias("before")), ["task", "length"])
    columns = ["row", "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    placed = ranked.select(*columns, (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        keys = table[:, 0] * 2**48 + table[:, 1]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = table[np.searchsorted(keys, length * 2**48 + rank, side="right") - 1]
            nth = rank - at[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(at[:, 3] + nth // at[:, 2]), pa.array(at[:, 4] + nth % at[:, 2] * length)], names=[*b.schema.names[:-1], "sequence_id", "offset"])

    kinds = dict(shape)
    return mapped(placed, place, ", ".join([*(f"{c} {kinds[c]}" for c in columns), "sequence_id long", "offset long"]))


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids (array of long) of every packed sequence, from ``pack(..., keep_ids=True)``."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype(np.int64) for parts in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=["sequence_id", "n_tokens", "ids"])

    parts = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return mapped(parts, joined, "sequence_id long, n_tokens long, ids array<long>")
