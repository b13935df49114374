"""Language-model scores: a maximum-entropy model over hashed n-gram and skip features, with a softmax factored by classes.

A token's history gives features: the token before, the pair before, and the tokens two and three places before. The token's class has a
softmax over sums of weights of the features; for the frequent words a second softmax gives the word in its class, over weights of the
features joined with the class. Weights lie in tables of fixed size at hashed rows. Classes hold frequent words of neighbouring ranks; all
other words, known or not, are in classes by their last bytes, where a word has its smoothed share of the class. So the model is a
distribution over all tokens, and what a task needs of it is of bounded size at any size of the corpus.

Both softmaxes start at the class and word shares counted over the whole training text. Each shard of the training text then makes its own
gradient updates, and the weights are averaged, a row's by the number of updates that it had in each shard.

Tokens are known by 61 bits of a hash of all their bytes, worked out for many at once; two of a million distinct tokens are taken for one
with a chance of 1 to 4,000,000. Counts of all tokens are a written table. The most frequent ones, a bounded number, are sent to the tasks;
the rest are found by a join.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailpolicy.llm.common import kept, mapped, mixed

#: Classes of frequent words and words in each; classes of all others, a power of two.
CLASSES, CLASS_WORDS, TAIL_CLASSES = 16, 24, 8
OUTCOMES = CLASSES + TAIL_CLASSES
#: Tokens whose counts are sent to the tasks, at most.
HEAD = 1 << 18
#: Rows of each of the two tables of weights, as a power of two, and blocks of rows in which shards are put together.
ROWS, BLOCKS = 15, 32
#: Targets of one gradient update and of one batch of scores; length of a row's first step.
BATCH, RATE = 1 << 15, 0.4
#: Training tokens in a shard, and shards at most: beyond that shards are larger.
SHARD_TOKENS, SHARDS = 1 << 23, 4096
#: Bytes hashed at a time, and tokens counted or encoded at a time.
BUFFER, COUNTED, ENCODED = 1 << 17, 1 << 22, 1 << 20

#: Codes of tokens without a class of their own have this bit, bits of the hash, and the tail class in the lowest ones.
_TAIL = 1 << 31
_START = 0xFFFFFFFF
#: Odd multipliers of the hashes.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


# --- tokens

#: A byte that no text has stands for the end.
_END = b" \xff"
#: A-Z in lower case, white space as spaces.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))


def _powers(factor: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n - 1, factor, np.uint64)])


_UP, _DOWN = (_powers(f, BUFFER) for f in (int(_FACTORS[0]), pow(int(_FACTORS[0]), -1, 1 << 64)))


def hashes(data: bytes) -> np.ndarray:
    """A hash for every word of lower-cased bytes: a polynomial of its bytes, from sums up to its borders. The lowest bits are its tail class."""
    b = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(b != 32, prepend=False, append=False))
    start, end = edges[::2], edges[1::2]
    up, down = (_UP, _DOWN) if len(b) <= BUFFER else (_powers(f, len(b)) for f in (int(_FACTORS[0]), pow(int(_FACTORS[0]), -1, 1 << 64)))
    terms = _BYTES.take(b)
    terms *= up[: len(b)]
    sums = np.cumsum(terms)
    h = mixed((sums[end - 1] - sums[start] + terms[start]) * down[start])
    last = b[end - 1].astype(np.uint32) * 256 + b[np.maximum(end - 2, start)]
    return (h & ~np.uint64(TAIL_CLASSES - 1)) | ((last * np.uint32(2654435761) >> np.uint32(24)) % TAIL_CLASSES).astype(np.uint64)


END = int(hashes(_END)[0])


def _hashed(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """Hashes of all words of the texts in order, each text followed by ``END``; long texts are cut between words."""
    held, n = [], 0
    for text in texts:
        data = text.encode("utf-8", "surrogatepass").translate(_LOWER) if text else b""
        if n + len(data) + 4 > BUFFER:
            yield hashes(b" ".join(held))
            held, n = [], 0
        start = 0
        while len(data) - start > BUFFER - 4:
            cut = data.rfind(b" ", start + 1, start + BUFFER)
            cut = cut if cut > 0 else data.find(b" ", start + BUFFER)
            if cut < 0:
                break
            yield hashes(data[start:cut])
            start = cut
        held += [data[start:], _END]
        n += len(data) - start + 4
    yield hashes(b" ".join(held))


# --- counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, training and total: how often it occurs in texts to learn from and in all; a token may come several times."""
    held: dict[bool, list[np.ndarray]] = {False: [], True: []}
    size = 0

    def rows(rest: bool) -> pa.RecordBatch:
        token, n = np.unique(np.concatenate([np.empty(0, np.uint64), *held[rest]]), return_counts=True)
        held[rest].clear()
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n * (not rest)), pa.array(n)], names=["token", "training", "total"])

    for batch in batches:
        flags = batch.column(0).to_pylist()
        for rest in held:
            for found in _hashed(t.as_py() for t, r in zip(batch.column(1), flags) if r == rest):
                held[rest].append(found)
                size += len(found)
                if size > COUNTED:
                    yield from (rows(x) for x in held)
                    size = 0
    yield from (rows(x) for x in held)


def counted(docs: DataFrame) -> DataFrame:
    """Written table of token, training and total over all texts of ``docs`` (held, text)."""
    found = mapped(docs.select("held", "text"), _count, "token long, training long, total long")
    return kept(found.groupBy("token").agg(F.sum("training").alias("training"), F.sum("total").alias("total")), "counts")


@dataclass(frozen=True)
class Vocabulary:
    """What the tasks know of the counts, in bounded size."""

    tokens: np.ndarray  # the most frequent ones, ascending; the next three have one more for all others
    codes: np.ndarray  # frequent words: class times words in a class, plus place in the class; others have ``_TAIL``
    logs: np.ndarray  # log10 of the training counts plus one
    known: np.ndarray  # does it occur in the training texts?
    word_bias: np.ndarray  # classes x words: logarithms of shares; -inf where there is no word
    class_bias: np.ndarray  # logarithms of the shares of all classes
    spread: np.ndarray  # of tail classes: log10 of what their words' smoothed counts are divided by
    total: int  # training tokens
    distinct: int

    def places(self, h: np.ndarray) -> np.ndarray:
        """Where each token is in ``tokens``; behind them if it is not there."""
        first = self.__dict__.get("first")
        if first is None:
            first = np.searchsorted(self.tokens >> np.uint64(44), np.arange((1 << 20) + 1, dtype=np.uint64)).astype(np.int32)
            self.__dict__["first"] = first
        slot = (h >> np.uint64(44)).astype(np.int64)
        at, end = first[slot], first[slot + 1]
        out = np.full(len(h), len(self.tokens), np.int64)
        left = np.flatnonzero(at < end)
        while len(left):
            hit = self.tokens[at[left]] == h[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


def tail_codes(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(33)).astype(np.uint32) & np.uint32(_TAIL - TAIL_CLASSES) | (h % np.uint64(TAIL_CLASSES)).astype(np.uint32) | np.uint32(_TAIL)


def _log(counts: np.ndarray) -> np.ndarray:
    """Logarithms of shares; -inf for none."""
    out = np.full(counts.shape, -np.inf, np.float32)
    out[counts > 0] = np.log(counts[counts > 0])
    return out - np.log(np.maximum(counts.sum(axis=-1, keepdims=True), 1))


def vocabulary(counts: DataFrame, most: int = HEAD) -> Vocabulary:
    """Of a table of counts. The head is all tokens that come at least so often that no more than ``most`` do, in steps of an eighth of an octave."""
    step = F.floor(F.log2("total") * 8)
    steps = sorted(((r.step, r.n) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    within = [s for (s, _), n in zip(steps, np.cumsum([n for _, n in steps]).tolist()) if n <= most]
    head = counts.filter(step >= within[-1] if within else F.lit(False)).select("token", "training").toArrow()
    tokens, times = (np.asarray(c.to_numpy(), np.int64) for c in head.columns)
    order = np.argsort(tokens.view(np.uint64))
    tokens, times = tokens[order].view(np.uint64), times[order]
    listed = [i for i in np.lexsort((tokens, -times))[: CLASSES * CLASS_WORDS].tolist() if times[i]]

    n, v = np.zeros((2, TAIL_CLASSES), np.int64)
    for r in counts.filter("training > 0").groupBy(F.expr(f"token & {TAIL_CLASSES - 1}").alias("k")).agg(F.sum("training").alias("n"), F.count("*").alias("v")).collect():
        n[r.k], v[r.k] = r.n, r.v
    total, distinct = int(n.sum()), int(v.sum())
    k = (tokens[listed] % np.uint64(TAIL_CLASSES)).astype(np.int64)
    np.subtract.at(n, k, times[listed])
    np.subtract.at(v, k, 1)
    words = np.zeros(CLASSES * CLASS_WORDS, np.int64)
    words[: len(listed)] = times[listed]
    words = words.reshape(CLASSES, CLASS_WORDS)
    codes = tail_codes(tokens)
    codes[listed] = np.arange(len(listed))
    logs = np.log10(np.r_[times, 0] + 1.0)
    # Every tail class may bring a word never seen; a class of frequent words that has none is no outcome.
    return Vocabulary(tokens, np.r_[codes, np.uint32(_TAIL)], logs, logs > 0, _log(words), _log(np.r_[words.sum(axis=1), n + 1]), np.log10(n + v + 1.0), total, distinct)


# --- texts as codes

_ENCODED = "row long, doc_id long, held boolean, n_tokens long, head_known long, uncoded double, all_logs double, codes binary, tail array<long>"


def _parts(kind: pa.DataType, values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of ``values`` up to each of ``ends`` as one cell each, as bytes or as a list."""
    if kind == pa.binary():
        offsets = np.r_[0, ends] * values.itemsize
        return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(kind)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(values))


def _encode(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Of each text its codes, what the head's counts say, and its words outside the head."""
    v: Vocabulary = shared.value

    def rows(batch: pa.RecordBatch, done: int, h: np.ndarray) -> pa.RecordBatch:
        ends = np.flatnonzero(h == np.uint64(END)) + 1
        starts = np.r_[0, ends[:-1]]
        at = v.places(h)
        outside = at == len(v.tokens)
        codes, logs = v.codes[at], v.logs[at]
        codes[outside] = tail_codes(h[outside])
        sums = [np.add.reduceat(x, starts) for x in (v.known[at].astype(np.int64), np.where(codes < _TAIL, 0, logs), logs)]
        tail = _parts(pa.list_(pa.int64()), h[outside].view(np.int64), np.add.reduceat(outside, starts, dtype=np.int64).cumsum())
        given = batch.slice(done, len(ends)).columns[:3]
        return pa.RecordBatch.from_arrays([*given, pa.array(ends - starts), *map(pa.array, sums), _parts(pa.binary(), codes, ends), tail], names=[c.split()[0] for c in _ENCODED.split(", ")])

    for batch in batches:
        held, size, done = [], 0, 0
        for found in _hashed(t.as_py() for t in batch.column(3)):
            held.append(found)
            size += len(found)
            if size > ENCODED:
                whole = np.concatenate(held)
                last = np.flatnonzero(whole == np.uint64(END))
                if len(last):
                    yield rows(batch, done, whole[: last[-1] + 1])
                    done += len(last)
                    held, size = [whole[last[-1] + 1 :]], len(whole) - last[-1] - 1
        if done < batch.num_rows:
            yield rows(batch, done, np.concatenate(held))


def encoded(docs: DataFrame, shared) -> DataFrame:
    """Written table of all texts of ``docs`` (doc_id, held, text) as codes."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "held", "text")
    return kept(mapped(rows, lambda it: _encode(it, shared), _ENCODED), "encoded")


# --- the model


class Model:
    """Class and word softmax over tables of weights."""

    def __init__(self, v: Vocabulary, classes: np.ndarray | None = None, words: np.ndarray | None = None):
        self.class_bias, self.word_bias, self.spread = v.class_bias, v.word_bias, v.spread
        self.classes = np.zeros((1 << ROWS, OUTCOMES), np.float32) if classes is None else classes
        self.words = np.zeros((1 << ROWS, CLASS_WORDS), np.float32) if words is None else words

    def class_shares(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the features, and the probability of every class at each target."""
        rows = (features >> np.uint64(64 - ROWS)).astype(np.int64)
        return rows, _softmax(self.class_bias, self.classes, rows)

    def word_shares(self, features: np.ndarray, of_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the features joined with a class, and the probability of every word of the class."""
        joined = (features ^ ((of_class + 1).astype(np.uint64) * _FACTORS[3])) * _FACTORS[0]
        rows = (joined >> np.uint64(64 - ROWS)).astype(np.int64)
        return rows, _softmax(self.word_bias[of_class], self.words, rows)

    def logs(self, codes: np.ndarray, features: np.ndarray) -> np.ndarray:
        """log10 of each target's probability; of a target without a code less the log10 of its count plus one."""
        of_class = classes_of(codes)
        out = np.log10(self.class_shares(features)[1][np.arange(len(codes)), of_class]).astype(np.float64)
        coded = np.flatnonzero(codes < _TAIL)
        shares = self.word_shares(features[:, coded], of_class[coded])[1]
        out[coded] += np.log10(shares[np.arange(len(coded)), codes[coded] % CLASS_WORDS])
        tail = np.flatnonzero(codes >= _TAIL)
        out[tail] -= self.spread[of_class[tail] - CLASSES]
        return out


def _softmax(bias: np.ndarray, table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = table.take(rows[0], axis=0)
    for feature in rows[1:]:
        z += table.take(feature, axis=0)
    z += bias
    # Biases are logarithms of shares, so what is beyond these bounds is all or nothing; no outcome is impossible.
    np.clip(z, -80, 80, out=z)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def classes_of(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < _TAIL, codes // CLASS_WORDS, CLASSES + codes % TAIL_CLASSES).astype(np.int64)


def _targets(texts: Iterator[np.ndarray], size: int = BATCH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of targets: number of the text, code, hashes of the features (features x targets). A long text is cut, with its history."""
    held: list[tuple[int, np.ndarray]] = []
    n = 0

    def batch():
        line = np.concatenate([x for _, x in held])
        lengths = np.array([len(x) for _, x in held])
        begins = np.cumsum(lengths) - lengths
        target = np.ones(len(line), bool)
        target[(begins[:, None] + np.arange(3)).ravel()] = False
        at = np.flatnonzero(target)
        one, two, three = (line[at - i].astype(np.uint64) + np.uint64(i) for i in (1, 2, 3))
        features = np.stack([one * _FACTORS[0], (one * _FACTORS[1] + two) * _FACTORS[2], two * _FACTORS[2], three * _FACTORS[3]])
        features ^= features >> np.uint64(32)
        return np.repeat([i for i, _ in held], lengths - 3), line[at], features * _FACTORS[1]

    for number, codes in enumerate(texts):
        line = np.r_[np.full(3, _START, np.uint32), codes]
        for begin in range(0, len(codes), size):
            held.append((number, line[begin : begin + size + 3]))
            n += len(held[-1][1]) - 3
            if n >= size:
                yield batch()
                held, n = [], 0
    if held:
        yield batch()


def _codes(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for value in batch.column(column):
            yield np.frombuffer(value.as_buffer(), np.uint32)


# --- training


class Shard:
    """Weights of one shard, with the sums of squared gradients and the numbers of updates of their rows."""

    def __init__(self, v: Vocabulary):
        self.model = Model(v)
        self.squares = [np.zeros(len(t), np.float32) for t in (self.model.classes, self.model.words)]
        self.updates = [np.zeros(len(t), np.float32) for t in (self.model.classes, self.model.words)]

    def learn(self, codes: np.ndarray, features: np.ndarray) -> None:
        of_class = classes_of(codes)
        rows, shares = self.model.class_shares(features)
        self._update(0, self.model.classes, rows, shares, of_class)
        coded = np.flatnonzero(codes < _TAIL)
        rows, shares = self.model.word_shares(features[:, coded], of_class[coded])
        self._update(1, self.model.words, rows, shares, codes[coded] % CLASS_WORDS)

    def _update(self, which: int, table: np.ndarray, rows: np.ndarray, shares: np.ndarray, right: np.ndarray) -> None:
        """One step up the gradient of the targets' log probability, a row's step shorter the more it has moved before."""
        if not len(right):
            return
        gradient = np.negative(shares, out=shares)
        gradient[np.arange(len(right)), right] += 1
        at, n = rows.ravel(), len(rows)
        sums = np.stack([np.bincount(at, weights=np.tile(g, n), minlength=len(table)) for g in np.ascontiguousarray(gradient.T, np.float64)])
        self.squares[which] += np.einsum("ij,ij->j", sums, sums)
        self.updates[which] += np.bincount(at, minlength=len(table))
        sums *= RATE / np.sqrt(self.squares[which] + 1e-6)
        table += sums.T

    def blocks(self) -> Iterator[pa.RecordBatch]:
        """The tables, rows multiplied by their numbers of updates, block by block."""
        for block in range(BLOCKS):
            parts = []
            for table, updates in zip((self.model.classes, self.model.words), self.updates):
                mine = slice(block * len(table) // BLOCKS, (block + 1) * len(table) // BLOCKS)
                parts += [(table[mine] * updates[mine, None]).tobytes(), updates[mine].tobytes()]
            yield _block_batch(block, parts)


_BLOCK = "block int, classes binary, class_updates binary, words binary, word_updates binary"


def _block_batch(block: int, parts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([p], pa.binary()) for p in parts)], names=[c.split()[0] for c in _BLOCK.split(", ")])


def _train(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    shard, learned = Shard(shared.value), False
    for _, codes, features in _targets(_codes(batches, 0)):
        shard.learn(codes, features)
        learned = True
    if learned:
        yield from shard.blocks()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for i, block in enumerate(batch.column(0).to_pylist()):
            parts = [np.frombuffer(c[i].as_buffer(), np.float32).astype(np.float64) for c in batch.columns[1:]]
            sums[block] = [a + b for a, b in zip(sums[block], parts)] if block in sums else parts
    for block, parts in sums.items():
        yield _block_batch(block, [p.astype(np.float32).tobytes() for p in parts])


def trained(rows: DataFrame, v: Vocabulary, shared) -> Model:
    """The model from ``rows`` (codes): one pass, every training token in one update of its shard."""
    shards = min(SHARDS, max(1, -(-v.total // SHARD_TOKENS)))
    found = mapped(rows.select("codes").coalesce(shards), lambda it: _train(it, shared), _BLOCK)
    # Blocks of all shards meet by number: one row a block and shard, and the tables' size comes to the driver.
    merged = mapped(found.repartition(BLOCKS, "block"), _merge, _BLOCK).collect()
    model = Model(v)
    for r in merged:
        for table, sums, updates in ((model.classes, r.classes, r.class_updates), (model.words, r.words, r.word_updates)):
            mine = slice(r.block * len(table) // BLOCKS, (r.block + 1) * len(table) // BLOCKS)
            n = np.maximum(np.frombuffer(updates, np.float32), 1)
            table[mine] = np.frombuffer(sums, np.float32).reshape(len(n), -1) / n[:, None]
    return model


# --- scores


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    for batch in batches:
        out = np.zeros(batch.num_rows)
        for number, codes, features in _targets(_codes(iter([batch]), 0)):
            np.add.at(out, number, model.logs(codes, features))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out)], names=[*batch.schema.names[1:], "model"])


def scored(docs: DataFrame, held: Column, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text).

    Learned from are the rows for which ``held`` is not true. n_known counts tokens that the training texts have; base_score is the log10
    probability of the text under shares of single tokens smoothed by one, score that under the model; both cover every token and the
    end of the text. Null and empty texts are the end alone. Repeated rows are scored alike, and count as often as they occur in training;
    rows without doc_id are as others. With nothing to learn from every token has base probability 1 and the model's start shares; an
    empty table gives no rows. Other columns are not looked at.

    Two passes over the texts and two over their codes. What moves are counts of distinct tokens a task, words outside the head, and the
    tables of weights of each shard. Sums of weights differ in their last bits with the order of shards.
    """
    spark = docs.sparkSession
    given = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held"), "text")
    counts = counted(given)
    v = vocabulary(counts, head)
    shared = spark.sparkContext.broadcast(v)
    rows = encoded(given, shared)
    model = spark.sparkContext.broadcast(trained(rows.filter("NOT held"), v, shared))
    columns = ["codes", "row", "doc_id", "held", "n_tokens", "head_known", "uncoded", "all_logs"]
    schema = "row long, doc_id long, held boolean, n_tokens long, head_known long, uncoded double, all_logs double, model double"
    judged = mapped(rows.select(*columns), lambda it: _score(it, model), schema)
    # A token that comes often is in the head, of the training texts or not: no key of this join is hot.
    tail = rows.select("row", F.explode("tail").alias("token"))
    found = tail.join(counts.filter("training > 0").select("token", "training").hint("merge"), "token")
    of_row = found.groupBy("row").agg(F.count("*").alias("tail_known"), F.sum(F.log10(F.col("training") + 1)).alias("tail_logs"))
    both = judged.join(of_row.hint("merge"), "row", "left")
    rest = F.coalesce("tail_logs", F.lit(0.0))
    return both.select(
        "doc_id",
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("all_logs") + rest - F.col("n_tokens") * F.lit(log10(v.total + v.distinct + 1))).alias("base_score"),
        (F.col("model") + F.col("uncoded") + rest).alias("score"),
    )
