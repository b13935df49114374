"""Toxicity by compression distance: how much better a dictionary of toxic text compresses a window than one of ordinary text.

From a bounded sample of labelled documents two zstandard dictionaries are trained. The ordinary one comes from windows of ordinary
documents. The toxic one comes from the parts of toxic documents that are not ordinary (words that far fewer ordinary documents
have), placed before a copy of the ordinary content: both then shorten ordinary text alike, and a window gets shorter under
the toxic one only where it repeats toxic text. One half of the sample trains dictionaries, the other calibrates, by
logistic regression on the largest savings of a document's windows, at the classes' true shares.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from mailpolicy.llm import labelled
from mailpolicy.llm.common import WordHashes, gram_hashes, mixed, shipped, words

WINDOW, STRIDE = 48, 32
#: Bounds of the fit: documents of each class, and bytes of evenly spaced stretches taken of a document.
SAMPLE, STRETCHES, STRETCH = 3000, 16, 2048
ORDINARY_BYTES, TOXIC_BYTES = 4096, 2048
#: Windows of ordinary documents, in the sample's hashed order, that the ordinary dictionary is trained on.
DICTIONARY_WINDOWS = 100_000
#: A word is toxic text if toxic documents have it this many times as often, by a likelihood ratio that is no chance among many words,
#: and at least this share of them do.
CONTRAST, RATIO, LEAST_SHARE = 8.0, 20.0, 0.01
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def line(text: str | None) -> bytes:
    return b" " + b" ".join(words(text)) + b" "


def windows(b: bytes) -> list[bytes]:
    """Windows of 48 bytes every 32, so that 16 bytes in a row always lie in one; the last reaches the end."""
    return [b[i : i + WINDOW] for i in range(0, max(1, len(b) - (WINDOW - STRIDE)), STRIDE)]


@lru_cache(maxsize=4)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    p = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False, window_log=14, hash_log=13, chain_log=13, search_log=4, min_match=5, target_length=16, strategy=zstandard.STRATEGY_GREEDY
    )
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=p)


def savings(b: bytes, ordinary: bytes, toxic: bytes) -> np.ndarray:
    """Bytes that each window is shorter under the toxic dictionary, largest first."""
    of, tf = _compressor(ordinary).compress, _compressor(toxic).compress
    w = windows(b)
    return np.sort(np.fromiter((len(of(x)) - len(tf(x)) for x in w), np.int32, len(w)))[::-1]


def features(b: bytes, ordinary: bytes, toxic: bytes) -> np.ndarray:
    d = savings(b, ordinary, toxic)
    return np.array([1.0, d[0], d[:3].sum(), np.log1p((d >= 3).sum()), np.log1p((d >= 5).sum()), np.log(len(d))])


def _trained(size: int, samples: list[bytes], k: int, d: int) -> bytes:
    """Content of a trained dictionary; where the sample is too small to train on, its end."""
    try:
        data = zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
        return data[8:]
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[-size:]


def thinned(sample: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """The sample without near copies, whose words would pass for telling ones: a text that has a min-hash with an earlier one goes."""
    seen, out = set(), []
    for label, b in sample:
        grams = gram_hashes(WordHashes().of(b.split()), 3)
        least = {(salt, int(mixed(grams ^ np.uint64(salt)).min())) for salt in (1, 2, 3)} if len(grams) else {b}
        if not least & seen:
            out.append((label, b))
        seen |= least
    return out


def _ratio(n: int, other: int, rate: float) -> float:
    """Twice the log likelihood ratio of counts that should be as ``rate`` to 1."""
    total = n + other
    return 2 * (n * np.log(n * (1 + rate) / (total * rate)) + (other and other * np.log(other * (1 + rate) / total)))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(b)), x.T @ (w * (y - p)) - 1e-2 * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def _dictionaries(sample: list[tuple[int, bytes]]) -> tuple[bytes, bytes]:
    """Contents of the ordinary and the toxic dictionary."""
    docs = {c: [b for label, b in sample if label == c] for c in (0, 1)}
    has = {c: Counter(w for b in docs[c] for w in set(b.split())) for c in (0, 1)}
    rate = len(docs[1]) / len(docs[0])
    telling = {w for w, n in has[1].items() if n >= LEAST_SHARE * len(docs[1]) and n >= CONTRAST * rate * has[0][w] and _ratio(n, has[0][w], rate) >= RATIO}
    pieces = [b" " + b" ".join(w for w in b.split() if w in telling) + b" " for b in docs[1]]
    ordinary = _trained(ORDINARY_BYTES, [w for b in docs[0] for w in windows(b)][:DICTIONARY_WINDOWS], 32, 8)
    return ordinary, _trained(TOXIC_BYTES, [p for p in pieces if len(p) > 2], 16, 6) + ordinary


def fit(sample: list[tuple[int, bytes]], counts: dict[int, int]) -> Model | None:
    """``sample``: (label, line); of each class every other one trains, the rest calibrate. None: a class is missing."""
    sample = sorted(thinned(sample), key=lambda x: x[0])  # stable; neighbours of a class go to different halves
    train, rest = sample[0::2], sample[1::2]
    if {label for label, _ in train} != {0, 1} or {label for label, _ in rest} != {0, 1}:
        return None
    half = _dictionaries(train)
    x = np.array([features(b, *half) for _, b in rest])
    y = np.array([label for label, _ in rest], float)
    share = {c: counts[c] / sum(counts.values()) for c in (0, 1)}
    w = np.array([share[int(c)] / np.mean(y == c) for c in y])
    return Model(*half, tuple(_logistic(x, y, w)))


def score(text: str | None, model: Model | None) -> float:
    """How likely a text is toxic; 0 if there was nothing to learn from."""
    if model is None:
        return 0.0
    z = features(line(text), model.ordinary, model.toxic) @ np.array(model.weights)
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _stretches(text: str | None) -> bytes:
    """A text's line, or 16 evenly spaced stretches of a longer one."""
    b = line(text)
    if len(b) <= STRETCHES * STRETCH:
        return b
    return b"".join(b[at : at + STRETCH] for at in np.linspace(0, len(b) - STRETCH, STRETCHES).astype(int))


@F.pandas_udf(BinaryType())
def _sampled(text: pd.Series) -> pd.Series:
    return text.map(_stretches)


def learned(docs: DataFrame, labels: DataFrame, allowed: Column, most: int = SAMPLE) -> Model | None:
    """The model, from at most ``most`` documents of each class, 32 KB of each."""
    shipped(docs.sparkSession)
    found, counts = labelled.sample(docs, labels, "toxic", allowed, most)
    rows = found.select("doc_id", "label", _sampled("text").alias("line")).collect()
    rows.sort(key=lambda r: (zlib.crc32(f"{r.doc_id}#".encode()), bytes(r.line)))
    return fit([(r.label, bytes(r.line)) for r in rows], counts)


def scored(docs: DataFrame, labels: DataFrame, allowed: Column, most: int = SAMPLE) -> DataFrame:
    """doc_id and score, 0 to 1, of every row of ``docs``: the higher, the likelier toxic. Whole texts are read.

    Null and empty texts are one window without words and get the score of a document in which nothing was found. Without labelled
    documents of both classes all scores are 0. Repeated rows and null doc_ids are scored like others; an empty table gives
    no rows; other columns are not looked at. One pass, no shuffle, beside the fit.
    """
    model = docs.sparkSession.sparkContext.broadcast(learned(docs, labels, allowed, most))

    @F.pandas_udf("double")
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([score(x, model.value) for x in t], dtype="float64")

    return docs.select("doc_id", scores("text").alias("score"))
