"""Quality by nearest neighbours among labelled documents in a latent-semantic space.

A text's terms are its byte trigrams, hashed into 2048 places, and a few terms of shape: words that repeat the one before, words seen before, capital letters,
digits, other signs, short lines, each by its share of the text. Counts are damped, weighted by how rare a term is in the labelled sample and
projected on the sample's leading singular vectors. The labelled vectors, a bounded number, are broadcast; each document's cosine with every
one of them is computed in blocks, and the labels of the nearest vote with a weight that grows with similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from mailpolicy.llm import labelled
from mailpolicy.llm.common import shipped

HASHED, SHAPES, SHAPE_WEIGHT = 2048, 6, 4.0
TERMS = HASHED + SHAPES
DIMENSIONS, NEIGHBOURS, SHARPNESS = 64, 15, 8
#: Bound of the fit: labelled documents of each class.
SAMPLE = 2500
BLOCK = 256
THRESHOLD = 0.3


#: Of a byte: 1 for capital letters, 2 for digits, 3 for other signs, 0 for the rest.
_KIND = np.array([1 if chr(b).isupper() and b < 128 else 2 if 48 <= b < 58 else 3 if 33 <= b < 127 and not chr(b).isalnum() else 0 for b in range(256)])


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of terms
    axes: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled documents x dimensions, of length 1
    votes: np.ndarray  # for each of them: its label, and what its vote counts
    base: float  # share of label 1


def terms(text: str | None) -> np.ndarray:
    """Damped counts of a whole text's hashed trigrams, and its terms of shape."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass") if text else b"", np.uint8)
    out = np.zeros(HASHED, np.int64)
    for at in range(0, max(1, len(b) - 2), 1 << 20):
        x = b[at : at + (1 << 20) + 2].astype(np.uint32)
        if len(x) >= 3:
            h = (x[:-2] * np.uint32(65536) + x[1:-1] * np.uint32(256) + x[2:]) * np.uint32(2654435761)
            out += np.bincount(h >> np.uint32(21), minlength=HASHED)
    return np.concatenate([np.log1p(out), _shape(text or "", b)]).astype(np.float32)


def _shape(text: str, b: np.ndarray) -> np.ndarray:
    """Shares of a text's words and bytes, damped."""
    w = text.split()
    kinds = np.bincount(_KIND[b], minlength=4)[1:] if len(b) else np.zeros(3)
    again = sum(map(eq, w, w[1:]))
    shares = [again / max(1, len(w)), (len(w) - len(set(w))) / max(1, len(w)), *(kinds / max(1, len(b))), text.count("\n") / max(1, len(w))]
    return SHAPE_WEIGHT * np.log1p(np.array(shares) * 20)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(counts: np.ndarray, labels: np.ndarray, class_counts: dict[int, int]) -> Model | None:
    """Model of a sample of terms and labels; None if it is empty. Votes are weighted so that classes count by their true shares."""
    if not len(labels):
        return None
    weights = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    x = _unit(counts * weights)
    k = min(DIMENSIONS, *x.shape)
    y = x @ np.random.default_rng(0).standard_normal((TERMS, min(k + 16, x.shape[0]))).astype(np.float32)
    for _ in range(3):
        y = x @ (x.T @ np.linalg.qr(y)[0])
    q = np.linalg.qr(y)[0]
    axes = np.linalg.svd(q.T @ x, full_matrices=False)[2][:k].T.astype(np.float32)
    share = {c: n / sum(class_counts.values()) for c, n in class_counts.items()}
    worth = np.array([share[int(c)] / np.mean(labels == c) for c in labels], np.float32)
    return Model(weights, np.ascontiguousarray(axes), _unit(x @ axes), np.stack([labels.astype(np.float32), worth], axis=1), share.get(1, 0.0))


def score(counts: np.ndarray, model: Model | None) -> np.ndarray:
    """Weighted share of label 1 among the nearest neighbours of each row of terms; 0.5 if there was nothing to learn from.

    Of neighbours equally near at the border those of smaller doc_id vote. Rows without any terms have no neighbours: their score is the
    share of label 1 among all labels.
    """
    if model is None:
        return np.full(len(counts), 0.5)
    cosines = _unit(counts * model.weights @ model.axes) @ model.vectors.T
    k = min(NEIGHBOURS, cosines.shape[1])
    border = np.partition(cosines, -k, axis=1)[:, -k, None]
    better, equal = cosines > border, cosines == border
    chosen = better | (equal & (np.cumsum(equal, axis=1) <= k - better.sum(axis=1, keepdims=True)))
    near = np.nonzero(chosen)[1].reshape(len(counts), k)
    w = np.maximum(np.take_along_axis(cosines, near, axis=1), 1e-3).astype(np.float64) ** SHARPNESS * model.votes[near, 1]
    return np.where(counts.any(axis=1), (w * model.votes[near, 0]).sum(axis=1) / w.sum(axis=1), model.base)


@F.pandas_udf(BinaryType())
def _terms(text: pd.Series) -> pd.Series:
    return text.map(lambda t: terms(t).tobytes())


def learned(docs: DataFrame, labels: DataFrame, allowed: Column, most: int = SAMPLE) -> Model | None:
    """The model, from at most ``most`` documents of each class; their terms come to the driver, 8 KB each."""
    shipped(docs.sparkSession)
    found, counts = labelled.sample(docs, labels, "quality", allowed, most)
    rows = sorted(found.select("doc_id", "label", _terms("text").alias("terms")).collect(), key=lambda r: (r.doc_id, bytes(r.terms)))
    if not rows:
        return None
    return fit(np.frombuffer(b"".join(r.terms for r in rows), np.float32).reshape(len(rows), TERMS), np.array([r.label for r in rows]), counts)


def scorer(docs: DataFrame, labels: DataFrame, allowed: Column, most: int = SAMPLE):
    """A column function: the score of a text column, by a model learned from ``docs`` and ``labels``."""
    model = docs.sparkSession.sparkContext.broadcast(learned(docs, labels, allowed, most))

    @F.pandas_udf("double")
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            parts = [score(np.stack([terms(x) for x in t.iloc[at : at + BLOCK]]), model.value) for at in range(0, len(t), BLOCK)]
            yield pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

    return scores


def scored(docs: DataFrame, labels: DataFrame, allowed: Column, most: int = SAMPLE) -> DataFrame:
    """doc_id and score, 0 to 1, of every row of ``docs``: the higher, the likelier good. Whole texts are read.

    Null and empty texts, and others without terms, get the share of label 1 among all labels; of equally near neighbours those of smaller
    doc_id vote. Without labelled documents all scores are 0.5. Repeated rows and null doc_ids are scored like others; an empty table gives no rows;
    other columns are not looked at. One pass, no shuffle, beside the fit.
    """
    return docs.select("doc_id", scorer(docs, labels, allowed, most)("text").alias("score"))
