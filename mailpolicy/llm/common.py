"""What several operators of this subpackage need: tables, shared scratch space, words and their hashes."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from math import floor
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and turns every other ASCII byte that is no digit or letter into a space.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; one of our own only where that is unset and all runs on this machine."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="scratch-")
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application: they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[2]
        sc.addPyFile(shutil.make_archive(str(Path(tempfile.mkdtemp()) / "mailpolicy"), "zip", root, "mailpolicy"))
        _shipped.add(sc.applicationId)


def mapped(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers, which give Arrow's memory back at a task's end."""
    shipped(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, and no later read works out its rows anew."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_remainder(column: str, divisor: int):
    """crc32 of an id written as text, modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def scaled_integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of a matrix of doubles: as 64-bit integers where all are small, as Python's beyond that."""
    scaled = np.floor(x * scale)
    if not scaled.size or np.abs(scaled).max() < 2**52:
        return scaled.astype(np.int64)
    # From 2^53 on a double is an integer, and its multiple might not fit a double.
    return np.array([[floor(v * scale) if abs(v) < 2**53 else int(v) * scale for v in row] for row in x.tolist()], object)


def words(text: str | None) -> list[bytes]:
    """Words of a text: runs of lower-cased ASCII letters and digits and of any non-ASCII characters. Null has none."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


class WordHashes(dict):
    """64-bit hash of a word, remembered; forgets all when it has grown to ``most`` words, so memory stays bounded."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, items: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, items), np.uint64, len(items))


def mixed(h: np.ndarray) -> np.ndarray:
    """Each 64-bit number with its bits mixed (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words; empty if there are fewer."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += word_hashes[j : j + n]
    return mixed(out)
