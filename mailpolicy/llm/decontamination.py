"""Benchmark decontamination by winnowing.

Every k-gram of words is hashed; of each w neighbouring grams the one of least hash is kept, the last of equal ones. Two texts that
share ``k + w - 1`` words keep a common gram at the same place in them, so no shared span of that length is missed. Kept grams of
documents and benchmark are joined on their hash, and each hit is extended word by word to both sides. With k = 5 and w = 6 spans of ten
words are sure. An item of fewer words is one window: for its length n, every n-gram is kept (k = n, w = 1).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailpolicy.llm.common import WordHashes, gram_hashes, kept, mapped, mixed, words

SPAN, GRAM = 10, 5
#: Up to so many benchmark fingerprints (8 bytes each) go to the executors to drop grams that match none before the join.
PREFILTER = 2_000_000
_HIT = "struct<h:bigint,at:int,before:array<string>,gram:string,after:array<string>>"


def winnowed(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the grams that are the least of some ``window`` neighbours, the last of equal ones; of fewer grams, the least."""
    n = len(grams)
    if window == 1 or not n:
        return np.arange(n)
    w = min(window, n)
    least, at = grams[: n - w + 1].copy(), np.arange(n - w + 1)
    for j in range(1, w):
        other = grams[j : n - w + 1 + j]
        better = other <= least
        least = np.where(better, other, least)
        at[better] = np.flatnonzero(better) + j
    return at[np.r_[True, at[1:] != at[:-1]]]


def _schemes(short: list[int], span: int, gram: int) -> list[tuple[int, int, int]]:
    """(k, w, words of context): the ordinary scheme, and one for each length of items of under ``span`` words."""
    return [(gram, span - gram + 1, span - gram), *((n, 1, 0) for n in short)]


def _prints(w: list[bytes], hashes: WordHashes, schemes, only: np.ndarray | None) -> Iterator[dict]:
    h = hashes.of(w)
    for k, window, context in schemes:
        grams = gram_hashes(h, k) ^ mixed(np.array([k * 1000 + window], np.uint64))  # schemes do not meet
        at = winnowed(grams, window)
        if only is not None and len(at):
            found = grams[at]
            at = at[only[np.minimum(np.searchsorted(only, found), len(only) - 1)] == found] if len(only) else at[:0]
        for p in at.tolist():
            text = [x.decode("utf-8", "surrogatepass") for x in w[max(0, p - context) : p + k + context]]
            b = p - max(0, p - context)
            yield {"h": int(grams[p].view(np.int64)), "at": p, "before": text[:b][::-1], "gram": " ".join(text[b : b + k]), "after": text[b + k :]}


_HIT_TYPE = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32()), ("before", pa.list_(pa.string())), ("gram", pa.string()), ("after", pa.list_(pa.string()))]))


def _scan(batches: Iterator[pa.RecordBatch], schemes, only=None) -> Iterator[pa.RecordBatch]:
    """The last column is the text; those before it are passed on."""
    hashes, grams = WordHashes(), only.value if only is not None else None
    for whole in batches:
        for start in range(0, whole.num_rows, 500):
            b = whole.slice(start, 500)
            counts, hits = [], []
            for t in b.columns[-1]:
                w = words(t.as_py())
                counts.append(len(w))
                hits.append(list(_prints(w, hashes, schemes, grams)) if w else [])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(counts, pa.int64()), pa.array(hits, _HIT_TYPE)], names=[*b.schema.names[:-1], "n_words", "hits"])


def _matching(mine: str, theirs: str, most: int):
    """How many of the first words of two context arrays are equal, one after the other."""
    a, b = F.col(mine), F.col(theirs)
    run = [(F.size(a) >= j) & (F.size(b) >= j) & (F.slice(a, 1, j) == F.slice(b, 1, j)) for j in range(1, most + 1)]
    return sum((r.cast("int") for r in run), F.lit(0))


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs``: row (a number of its own), doc_id, n_words, n_hit, item_ids (sorted texts), contaminated.

    A window is ``span`` consecutive words of an item, or all its words if it has fewer; a document word inside an occurrence of a
    window is hit. item_ids are the items with occurring windows. Null and empty texts have no words, no windows and no hits;
    an item without words occurs nowhere. Items of a null item_id hit words, but are not named. Repeated rows are answered
    each. Empty tables: no rows, or no hits. Other columns are not looked at.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    counted = kept(mapped(items.select("*", F.col("text").alias("t")), lambda it: _scan(it, []), f"item_id string, text string, n_words long, hits array<{_HIT}>").select("item_id", "text", "n_words"), "items")
    short = sorted(r.n_words for r in counted.filter((F.col("n_words") > 0) & (F.col("n_words") < span)).select("n_words").distinct().collect())  # under `span` rows
    schemes = _schemes(short, span, gram)
    rows = None
    for scheme in schemes:
        whole = scheme[1] == 1
        mine = counted.filter(F.col("n_words") == scheme[0] if whole else F.col("n_words") >= span).select("item_id", "text")
        mine = mapped(mine, lambda it, scheme=scheme: _scan(it, [scheme]), f"item_id string, n_words long, hits array<{_HIT}>").withColumn("whole", F.lit(whole))
        rows = mine if rows is None else rows.union(mine)
    of_items = rows.select("item_id", "whole", F.explode("hits").alias("x")).select("item_id", "whole", "x.h", F.col("x.before").alias("i_before"), F.col("x.gram").alias("i_gram"), F.col("x.after").alias("i_after"))
    # One row for each distinct surrounding of a gram; who has it is looked up only for real hits.
    of_items = of_items.withColumn("place", F.sha2(F.concat_ws("|", F.col("whole").cast("string"), F.concat_ws(" ", "i_before"), "i_gram", F.concat_ws(" ", "i_after")), 256))
    of_items = kept(of_items, "item-prints")
    places = of_items.drop("item_id").dropDuplicates(["place"])
    owners = of_items.select("place", "item_id").distinct()

    only = None
    prints = of_items.select("h").distinct()
    if prints.count() <= PREFILTER:
        only = spark.sparkContext.broadcast(np.sort(np.array([r.h for r in prints.collect()], np.int64).view(np.uint64)))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    base = kept(mapped(texts, lambda it: _scan(it, schemes, only), f"row long, doc_id {id_type}, n_words long, hits array<{_HIT}>"), "document-prints")

    hits = base.select("row", F.explode("hits").alias("x")).select("row", "x.*")
    met = hits.join(places, "h").filter(F.col("gram") == F.col("i_gram"))
    left, right = _matching("before", "i_before", span - gram), _matching("after", "i_after", span - gram)
    k = F.size(F.split("gram", " "))
    met = met.select("row", "place", "whole", (F.col("at") - left).alias("first"), (F.col("at") + k + right).alias("end"))
    met = kept(met.filter(F.col("whole") | (F.col("end") - F.col("first") >= span)), "hits")
    spans = met.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("first", "end"))).alias("spans"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda s, x: F.struct((s.n + F.greatest(F.lit(0), x.end - F.greatest(x.first, s.to))).alias("n"), F.greatest(s.to, x.end).alias("to")))
    named = met.select("row", "place").distinct().join(owners, "place").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    n_hit = spans.select("row", covered.n.cast("long").alias("n_hit"))
    out = base.select("row", "doc_id", "n_words").join(n_hit.join(named, "row", "left"), "row", "left")
    none = F.array().cast("array<string>")
    return out.select("row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"), F.col("n_hit").isNotNull().alias("contaminated"))
