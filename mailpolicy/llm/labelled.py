"""Bounded samples of labelled documents, for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, most: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, label and text of at most ``most`` documents of each class, and how many labelled rows of each class there are.

    ``allowed`` says which label rows may be learned from. Chosen are the least hashes of doc_id, so the sample is the same in
    every run. Of several labels of one document the least counts; labels that are not 0 or 1 are no labels.
    """
    usable = labels.filter(allowed & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("label"))
    counts = {r.label: r.n for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for value in (0, 1):
        part = usable.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    # At most 2 * most rows of two numbers.
    ids = F.broadcast(chosen.select(F.col("doc_id").alias("chosen_id"), F.col("label").cast("int")))
    found = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("chosen_id")).select("doc_id", "label", "text")
    return found, counts
