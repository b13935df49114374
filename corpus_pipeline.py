"""A training corpus from documents, in five stages, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailpolicy.llm import decontamination, packing, quality, simhash, substring
from mailpolicy.llm.common import crc_remainder, kept, table, unused


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labels of documents at hand, does not reject."""
    scores = quality.scorer(docs, table(spark, sf_dir, "labels"), crc_remainder("doc_id", 5) != 0)
    return docs.filter(scores("text") >= quality.THRESHOLD)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group the row of the smallest doc_id, one without a doc_id only where no other is; of equal ones that of the smallest hash.

    Rows are told apart by doc_id and text, so several texts of one doc_id are judged each by its own group.
    """
    number, row, n = (unused(docs, c) for c in ("__number", "__row", "__n"))
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")
    found = kept(simhash.near_duplicates(docs.select(key.alias("doc_id"), "text"), shingle=3, radius=2), "found")
    groups = found.groupBy("doc_id", "component_id").agg(F.count("*").alias("n"))
    named = docs.select(key.alias("doc_id"), F.col("doc_id").alias("id")).distinct()
    # Merged at any size: whether the ids would fit into a broadcast depends on the corpus.
    rank = F.struct(F.col("id").isNull().alias("nameless"), "id", F.col("doc_id").alias("row"))
    least = groups.join(named.hint("merge"), "doc_id").groupBy("component_id").agg(F.min(F.struct(rank.alias("rank"), "n")).alias("least"))
    stay = kept(least.select(F.col("least.rank.row").alias(number), F.col("least.n").alias(n)), "stay")
    chosen = docs.withColumn(row, key).join(stay.hint("merge"), F.col(row) == F.col(number))
    single = chosen.filter(F.col(n) == 1).select(*docs.columns)
    if stay.filter(F.col(n) > 1).isEmpty():
        return single
    # Rows of one doc_id and text: the first of each task, then of all.
    first = chosen.filter(F.col(n) > 1).groupBy(row).agg(F.min_by(F.struct(*docs.columns), F.hash(*docs.columns)).alias("first"))
    return single.union(first.select("first.*"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that a document of smaller id has nearly alike."""
    return substring.without_repeats(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. A doc_id goes if any row of it does; rows without one go by their text."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.xxhash64("text").cast("string")))
    leaks = decontamination.decontaminate(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).filter("contaminated")
    name = unused(docs, "__key")
    leaks = kept(leaks.select(F.col("doc_id").alias(name)).distinct(), "leaks")
    return docs.join(leaks, key == F.col(name), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    placed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), "dropped", end_id=1, size=4096)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", good_documents),
    ("SimHash near-dedup", distinct_documents),
    ("substring dedup", without_repeats),
    ("benchmark decontamination", uncontaminated),
    ("best-fit packing", packed),
]

#: The classifier and the passages cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
