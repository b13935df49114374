"""Queries of the training-data operators against their SQL, and the pipeline against its stages on small tables."""

import os
import shutil

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mailpolicy.llm import decontamination, queries, quality
from mailpolicy.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    con = oracle.connect(SF)
    mine, theirs = queries.QUERIES[name](spark, SF), con.sql(queries.SQL[name])
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {c: kinds[t] for c, t in mine.dtypes} == {c: str(t) for c, t in zip(theirs.columns, theirs.types)}
    a = oracle.rows_of(mine.columns, mine.collect())
    assert a and a == oracle.rows_of(theirs.columns, theirs.fetchall())


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    results = []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.kept(stage(spark, docs, SF))
        results.append(docs)
    good, distinct, cut, clean, packed = results
    given = table(spark, SF, "documents")
    assert all(r.columns == given.columns for r in results[:-1])
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in (given, good, distinct, cut, clean, packed)]
    assert ids[0] > ids[1] > ids[2] >= ids[3] > ids[4] == ids[5]
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    assert sum(labels.get(d) == 1 for d in ids[0] - ids[1]) <= 2
    assert sum(labels.get(d) == 0 for d in ids[1]) < 0.3 * sum(labels.get(d) == 0 for d in ids[0])
    assert not any(r.contaminated for r in decontamination.decontaminate(clean, table(spark, SF, "benchmark")).collect())
    first, second = ({r.doc_id: r.text for r in x.collect()} for x in (distinct, cut))
    assert any(first[d] != t for d, t in second.items()) and all(len(t) <= len(first[d]) for d, t in second.items())
    rerun = corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect()
    assert sorted(rerun) == sorted(packed.select("doc_id", "piece", "ids_crc32").collect())


def test_pipeline_of_hostile_and_empty_tables(spark, tmp_path):
    for name in ("labels", "benchmark"):
        shutil.copy(os.path.join(SF, f"{name}.parquet"), tmp_path)
    rows = [(1, None), (2, ""), (3, "same text of a few words"), (3, "same text of a few words"), (4, "same text of a few words"), (None, "no id"), (None, None), (5, "word " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.lit(None).cast("long")).withColumn("score", F.lit(1))
    for given in (docs, docs.limit(0)):
        now = given
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = corpus_pipeline.kept(stage(spark, now, str(tmp_path)))
            assert now.columns == docs.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
        assert packed.count() >= now.count() if now.count() else packed.count() == 0
    kept = [corpus_pipeline.distinct_documents(spark, docs, str(tmp_path)).filter(F.col("doc_id") == 3).count(), corpus_pipeline.distinct_documents(spark, docs, str(tmp_path)).filter("doc_id in (2, 4)").count()]
    assert kept == [1, 0]


def test_pipeline_on_extra_columns_and_odd_ids(spark, tmp_path):
    """Columns of any names stay; a group's row is chosen by row, whatever else the table holds."""
    for name in ("labels", "benchmark"):
        shutil.copy(os.path.join(SF, f"{name}.parquet"), tmp_path)
    x, y = (" ".join(f"{p}{i}" for i in range(70)) for p in "xy")
    rows = [(5, x), (5, y), (3, y), (None, x + " more"), (None, y), (None, "alone here"), (9, None), (7, x), (8, x), (8, x)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("n", "__id", "__n", "__row", "__number", "__key", "__of", "__spans", "number", "component_id", "fp", "id", "row", "N_"):
        docs = docs.withColumn(c, F.lit("kept"))
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.kept(stage(spark, now, str(tmp_path)))
        assert now.columns == docs.columns and now.filter("n <> 'kept' or __id <> 'kept'").count() == 0
    stays = lambda given: sorted(((r.doc_id, r.text) for r in corpus_pipeline.distinct_documents(spark, given, str(tmp_path)).collect()), key=repr)
    expected = sorted([(5, x), (3, y), (None, x + " more"), (None, "alone here"), (9, None)], key=repr)
    assert stays(docs) == expected
    # rows of another group change nothing
    more = docs.union(docs.filter("doc_id = 9")).union(docs.filter("doc_id = 9").withColumn("doc_id", F.lit(4)))
    assert stays(more) == sorted([*[e for e in expected if e[0] != 9], (4, None)], key=repr)


def test_quality_of_texts_without_terms_and_of_ties():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abcdef ")) for _ in range(60)) for _ in range(40)]
    labels = np.array([1] * 30 + [0] * 10)
    model = quality.fit(np.stack([quality.terms(t) for t in texts]), labels, {1: 300, 0: 100})
    empty = quality.score(np.stack([quality.terms(t) for t in (None, "", "  ", "a")]), model)
    assert empty.tolist() == [0.75] * 4
    # twenty equal neighbours: the first fifteen vote
    counts = np.stack([quality.terms(texts[0])] * 20 + [quality.terms(t) for t in texts])
    votes = np.array([1] * 15 + [0] * 5 + [0] * 40)
    assert quality.score(counts[:1], quality.fit(counts, votes, {1: 15, 0: 45}))[0] > 0.999


def test_threshold_of_the_stage_is_that_of_the_query():
    assert quality.THRESHOLD == 0.3
