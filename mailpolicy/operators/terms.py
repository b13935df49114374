"""Policies and their terms as rows (TRM1-7, FLT1)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailpolicy.functions.names import tld
from mailpolicy.functions.policy import MECHANISMS, is_external, is_policy, name_terms, parse_terms, value
from mailpolicy.functions.text import select_once
from mailpolicy.modes import STRICT


def _policies(answers, mode: str):
    return F.transform(
        F.filter(answers, lambda a: is_policy(a["type"], a["answer"], mode)), lambda a: a["answer"]
    )


def explode_terms(spf: DataFrame, mode: str = STRICT) -> DataFrame:
    """One row per policy term: ``name, tld, answer_no, term_no, qualifier, mechanism, value``.

    ``answer_no`` counts the policies of a record and ``term_no`` the terms of a policy, version left out, both from 0.
    ``mechanism`` and ``value`` are null for a term that names none.
    """
    carried = [c for c in spf.columns if c != "answers"]
    answers = spf.select(*carried, F.posexplode(_policies(F.col("answers"), mode)).alias("answer_no", "policy"))
    terms = answers.select(
        *carried, "answer_no", F.posexplode(parse_terms(F.col("policy"), F.col("name"), mode)).alias("term_no", "term")
    )
    return terms.select(
        *carried,
        tld(F.col("name")).alias("tld"),
        "answer_no",
        "term_no",
        "term.qualifier",
        F.nullif("term.mechanism", F.lit("")).alias("mechanism"),
        "term.value",
    )


def multiple_policies(spf: DataFrame, mode: str = STRICT) -> DataFrame:
    """Names with a record that holds several policies, which no receiver may use (Q5): the record's columns, ``n_policies``."""
    carried = [c for c in spf.columns if c != "answers"]
    counted = select_once(spf.select(*carried, "answers"), n_policies=F.size(_policies(F.col("answers"), mode)))
    return counted.where(F.col("n_policies") > 1).select(*carried, "n_policies")


def flags(spf: DataFrame, mode: str = STRICT) -> DataFrame:
    """One row per policy, and one for a record without any.

    Columns: those of the record, ``n_policies``, ``first`` (true on one row of each record), ``deployed``, one boolean
    per mechanism, ``external_include`` (TRM6-7).
    """
    carried = [c for c in spf.columns if c != "answers"]
    records = select_once(spf.select(*carried, "answers"), _policies=_policies(F.col("answers"), mode))
    policies = records.select(
        *carried,
        F.greatest(F.size("_policies"), F.lit(0)).alias("n_policies"),
        F.posexplode_outer("_policies").alias("_no", "_policy"),
    )
    parsed = select_once(policies, _terms=name_terms(F.col("_policy"), mode))
    name = F.col("name")
    external = F.exists(
        "_terms",
        lambda t: (t["mechanism"] == "include")
        & is_external(value(t["term"], t["mechanism"], name, mode), name, mode),
    )
    return parsed.select(
        *carried,
        "n_policies",
        (F.coalesce("_no", F.lit(0)) == 0).alias("first"),
        F.col("_policy").isNotNull().alias("deployed"),
        *[F.expr(f"coalesce(array_contains(_terms.mechanism, '{m}'), false)").alias(m) for m in MECHANISMS],
        F.coalesce(external, F.lit(False)).alias("external_include"),
    )
