"""Curve queries over counts of the given tables."""

from pyspark.sql import functions as F

from mailpolicy.catalog.fixtures import include_lines, include_lines_repeated, table
from mailpolicy.modes import REFERENCE, STRICT
from mailpolicy.operators import curves
from mailpolicy.sources.counts import parse_include_counts

_OVER = 10


def _cdf(name, column, how):
    def build(spark, sf_dir):
        counts = table(spark, sf_dir, name).select(F.col(column).cast("bigint").alias("value"))
        return curves.cdf(counts, "value", how=how).withColumn("cdf", F.round("cdf", 6))

    return build


def _real_cdf(name, column, how, kind):
    """Over values that are no integers; cumulative sums of doubles to the cent, those of decimals exact."""
    def build(spark, sf_dir):
        values = table(spark, sf_dir, name).select(F.col(column).cast(kind).alias("value"))
        curve = curves.cdf(values, "value", how=how)
        kinds = {"value": "double"} | ({"cum": "double", "total": "double"} if how == "total" else {})
        return curve.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in curve.columns[:-1]]).select(
            "value", *[F.round(c, 2).alias(c) for c in ("cum", "total")], F.round(F.col("cum") / F.col("total"), 6).alias("cdf")
        )

    return build


def _concentration(over=None):
    def build(spark, sf_dir):
        counts = parse_include_counts(include_lines(spark, sf_dir, over)).withColumn("line_no", F.col("ind"))
        totals = curves.include_totals(counts, REFERENCE)
        return curves.concentration(totals, "n").withColumn("share", F.round("share", 6))

    return build


def _include_totals(mode):
    return lambda spark, sf_dir: curves.include_totals(
        parse_include_counts(include_lines_repeated(spark, sf_dir)), mode
    )


QUERIES = {
    "cdf_freq": _cdf("lineitem", "l_quantity", "freq"),
    "cdf_total": _cdf("lineitem", "l_quantity", "total"),
    "cdf_freq_long": _cdf("documents", "n_chars", "freq"),
    "cdf_total_long": _cdf("documents", "n_chars", "total"),
    "cdf_freq_prices": _real_cdf("lineitem", "l_extendedprice", "freq", "double"),
    "cdf_total_prices": _real_cdf("orders", "o_totalprice", "total", "decimal(18,2)"),
    "cdf_freq_balances": _real_cdf("customer", "c_acctbal", "freq", "float"),
    "concentration_curve": _concentration(),
    "concentration_curve_over_limit": _concentration(_OVER),
    "include_totals_last_line": _include_totals(REFERENCE),
    "include_totals_strict": _include_totals(STRICT),
}

# --- the same answers from the base columns


def _cdf_sql(name, column, how):
    measure = "n" if how == "freq" else "value * n"
    return f"""WITH h AS (SELECT CAST({column} AS BIGINT) AS value, COUNT(*) AS n FROM {name} GROUP BY 1),
      c AS (SELECT value, SUM({measure}) OVER (ORDER BY value) AS cum, SUM({measure}) OVER () AS total FROM h)
      SELECT value, CAST(cum AS BIGINT) AS cum, CAST(total AS BIGINT) AS total, ROUND(cum / total, 6) AS cdf FROM c"""


def _real_cdf_sql(name, column, how, kind):
    measure, result = ("n", "BIGINT") if how == "freq" else ("value * n", "DOUBLE")
    return f"""WITH h AS (SELECT CAST({column} AS {kind}) AS value, COUNT(*) AS n FROM {name} GROUP BY 1),
      c AS (SELECT CAST(value AS DOUBLE) AS value, SUM({measure}) OVER (ORDER BY value) AS cum, SUM({measure}) OVER () AS total FROM h)
      SELECT value, CAST(cum AS {result}) AS cum, CAST(total AS {result}) AS total, ROUND(CAST(cum AS DOUBLE) / CAST(total AS DOUBLE), 6) AS cdf FROM c"""


def _concentration_sql(over):
    return f"""WITH t AS (SELECT COUNT(*) AS value FROM orders GROUP BY o_custkey HAVING COUNT(*) > {over}),
      h AS (SELECT value, COUNT(*) AS n FROM t GROUP BY value),
      c AS (SELECT value, SUM(n) OVER (ORDER BY value DESC) - 1 AS idx, SUM(value * n) OVER (ORDER BY value DESC) AS cum,
                   SUM(value * n) OVER () AS total FROM h)
      SELECT CAST(idx AS BIGINT) AS idx, value, CAST(cum AS BIGINT) AS cum, CAST(total AS BIGINT) AS total,
             ROUND(cum / total, 6) AS share FROM c"""


SQL = {
    "cdf_freq": _cdf_sql("lineitem", "l_quantity", "freq"),
    "cdf_total": _cdf_sql("lineitem", "l_quantity", "total"),
    "cdf_freq_long": _cdf_sql("documents", "n_chars", "freq"),
    "cdf_total_long": _cdf_sql("documents", "n_chars", "total"),
    "cdf_freq_prices": _real_cdf_sql("lineitem", "l_extendedprice", "freq", "DOUBLE"),
    "cdf_total_prices": _real_cdf_sql("orders", "o_totalprice", "total", "DECIMAL(18,2)"),
    "cdf_freq_balances": _real_cdf_sql("customer", "c_acctbal", "freq", "REAL"),
    "concentration_curve": _concentration_sql(0),
    "concentration_curve_over_limit": _concentration_sql(_OVER),
    "include_totals_last_line": """WITH c AS (SELECT o_custkey, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY ALL)
      SELECT '_spf.p' || o_custkey || '.net' AS domain, arg_max(n, o_orderstatus) AS n FROM c GROUP BY o_custkey""",
    "include_totals_strict": """SELECT '_spf.p' || o_custkey || '.net' AS domain, COUNT(*) AS n
      FROM orders GROUP BY o_custkey""",
}
