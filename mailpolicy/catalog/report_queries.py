"""Evaluation queries over the report fixtures."""

from pyspark.sql import functions as F

from mailpolicy.catalog.fixtures import name_lines, report_lines
from mailpolicy.modes import REFERENCE, STRICT
from mailpolicy.operators import curves, reports
from mailpolicy.sources.reports import parse_names, parse_reports


def _kept(spark, sf_dir, mode):
    parsed = parse_reports(report_lines(spark, sf_dir))
    return reports.restrict(reports.facts(parsed, mode), parse_names(name_lines(spark, sf_dir), mode), mode)


def _over(count, mode):
    return lambda spark, sf_dir: count(_kept(spark, sf_dir, mode))


def _labels(count, mode):
    return lambda spark, sf_dir: count(_kept(spark, sf_dir, mode), mode)


def _distinct_filtered(kept):
    return kept.groupBy("query").agg(F.count("*").alias("lines"), F.sum("copies").alias("copies"))


def _cdf(kept):
    curve = curves.cdf(reports.lookup_histogram(kept), "lookups", by=["series"], weight="n")
    return curve.withColumn("cdf", F.round("cdf", 6))


def _message_rows(kind):
    def build(spark, sf_dir):
        found = reports.messages(parse_reports(report_lines(spark, sf_dir)), kind)
        kept = reports.restrict(found, parse_names(name_lines(spark, sf_dir)))
        return reports.message_rows(kept)

    return build


QUERIES = {
    "report_distinct_filtered": _over(_distinct_filtered, REFERENCE),
    "report_distinct_filtered_strict": _over(_distinct_filtered, STRICT),
    "report_outcomes": _over(reports.outcomes, REFERENCE),
    "report_outcomes_strict": _over(reports.outcomes, STRICT),
    "lookup_histogram": _over(reports.lookup_histogram, REFERENCE),
    "lookup_histogram_strict": _over(reports.lookup_histogram, STRICT),
    "lookup_cdf": _over(_cdf, REFERENCE),
    "error_classes": _over(reports.error_classes, REFERENCE),
    "error_classes_strict": _over(reports.error_classes, STRICT),
    "error_labels": _labels(reports.error_labels, REFERENCE),
    "error_labels_strict": _labels(reports.error_labels, STRICT),
    "warning_classes": _over(reports.warning_classes, REFERENCE),
    "warning_classes_strict": _over(reports.warning_classes, STRICT),
    "warning_labels": _labels(reports.warning_labels, REFERENCE),
    "warning_labels_strict": _labels(reports.warning_labels, STRICT),
    "missing_address_records": _over(reports.missing_address, REFERENCE),
    "missing_address_records_strict": _over(reports.missing_address, STRICT),
    "evaluation_tally": _over(reports.tally, REFERENCE),
    "evaluation_tally_strict": _over(reports.tally, STRICT),
    "error_message_rows": _message_rows("errors"),
    "warning_message_rows": _message_rows("warnings"),
}

# --- the same answers from the base columns


def _base(mode):
    """One row per listed order with the number of times it counts."""
    if mode == REFERENCE:
        listed = "o_orderpriority <> '5-LOW'"
        w = "CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END"
    else:
        listed, w = "TRUE", "1"
    return f"""WITH r AS (
      SELECT o_orderkey AS o, o_orderkey % 8 >= 5 AS ev, o_orderkey % 15 AS lookups, {w} AS w
      FROM orders WHERE o_orderstatus <> 'P' AND {listed})"""


_N = "CAST(SUM(w) AS BIGINT) AS n"


def _sum_if(condition):
    return f"CAST(COALESCE(SUM(w) FILTER (WHERE {condition}), 0) AS BIGINT)"


_OUTCOMES = {
    "not_deployed": "o % 8 < 2",
    "nonexistent_name": "o % 8 = 2",
    "name_server_failure": "o % 8 = 3",
    "multiple_policies": "o % 8 = 4",
    "over_lookup_limit": "ev AND lookups > 10",
}


def _outcomes_sql(mode):
    return _base(mode) + " UNION ALL ".join(
        f" SELECT '{c}' AS counter, {_sum_if(cond)} AS n FROM r" for c, cond in _OUTCOMES.items()
    )


def _series_rows(mode):
    absent = "'include_absent'" if mode == STRICT else "NULL"
    return f"""SELECT 'all' AS series, lookups, w FROM r WHERE ev
        UNION ALL SELECT s, lookups, w FROM (SELECT CASE WHEN o % 23 = 0 THEN {absent}
          WHEN o % 3 = 0 THEN 'include_present' ELSE 'include_absent' END AS s, lookups, w FROM r WHERE ev)
        WHERE s IS NOT NULL"""


def _histogram_sql(mode):
    return f"{_base(mode)} SELECT series, lookups, {_N} FROM ({_series_rows(mode)}) GROUP BY series, lookups"


def _cdf_sql(mode):
    return f"""{_base(mode)}, h AS (SELECT series, lookups AS value, {_N} FROM ({_series_rows(mode)}) GROUP BY ALL),
      c AS (SELECT series, value, SUM(n) OVER (PARTITION BY series ORDER BY value) AS cum,
                   SUM(n) OVER (PARTITION BY series) AS total FROM h)
      SELECT series, value, CAST(cum AS BIGINT) AS cum, CAST(total AS BIGINT) AS total, ROUND(cum / total, 6) AS cdf FROM c"""


def _error_rows(mode):
    """``class, w``: what the messages of each order come to; records with an entry without errors have none."""
    # the quoted a is taken out of the whole message
    plain_a = "Invlid directive '''' found" if mode == REFERENCE else "Invalid directive"
    rules = {
        "o % 7 = 0": "Invalid directive",
        "o % 7 = 1": plain_a,
        "o % 7 = 2": "Unknown directive",
        "o % 7 = 3 OR (o % 7 = 6 AND o % 2 = 0)": "Recursive inclusion of ''''.",
        "o % 7 = 5 AND o % 2 = 0": "Invalid definition '''' for domain ''''.",
        "o % 7 = 6 AND o % 2 = 0": "Invalid IP",
    }
    return " UNION ALL ".join(
        f"SELECT '{c}' AS class, w FROM r WHERE ev AND o % 5 <> 1 AND ({cond})" for cond, c in rules.items()
    )


def _warning_rows(mode):
    not_last = (
        "The '''' directive is not last in '''' policy - ignoring subsequent directives."
        if mode == REFERENCE
        else "all directive is not last in <h> policy - ignoring  subsequent directives."
    )
    rules = {
        "o % 6 = 0": "No MX record for domain ''''",
        "o % 6 = 1": "Unable to look up TXT record",
        "o % 6 = 2": not_last,
    }
    return " UNION ALL ".join(
        f"SELECT '{c}' AS class, w FROM r WHERE ev AND o % 5 <> 2 AND ({cond})" for cond, c in rules.items()
    )


def _classes_sql(rows, mode):
    return f"{_base(mode)} SELECT class, {_N} FROM ({rows(mode)}) GROUP BY class"


_ERROR_LABEL = """CASE class WHEN 'Invalid IP' THEN 'Invalid value' WHEN 'Unknown directive' THEN 'Unknown mechanism'
    WHEN 'Recursive inclusion of ''''.' THEN 'Recursive value' WHEN 'Invalid directive' THEN 'Missing values for a and mx'
    WHEN 'Invalid definition '''' for domain ''''.' THEN 'Missing values for ip4 and ip6' END"""
_WARNING_LABEL = """CASE class WHEN 'No MX record for domain ''''' THEN 'Missing MX'
    WHEN 'Unable to look up TXT record' THEN 'Missing TXT' END"""


def _labels_sql(rows, label, mode):
    keep = "label, class" if mode == REFERENCE else "label"
    return f"""{_base(mode)} SELECT {keep}, {_N} FROM (SELECT {label} AS label, class, w FROM ({rows(mode)}))
        WHERE label IS NOT NULL GROUP BY {keep}"""


def _missing(mode):
    return "ev AND o % 9 = 0" if mode == REFERENCE else "ev AND (o % 9 = 0 OR o % 5 = 3)"


def _tally_sql(mode):
    outcomes = " UNION ALL ".join(
        f"SELECT 'outcome' AS section, '{c}' AS item, w FROM r WHERE {cond}" for c, cond in _OUTCOMES.items()
    )
    return f"""{_base(mode)} SELECT section, item, {_N} FROM (
      {outcomes}
      UNION ALL SELECT 'lookups_' || series, CAST(lookups AS VARCHAR), w FROM ({_series_rows(mode)})
      UNION ALL SELECT 'missing_address', 'records', w FROM r WHERE {_missing(mode)}
      UNION ALL SELECT 'error_class', class, w FROM ({_error_rows(mode)})
      UNION ALL SELECT 'warning_class', class, w FROM ({_warning_rows(mode)})) GROUP BY section, item"""


def _message_sql(rules, gap):
    rows = " UNION ALL ".join(f"SELECT o, '{m}' AS message FROM r WHERE ev AND ({c})" for c, m in rules)
    return f"""{_base(STRICT)} SELECT 'q' || o || '.com' AS query, 'q' || o || '.com' AS domain, message
        FROM ({rows}) WHERE o % 5 <> {gap}"""


_ERROR_MESSAGES = [
    ("o % 7 = 0", "Invalid directive ''a:'' found"),
    ("o % 7 = 1", "Invalid directive ''a'' found"),
    ("o % 7 = 2", "Unknown directive ''foo''"),
    ("o % 7 = 2", "Unknown directive ''bar''"),
    ("o % 7 = 3", "Recursive inclusion of ''x.com''."),
    ("o % 7 = 4", "Too many DNS lookups (12/10)"),
    ("o % 7 = 5 AND o % 2 = 0", "Invalid definition ''ip4'' for domain ''q.com''."),
    ("o % 7 = 6 AND o % 2 = 0", "Invalid IP ''300.1.1.1'' in ''ip4''"),
    ("o % 7 = 6 AND o % 2 = 0", "Recursive inclusion of ''y.com''."),
]
_WARNING_MESSAGES = [
    ("o % 6 = 0", "No MX record for domain ''m.com''"),
    ("o % 6 = 1", "Unable to look up TXT record for ''t.com''"),
    ("o % 6 = 2", "The ''all'' directive is not last in ''x.com'' policy - ignoring  subsequent directives."),
]


def _distinct_sql(mode):
    return f"""{_base(mode)} SELECT 'q' || o || '.com' AS query, CAST(1 AS BIGINT) AS lines, CAST(w AS BIGINT) AS copies
        FROM r"""


SQL = {
    "report_distinct_filtered": _distinct_sql(REFERENCE),
    "report_distinct_filtered_strict": _distinct_sql(STRICT),
    "report_outcomes": _outcomes_sql(REFERENCE),
    "report_outcomes_strict": _outcomes_sql(STRICT),
    "lookup_histogram": _histogram_sql(REFERENCE),
    "lookup_histogram_strict": _histogram_sql(STRICT),
    "lookup_cdf": _cdf_sql(REFERENCE),
    "error_classes": _classes_sql(_error_rows, REFERENCE),
    "error_classes_strict": _classes_sql(_error_rows, STRICT),
    "error_labels": _labels_sql(_error_rows, _ERROR_LABEL, REFERENCE),
    "error_labels_strict": _labels_sql(_error_rows, _ERROR_LABEL, STRICT),
    "warning_classes": _classes_sql(_warning_rows, REFERENCE),
    "warning_classes_strict": _classes_sql(_warning_rows, STRICT),
    "warning_labels": _labels_sql(_warning_rows, _WARNING_LABEL, REFERENCE),
    "warning_labels_strict": _labels_sql(_warning_rows, _WARNING_LABEL, STRICT),
    "missing_address_records": f"{_base(REFERENCE)} SELECT {_sum_if(_missing(REFERENCE))} AS n FROM r",
    "missing_address_records_strict": f"{_base(STRICT)} SELECT {_sum_if(_missing(STRICT))} AS n FROM r",
    "evaluation_tally": _tally_sql(REFERENCE),
    "evaluation_tally_strict": _tally_sql(STRICT),
    "error_message_rows": _message_sql(_ERROR_MESSAGES, 1),
    "warning_message_rows": _message_sql(_WARNING_MESSAGES, 2),
}
