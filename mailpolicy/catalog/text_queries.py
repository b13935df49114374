"""Odd and broken input, and results as the lines the writers store."""

from pyspark.sql import functions as F

from mailpolicy import sinks
from mailpolicy.catalog import fixtures, log_queries, report_queries, scan_queries
from mailpolicy.catalog.fixtures import DOMAIN
from mailpolicy.functions.names import second_level, tld
from mailpolicy.modes import REFERENCE, STRICT
from mailpolicy.operators import curves, deployment, probes, reports, terms
from mailpolicy.sources import counts, querylog, scans
from mailpolicy.sources.reports import parse_names, parse_reports, report_rejects

_UNTIL = "2024-01-16"
_SHORT = 3
# the first label map ends among the fixture's ids
_BORDER = probes.FIRST_MAP_IDS - 6


def _odd_spf(spark, sf_dir, mode=STRICT):
    return scans.parse_spf(fixtures.odd_spf_lines(spark, sf_dir), mode)


def _odd_terms(mode):
    def build(spark, sf_dir):
        rows = terms.explode_terms(_odd_spf(spark, sf_dir, mode), mode).where(F.col("mechanism").isNotNull())
        return rows.select("name", "tld", "answer_no", "term_no", "qualifier", "mechanism", "value")

    return build


def _odd_summary(mode):
    def build(spark, sf_dir):
        mx = scans.parse_mx(fixtures.odd_mx_lines(spark, sf_dir).drop("k"), mode)
        return deployment.summary(_odd_spf(spark, sf_dir, mode), mx, mode).select("tld", "metric", "n")

    return build


def _odd_names(spark, sf_dir):
    name = F.col("name")
    return _odd_spf(spark, sf_dir).select("name", tld(name).alias("tld"), second_level(name).alias("sld"))


def _multiple(spark, sf_dir):
    spf = scans.parse_spf(fixtures.spf_lines_repeated(spark, sf_dir))
    return terms.multiple_policies(spf).select("name", "n_policies")


def _by_customer(count, mode):
    def build(spark, sf_dir):
        parsed = parse_reports(fixtures.customer_report_lines(spark, sf_dir))
        names = parse_names(fixtures.customer_name_lines(spark, sf_dir), mode)
        return count(reports.restrict(reports.facts(parsed, mode), names, mode))

    return build


def _lines_by_name(kept):
    return kept.groupBy("query").agg(F.count("*").alias("lines"), F.sum("copies").alias("copies"))


def _message_lines(mode):
    def build(spark, sf_dir):
        parsed = parse_reports(fixtures.customer_report_lines(spark, sf_dir))
        kept = reports.restrict(reports.messages(parsed, "warnings"), parse_names(fixtures.customer_name_lines(spark, sf_dir), mode), mode)
        return sinks.message_lines(kept if mode == REFERENCE else kept.drop("copies"))

    return build


def _one_pass_lines(mode):
    """Lines of the warnings from the rows that serve the tally and both kinds."""
    def build(spark, sf_dir):
        parsed = parse_reports(fixtures.customer_report_lines(spark, sf_dir))
        names = parse_names(fixtures.customer_name_lines(spark, sf_dir), mode)
        kept = reports.messages_of(reports.restrict(reports.facts_with_messages(parsed, mode), names, mode), "warnings")
        return sinks.message_lines(kept if mode == REFERENCE else kept.drop("copies"))

    return build


def _summary_lines(spark, sf_dir):
    return sinks.summary_lines(deployment.wide(scan_queries.summary(REFERENCE, (1, 2))(spark, sf_dir)))


def _server_lines(spark, sf_dir):
    servers = log_queries.servers(spark, sf_dir, REFERENCE)
    return sinks.server_total_lines(probes.max_totals(servers))


def _funnel_until(spark, sf_dir):
    log = querylog.parse_all(fixtures.log_lines_dated(spark, sf_dir).drop("e"), _UNTIL)
    ids = log_queries.ids(spark, sf_dir)
    return probes.funnel(probes.label_counts(log, DOMAIN), ids)


def _border_labels(spark, sf_dir):
    moved = log_queries.ids(spark, sf_dir).withColumn("pos", F.col("pos") + _BORDER)
    return probes.labels(moved, REFERENCE, _SHORT)


def _server_curve(spark, sf_dir):
    found = counts.parse_server_counts(fixtures.server_count_lines(spark, sf_dir).select("value"))
    series = probes.server_series(found.select("server_id", F.col("total").alias("max_total"), F.col("void").alias("void_total")))
    return curves.cdf(series, "value", by=["series"]).withColumn("cdf", F.round("cdf", 6))


QUERIES = {
    "odd_policy_terms": _odd_terms(REFERENCE),
    "odd_policy_terms_strict": _odd_terms(STRICT),
    "odd_policy_summary": _odd_summary(REFERENCE),
    "odd_policy_summary_strict": _odd_summary(STRICT),
    "odd_names": _odd_names,
    "multiple_policy_names": _multiple,
    "mx_parse_rejects": lambda spark, sf: scans.mx_rejects(fixtures.odd_mx_lines(spark, sf)).select("k"),
    "report_parse_rejects": lambda spark, sf: report_rejects(fixtures.report_lines(spark, sf)).groupBy("value").agg(F.count("*").alias("n")),
    "include_count_rejects": lambda spark, sf: counts.include_count_rejects(fixtures.include_lines_broken(spark, sf)),
    "reports_of_a_name": _by_customer(_lines_by_name, REFERENCE),
    "reports_of_a_name_strict": _by_customer(_lines_by_name, STRICT),
    "two_class_labels": _by_customer(lambda k: reports.warning_labels(k, REFERENCE), REFERENCE),
    "two_class_labels_strict": _by_customer(reports.warning_labels, STRICT),
    "warning_lines": _message_lines(REFERENCE),
    "warning_lines_strict": _message_lines(STRICT),
    "warning_lines_of_one_pass": _one_pass_lines(REFERENCE),
    "warning_lines_of_one_pass_strict": _one_pass_lines(STRICT),
    "summary_lines": _summary_lines,
    "server_total_lines": _server_lines,
    "log_parse_until": lambda spark, sf: querylog.parse_log(fixtures.log_lines_dated(spark, sf), _UNTIL).select("e"),
    "log_date_rejects": lambda spark, sf: querylog.log_rejects(fixtures.log_lines_dated(spark, sf)).select("e"),
    "log_funnel_until": _funnel_until,
    "id_positions": lambda spark, sf: querylog.number_ids(fixtures.numbered_id_pieces(spark, sf)),
    "id_strings": lambda spark, sf: querylog.number_ids(fixtures.odd_id_pieces(spark, sf)),
    "probe_labels_border": _border_labels,
    "server_count_curve": _server_curve,
    "server_count_rejects": lambda spark, sf: counts.server_count_rejects(fixtures.server_count_lines(spark, sf)).select("user_id"),
}

# --- the same answers from the base columns

_ODD = """WITH part_name AS (SELECT p_partkey AS k,
    CASE WHEN p_partkey % 3 = 0 THEN 'w.' ELSE '' END || 'n' || p_partkey || CASE WHEN p_partkey % 3 = 1 THEN '.co.se' ELSE '.com' END AS name,
    CASE WHEN p_partkey % 3 = 1 THEN 'se' ELSE 'com' END AS tld FROM part)"""

# (shape, place, qualifier, mechanism, value): what the odd policies hold
_ODD_TERMS = {
    REFERENCE: """(0, 0, '', 'a', name), (2, 1, '~', 'all', 'all'), (3, 0, '', 'mx', name), (3, 1, '', 'all', 'all'),
        (4, 0, '', 'include', 'not' || name), (4, 1, '-', 'all', 'all'), (5, 0, '', 'include', ''), (5, 1, '-', 'all', 'all'),
        (7, 0, '', 'ip4', '192.0.2.1'), (7, 1, '-', 'all', 'all')""",
    STRICT: """(1, 0, '', 'mx', name), (1, 1, '-', 'all', 'all'), (2, 0, '', 'a', name), (2, 1, '~', 'all', 'all'),
        (4, 0, '', 'include', 'not' || name), (4, 1, '-', 'all', 'all'), (5, 1, '-', 'all', 'all'),
        (6, 0, '', 'a', name), (6, 1, '-', 'all', 'all'), (7, 0, '', 'ip4', '192.0.2.1'), (7, 1, '-', 'all', 'all')""",
}
_ODD_SHAPES = {  # of the eight shapes, those that count
    REFERENCE: {"total": "0, 1, 2, 3, 4, 5, 6, 7", "deployed": "0, 1, 2, 3, 4, 5, 7", "a": "0", "mx": "3", "include": "4, 5",
                "ip4": "7", "all": "2, 3, 4, 5, 7", "external_include": "5"},
    STRICT: {"total": "0, 1, 2, 3, 4, 5, 6, 7", "deployed": "1, 2, 3, 4, 5, 6, 7", "a": "2, 6", "mx": "1", "include": "4",
             "ip4": "7", "all": "1, 2, 4, 5, 6, 7", "external_include": "4"},
}


def _odd_terms_sql(mode):
    return f"""{_ODD} SELECT name, tld, CAST(0 AS INTEGER) AS answer_no, CAST(t.i AS INTEGER) AS term_no, t.q AS qualifier,
        t.m AS mechanism, t.v AS value
      FROM part_name, LATERAL (SELECT * FROM (VALUES {_ODD_TERMS[mode]}) AS x(s, i, q, m, v) WHERE s = k % 8) AS t"""


def _odd_summary_sql(mode):
    metrics = deployment.METRICS if mode == REFERENCE else [*deployment.METRICS, "multiple_policies"]
    return _ODD + " UNION ALL ".join(
        f" SELECT tld, '{m}' AS metric, COUNT(*) FILTER (WHERE k % 8 IN ({_ODD_SHAPES[mode].get(m, '-1')})) AS n"
        " FROM part_name WHERE k % 10 <> 9 GROUP BY tld"
        for m in metrics
    )


_KEPT = """WITH line AS (SELECT DISTINCT o_custkey AS c, o_orderkey % 15 AS x FROM orders JOIN customer ON o_custkey = c_custkey),
    r AS (SELECT c, x, {copies} AS copies FROM line)"""


def _kept_sql(mode):
    return _KEPT.format(copies="CASE WHEN c % 4 = 0 THEN 2 ELSE 1 END" if mode == REFERENCE else "1")


def _by_name_sql(mode):
    return f"""{_kept_sql(mode)} SELECT 'c' || c || '.com' AS query, COUNT(*) AS lines, CAST(SUM(copies) AS BIGINT) AS copies
        FROM r GROUP BY c"""


_WARNING = """CASE x % 3 WHEN 0 THEN '["Unable to look up TXT record for ''t.com''"]'
    WHEN 1 THEN '["Unable to look up TXT record of ''t.com''"]'
    ELSE '["Unable to look up TXT record of ''t.com''","Unable to look up TXT record for ''t.com''"]' END"""


def _lines_sql(mode):
    return f"""{_kept_sql(mode)} SELECT 'c' || c || '.com {{"c' || c || '.com":' || {_WARNING} || '}}' AS value
        FROM r, range(copies)"""


_DATED = "NOT bad AND e % 97 <> 5"
_BEFORE = f"{_DATED} AND CAST(ts AS DATE) < DATE '{_UNTIL}'"

_SERVER = """WITH counted AS (SELECT user_id, COUNT(*) AS total, COUNT(*) FILTER (WHERE event_type = 'error') AS void
    FROM events GROUP BY user_id)"""

SQL = {
    "odd_policy_terms": _odd_terms_sql(REFERENCE),
    "odd_policy_terms_strict": _odd_terms_sql(STRICT),
    "odd_policy_summary": _odd_summary_sql(REFERENCE),
    "odd_policy_summary_strict": _odd_summary_sql(STRICT),
    "odd_names": f"{_ODD} SELECT name, tld, CASE WHEN k % 3 = 1 THEN 'co.se' ELSE 'n' || k || '.com' END AS sld FROM part_name",
    "multiple_policy_names": f"""WITH {scan_queries.NAMES} SELECT name, CASE WHEN k % 3 <> 0 THEN 2 ELSE 1 END AS n_policies
        FROM names, range(2) WHERE segment = 'HOUSEHOLD' AND k % 50 <> 49 AND k % 3 <> 0""",
    "mx_parse_rejects": "SELECT p_partkey AS k FROM part WHERE p_partkey % 10 = 9",
    "report_parse_rejects": "SELECT '{broken' AS value, COUNT(*) AS n FROM orders WHERE o_orderkey % 97 = 96 HAVING COUNT(*) > 0",
    "include_count_rejects": """SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_custkey || ' ' END || '_spf.p' || c_custkey
        || '.net ' || CASE WHEN c_custkey % 11 = 0 THEN 'x' ELSE CAST(c_custkey AS VARCHAR) END AS value
        FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 11 = 0""",
    "reports_of_a_name": _by_name_sql(REFERENCE),
    "reports_of_a_name_strict": _by_name_sql(STRICT),
    "two_class_labels": f"""{_kept_sql(REFERENCE)} SELECT 'Missing TXT' AS label, class, CAST(SUM(copies) AS BIGINT) AS n FROM (
        SELECT 'Unable to look up TXT record' AS class, copies FROM r WHERE x % 3 <> 1
        UNION ALL SELECT 'Unable to look up TXT record of ''''', copies FROM r WHERE x % 3 <> 0) GROUP BY class""",
    "two_class_labels_strict": f"{_kept_sql(STRICT)} SELECT 'Missing TXT' AS label, COUNT(*) AS n FROM r HAVING COUNT(*) > 0",
    "warning_lines": _lines_sql(REFERENCE),
    "warning_lines_strict": _lines_sql(STRICT),
    "warning_lines_of_one_pass": _lines_sql(REFERENCE),
    "warning_lines_of_one_pass_strict": _lines_sql(STRICT),
    "summary_lines": f"""SELECT concat_ws(' ', snapshot_date, joined, {', '.join(f'{m}_{z}' for m in deployment.METRICS for z in deployment.ZONES)}) AS value
        FROM ({scan_queries.SQL["snapshot_summary_wide"]})""",
    "server_total_lines": f"SELECT concat_ws(' ', server_id, max_total, void_total) AS value FROM ({log_queries.SQL['server_max_totals']})",
    "log_parse_until": f"{log_queries.EVENTS} SELECT e FROM log WHERE {_BEFORE}",
    "log_date_rejects": f"{log_queries.EVENTS} SELECT e FROM log WHERE NOT ({_DATED})",
    "log_funnel_until": f"""{log_queries.EVENTS}, seen AS (SELECT *, {_DATED} AS fine FROM log WHERE NOT ({_DATED}) OR {_BEFORE})
        SELECT COUNT(*) AS lines, COUNT(*) FILTER (WHERE NOT fine) AS unreadable,
          COUNT(*) FILTER (WHERE fine AND rr_type = 'TXT') AS txt_rows,
          COUNT(*) FILTER (WHERE fine AND rr_type = 'TXT' AND lower(sent) = label) AS mapped_rows FROM seen""",
    "id_positions": """WITH p AS (SELECT DISTINCT CAST(floor(sqrt(user_id)) AS BIGINT) AS k FROM events),
        numbered AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS pos FROM p)
        SELECT pos, substr(md5(CAST(k AS VARCHAR)), 1, 16) AS id FROM numbered WHERE k % 5 <> 4""",
    "id_strings": """SELECT pos, CASE p_partkey % 6 WHEN 1 THEN 'a' || p_partkey WHEN 2 THEN 'b,' || p_partkey || ','
          WHEN 3 THEN 'c",' || p_partkey || chr(92) WHEN 4 THEN '[' || p_partkey || '],' ELSE 'null' || p_partkey END AS id
        FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part) WHERE p_partkey % 6 <> 0""",
    "probe_labels_border": log_queries.labels_sql(REFERENCE, _SHORT, moved=_BORDER),
    "server_count_curve": f"""{_SERVER}, v AS (
        SELECT UNNEST(['total', 'void']) AS series, UNNEST([total, void]) AS value FROM counted WHERE user_id % 9 <> 8),
      h AS (SELECT series, value, COUNT(*) AS n FROM v GROUP BY ALL),
      c AS (SELECT series, value, SUM(n) OVER (PARTITION BY series ORDER BY value) AS cum, SUM(n) OVER (PARTITION BY series) AS total FROM h)
      SELECT series, value, CAST(cum AS BIGINT) AS cum, CAST(total AS BIGINT) AS total, ROUND(cum / total, 6) AS cdf FROM c""",
    "server_count_rejects": "SELECT DISTINCT user_id FROM events WHERE user_id % 9 = 8",
}
