"""Query-log and probe queries over the event fixtures."""

from pyspark.sql import functions as F

from mailpolicy.catalog.fixtures import DOMAIN, id_pieces, log_lines
from mailpolicy.modes import REFERENCE, STRICT
from mailpolicy.operators import curves, probes
from mailpolicy.sources.querylog import log_rejects, parse_all, parse_id, parse_log

# short labels meet often, which shows who gets them
_SHORT = 3


def ids(spark, sf_dir):
    return id_pieces(spark, sf_dir).select("pos", parse_id(F.col("value")).alias("id"))


def _log(spark, sf_dir):
    return log_lines(spark, sf_dir).drop("e")


def servers(spark, sf_dir, mode):
    return probes.server_counts(parse_log(_log(spark, sf_dir)), ids(spark, sf_dir), DOMAIN, mode)


def _state(spark, sf_dir, mode, part=None):
    log = _log(spark, sf_dir) if part is None else log_lines(spark, sf_dir).where(part).drop("e")
    return probes.state(probes.label_counts(parse_log(log), DOMAIN, mode), ids(spark, sf_dir), mode)


def _merged(mode):
    """Servers of three parts of the log, merged two and then one."""
    def build(spark, sf_dir):
        parts = [_state(spark, sf_dir, mode, f"e % 3 = {i}") for i in range(3)]
        return probes.of_state(probes.merged(parts[2], probes.merged(*parts[:2]))).select(*_COUNTS)

    return build


def _over(build, mode):
    return lambda spark, sf_dir: build(servers(spark, sf_dir, mode))


def _limits(build, mode):
    return lambda spark, sf_dir: build(servers(spark, sf_dir, mode), mode)


def _labels(mode, digits):
    return lambda spark, sf_dir: probes.labels(ids(spark, sf_dir), mode, digits)


def _funnel(mode):
    def build(spark, sf_dir):
        counts = probes.label_counts(parse_all(_log(spark, sf_dir)), DOMAIN, mode)
        return probes.funnel(counts, ids(spark, sf_dir), mode)

    return build


_COUNTS = ["server_id", "total1", "unique1", "total2", "unique2", "void_total", "void_unique"]


def _curve(servers):
    curve = curves.cdf(probes.server_series(probes.max_totals(servers)), "value", by=["series"])
    return curve.withColumn("cdf", F.round("cdf", 6))


def _scanned_and_responding(spark, sf_dir):
    scanned = probes.scanned(ids(spark, sf_dir)).select(F.lit("scanned").alias("measure"), "n")
    limits = probes.limits(servers(spark, sf_dir, STRICT))
    return scanned.unionByName(limits.select(F.lit("responding").alias("measure"), F.col("responding").alias("n")))


QUERIES = {
    "log_parse": lambda spark, sf: parse_log(log_lines(spark, sf)),
    "log_rejects": lambda spark, sf: log_rejects(log_lines(spark, sf)),
    "probe_labels": _labels(STRICT, probes.LABEL_DIGITS),
    "probe_labels_short": _labels(REFERENCE, _SHORT),
    "probe_labels_short_strict": _labels(STRICT, _SHORT),
    "ambiguous_labels_short": lambda spark, sf: probes.ambiguous_labels(ids(spark, sf), _SHORT),
    "log_funnel": _funnel(REFERENCE),
    "log_funnel_strict": _funnel(STRICT),
    "server_counts": _over(lambda s: s.select(*_COUNTS), REFERENCE),
    "server_counts_strict": _over(lambda s: s.select(*_COUNTS), STRICT),
    "server_counts_merged": _merged(REFERENCE),
    "server_counts_merged_strict": _merged(STRICT),
    "server_state": lambda spark, sf: _state(spark, sf, REFERENCE),
    "server_max_totals": _over(probes.max_totals, REFERENCE),
    "server_cdf": _over(_curve, REFERENCE),
    "server_indicators_strict": _over(
        lambda s: s.select("server_id", *[F.col(f"indicators{i}").cast("int").alias(f"indicators{i}") for i in (1, 2)]),
        STRICT,
    ),
    "no_total_limit": _limits(probes.no_total_limit, REFERENCE),
    "no_total_limit_strict": _limits(probes.no_total_limit, STRICT),
    "over_51_queries": _limits(probes.many_queries, REFERENCE),
    "over_51_queries_strict": _limits(probes.many_queries, STRICT),
    "no_void_limit": _over(probes.no_void_limit, REFERENCE),
    "vulnerable_in_both": _limits(probes.vulnerable_in_both, REFERENCE),
    "vulnerable_in_both_strict": _limits(probes.vulnerable_in_both, STRICT),
    "server_limits": _limits(probes.limits, REFERENCE),
    "server_limits_strict": _limits(probes.limits, STRICT),
    "servers_scanned_and_responding": _scanned_and_responding,
}

# --- the same answers from the base columns

EVENTS = f"""WITH ev AS (
  SELECT event_id AS e, ts, substr(md5(CAST(CAST(floor(sqrt(user_id)) AS BIGINT) AS VARCHAR)), 1, 16) AS id,
         CAST(event_id % 51 AS INTEGER) AS no, CAST(1 + (event_id // 51) % 2 AS INTEGER) AS test FROM events),
labelled AS (SELECT *, substr(md5(no || '.test' || test || '.' || id), 1, 8) AS label FROM ev),
log AS (SELECT *, CASE WHEN e % 29 = 0 THEN 'zzzzzzzz' WHEN e % 19 = 0 THEN upper(label) ELSE label END AS sent,
               e % 500 = 499 AS bad, CASE WHEN e % 13 = 0 THEN 'A' ELSE 'TXT' END AS rr_type FROM labelled)"""


def _found(mode):
    sent = "sent" if mode == REFERENCE else "lower(sent)"
    return f"{sent} = label"


def _servers_sql(mode):
    """``s``: one row per server; as eight-digit labels do not meet in these tables, a label is its own event's."""
    indicators = ", ".join(str(i) for i in probes.INDICATORS)
    return f"""{EVENTS}, hit AS (SELECT * FROM log WHERE NOT bad AND rr_type = 'TXT' AND {_found(mode)}),
    s AS (SELECT id AS server_id,
      COUNT(*) FILTER (WHERE test = 1) AS total1, COUNT(DISTINCT no) FILTER (WHERE test = 1) AS unique1,
      COUNT(*) FILTER (WHERE test = 2) AS total2, COUNT(DISTINCT no) FILTER (WHERE test = 2) AS unique2,
      COUNT(*) FILTER (WHERE test = 2 AND no BETWEEN 15 AND 50) AS void_total,
      COUNT(DISTINCT no) FILTER (WHERE test = 2 AND no BETWEEN 15 AND 50) AS void_unique,
      CAST(COUNT(DISTINCT no) FILTER (WHERE test = 1 AND no IN ({indicators})) = 9 AS INTEGER) AS indicators1,
      CAST(COUNT(DISTINCT no) FILTER (WHERE test = 2 AND no IN ({indicators})) = 9 AS INTEGER) AS indicators2
      FROM hit GROUP BY id)"""


def _passes(measure, mode):
    if mode == REFERENCE:
        return {t: f"{measure}{t} >= 51" for t in (1, 2)}
    return {t: f"({measure}{t} >= 51 OR (indicators{t} = 1 AND unique{t} >= 45))" for t in (1, 2)}


def _pairs_rows(measure, mode):
    passes = _passes(measure, mode)
    rows = " UNION ".join(f"SELECT server_id, {measure}{t} AS n FROM s WHERE {c}" for t, c in passes.items())
    return rows if mode == REFERENCE else f"SELECT server_id, MAX(n) AS n FROM ({rows}) GROUP BY server_id"


def _pairs_sql(measure, mode):
    return f"{_servers_sql(mode)} {_pairs_rows(measure, mode)}"


def _both_rows(mode):
    return f"""SELECT server_id FROM ({_pairs_rows('unique', mode)})
        INTERSECT SELECT server_id FROM s WHERE void_unique >= 31"""


def _limits_sql(mode):
    return f"""{_servers_sql(mode)} SELECT (SELECT COUNT(*) FROM s WHERE unique1 > 0) AS responding,
      (SELECT COUNT(*) FROM ({_pairs_rows('unique', mode)})) AS no_total_limit,
      (SELECT COUNT(*) FROM ({_pairs_rows('total', mode)})) AS many_queries,
      (SELECT COUNT(*) FROM s WHERE void_unique >= 31) AS no_void_limit,
      (SELECT COUNT(*) FROM ({_both_rows(mode)})) AS in_both"""


def _funnel_sql(mode):
    hit = "NOT bad AND rr_type = 'TXT'"
    return f"""{EVENTS} SELECT COUNT(*) AS lines, COUNT(*) FILTER (WHERE bad) AS unreadable,
      COUNT(*) FILTER (WHERE {hit}) AS txt_rows, COUNT(*) FILTER (WHERE {hit} AND {_found(mode)}) AS mapped_rows FROM log"""


_IDS = """WITH ids AS (SELECT DISTINCT CAST(floor(sqrt(user_id)) AS BIGINT) AS pos FROM events),
probes AS (SELECT pos, substr(md5(CAST(pos AS VARCHAR)), 1, 16) AS id, CAST(no AS INTEGER) AS no, CAST(test AS INTEGER) AS test
  FROM ids, range(51) AS n(no), (VALUES (1), (2)) AS t(test))"""


def labels_sql(mode, digits, moved=0):
    labelled = f"""{_IDS}, labelled AS (
        SELECT *, substr(md5(no || '.test' || test || '.' || id), 1, {digits}) AS label FROM probes)"""
    if mode == REFERENCE:
        keep = f"row_number() OVER (PARTITION BY label ORDER BY pos + {moved} < 1000000 DESC, pos DESC, no DESC, test DESC) = 1"
    else:
        keep = "count(*) OVER (PARTITION BY label) = 1"
    return f"{labelled} SELECT label, id, no, test FROM labelled QUALIFY {keep}"


def _ambiguous_sql():
    return f"""{_IDS} SELECT COUNT(*) AS n FROM (SELECT 1 FROM probes
        GROUP BY substr(md5(no || '.test' || test || '.' || id), 1, {_SHORT}) HAVING COUNT(*) > 1)"""


def _cdf_sql():
    return f"""{_servers_sql(REFERENCE)}, v AS (SELECT 'total' AS series, greatest(total1, total2) AS value FROM s
        UNION ALL SELECT 'void', void_total FROM s), h AS (SELECT series, value, COUNT(*) AS n FROM v GROUP BY ALL),
      c AS (SELECT series, value, SUM(n) OVER (PARTITION BY series ORDER BY value) AS cum,
                   SUM(n) OVER (PARTITION BY series) AS total FROM h)
      SELECT series, value, CAST(cum AS BIGINT) AS cum, CAST(total AS BIGINT) AS total, ROUND(cum / total, 6) AS cdf FROM c"""


SQL = {
    "log_parse": f"""{EVENTS} SELECT e, strftime(ts, '%d-%b-%Y %H:%M:%S.%g') AS ts_text,
      sent || '.{DOMAIN}' AS qname, rr_type, '192.0.2.' || (e % 250) AS client_ip, '-E(0)' AS flags FROM log WHERE NOT bad""",
    "log_rejects": f"{EVENTS} SELECT e, 'short line' AS value FROM log WHERE bad",
    "probe_labels": labels_sql(STRICT, probes.LABEL_DIGITS),
    "probe_labels_short": labels_sql(REFERENCE, _SHORT),
    "probe_labels_short_strict": labels_sql(STRICT, _SHORT),
    "ambiguous_labels_short": _ambiguous_sql(),
    "log_funnel": _funnel_sql(REFERENCE),
    "log_funnel_strict": _funnel_sql(STRICT),
    "server_counts": f"{_servers_sql(REFERENCE)} SELECT {', '.join(_COUNTS)} FROM s",
    "server_counts_strict": f"{_servers_sql(STRICT)} SELECT {', '.join(_COUNTS)} FROM s",
    "server_counts_merged": f"{_servers_sql(REFERENCE)} SELECT {', '.join(_COUNTS)} FROM s",
    "server_counts_merged_strict": f"{_servers_sql(STRICT)} SELECT {', '.join(_COUNTS)} FROM s",
    "server_state": f"""{_servers_sql(REFERENCE)}, m AS (SELECT id AS server_id,
        COALESCE(BIT_OR(CAST(1 AS BIGINT) << no) FILTER (WHERE test = 1), 0) AS mask1,
        COALESCE(BIT_OR(CAST(1 AS BIGINT) << no) FILTER (WHERE test = 2), 0) AS mask2 FROM hit GROUP BY id)
      SELECT server_id, total1, total2, void_total, mask1, mask2 FROM s JOIN m USING (server_id)""",
    "server_max_totals": f"{_servers_sql(REFERENCE)} SELECT server_id, greatest(total1, total2) AS max_total, void_total FROM s",
    "server_cdf": _cdf_sql(),
    "server_indicators_strict": f"{_servers_sql(STRICT)} SELECT server_id, indicators1, indicators2 FROM s",
    "no_total_limit": _pairs_sql("unique", REFERENCE),
    "no_total_limit_strict": _pairs_sql("unique", STRICT),
    "over_51_queries": _pairs_sql("total", REFERENCE),
    "over_51_queries_strict": _pairs_sql("total", STRICT),
    "no_void_limit": f"{_servers_sql(REFERENCE)} SELECT server_id, void_unique AS n FROM s WHERE void_unique >= 31",
    "vulnerable_in_both": f"{_servers_sql(REFERENCE)} {_both_rows(REFERENCE)}",
    "vulnerable_in_both_strict": f"{_servers_sql(STRICT)} {_both_rows(STRICT)}",
    "server_limits": _limits_sql(REFERENCE),
    "server_limits_strict": _limits_sql(STRICT),
    "servers_scanned_and_responding": f"""{_servers_sql(STRICT)}
      SELECT 'scanned' AS measure, COUNT(DISTINCT floor(sqrt(user_id))) AS n FROM events
      UNION ALL SELECT 'responding', COUNT(*) FROM s WHERE unique1 > 0""",
}
