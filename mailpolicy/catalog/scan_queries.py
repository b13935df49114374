"""Deployment queries over the scan fixtures."""

from pyspark.sql import functions as F

from mailpolicy.catalog.fixtures import (
    FIRST,
    LAST,
    mx_lines,
    mx_lines_repeated,
    spf_lines,
    spf_lines_repeated,
)
from mailpolicy.functions.names import second_level, tld
from mailpolicy.functions.policy import MECHANISMS
from mailpolicy.modes import REFERENCE, STRICT
from mailpolicy.operators import deployment, terms
from mailpolicy.sources.scans import parse_mx, parse_spf, spf_rejects


def summary(mode, snapshots=(1,), zones=None):
    def build(spark, sf_dir):
        spf = mx = None
        for v in snapshots:
            s, m = spf_lines(spark, sf_dir, v).drop("k", "segment"), mx_lines(spark, sf_dir, v)
            spf, mx = (s, m) if spf is None else (spf.unionByName(s), mx.unionByName(m))
        return deployment.summary(parse_spf(spf, mode), parse_mx(mx, mode), mode, zones)

    return build


def _metrics(mode, metrics, name="metric"):
    def build(spark, sf_dir):
        table = summary(mode)(spark, sf_dir).where(F.col("metric").isin(*metrics))
        return table.select("tld", F.col("metric").alias(name), "n")

    return build


def _metric(mode, metric):
    return lambda spark, sf_dir: _metrics(mode, [metric])(spark, sf_dir).select("tld", "n")


def _with_date_text(df):
    return df.withColumn("snapshot_date", F.col("snapshot_date").cast("string"))


def _fanout(mode):
    def build(spark, sf_dir):
        spf = parse_spf(spf_lines_repeated(spark, sf_dir), mode)
        return deployment.summary(spf, parse_mx(mx_lines_repeated(spark, sf_dir), mode), mode).select("tld", "metric", "n")

    return build


def _joined_names(mode):
    def build(spark, sf_dir):
        spf = parse_spf(spf_lines_repeated(spark, sf_dir), mode)
        return deployment.joined_names(spf, parse_mx(mx_lines_repeated(spark, sf_dir), mode), mode).select("name", "n")

    return build


def _terms(mode):
    def build(spark, sf_dir):
        spf = parse_spf(spf_lines(spark, sf_dir, 1).drop("k", "segment"), mode)
        rows = terms.explode_terms(spf, mode).where(F.col("mechanism").isNotNull())
        return rows.select("name", "tld", "answer_no", "term_no", "qualifier", "mechanism", "value")

    return build


def _names(spark, sf_dir):
    name = F.col("name")
    spf = parse_spf(spf_lines(spark, sf_dir, 1).drop("k", "segment"))
    return spf.select("name", tld(name).alias("tld"), second_level(name).alias("sld"))


def _shares(spark, sf_dir):
    shares = deployment.shares(summary(STRICT, (1, 2), deployment.ZONES)(spark, sf_dir))
    return _with_date_text(shares).withColumn("share", F.round("share", 6))


def _change(mode):
    def build(spark, sf_dir):
        change = deployment.share_change(summary(mode, (1, 2))(spark, sf_dir), FIRST, LAST)
        return change.select(
            "tld",
            "mechanism",
            *[F.round(c, 6).alias(c) for c in ("share_first", "share_last", "change")],
            (F.col("change_pct") + F.lit(0.0)).alias("change_pct"),
        )

    return build


QUERIES = {
    "scan_total_by_tld": _metric(REFERENCE, "total"),
    "scan_joined_total": lambda spark, sf: _with_date_text(
        deployment.joined_total(summary(REFERENCE, (1, 2))(spark, sf))
    ),
    "scan_parse_rejects": lambda spark, sf: spf_rejects(spf_lines(spark, sf, 1)).select("k", "value"),
    "scan_names": _names,
    "mx_present_names": lambda spark, sf: parse_mx(mx_lines(spark, sf, 1)).select("name"),
    "policy_deployed_by_tld": _metric(REFERENCE, "deployed"),
    "policy_deployed_by_tld_strict": _metric(STRICT, "deployed"),
    "policy_terms": _terms(REFERENCE),
    "policy_terms_strict": _terms(STRICT),
    "mechanism_counts_by_tld": _metrics(REFERENCE, MECHANISMS, "mechanism"),
    "mechanism_counts_by_tld_strict": _metrics(STRICT, MECHANISMS, "mechanism"),
    "external_include_by_tld": _metric(REFERENCE, "external_include"),
    "external_include_by_tld_strict": _metric(STRICT, "external_include"),
    "snapshot_summary_long": lambda spark, sf: _with_date_text(
        summary(REFERENCE, (1, 2), deployment.ZONES)(spark, sf)
    ),
    "snapshot_summary_wide": lambda spark, sf: _with_date_text(
        deployment.wide(summary(REFERENCE, (1, 2))(spark, sf))
    ),
    "snapshot_table1": lambda spark, sf: deployment.table1(summary(REFERENCE, (1, 2))(spark, sf)),
    "mechanism_share": _shares,
    "mechanism_change": _change(REFERENCE),
    "mechanism_change_strict": _change(STRICT),
    "join_fanout_reference": _joined_names(REFERENCE),
    "join_fanout_strict": _joined_names(STRICT),
    "fanout_summary_reference": _fanout(REFERENCE),
    "fanout_summary_strict": _fanout(STRICT),
}

# --- the same answers from the base columns

NAMES = """names AS (
  SELECT c_custkey AS k, c_mktsegment AS segment,
         ['com', 'net', 'org', 'se', 'io'][CAST(c_custkey % 5 AS INTEGER) + 1] AS tld,
         'd' || c_custkey || '.' || ['com', 'net', 'org', 'se', 'io'][CAST(c_custkey % 5 AS INTEGER) + 1] AS name
  FROM customer)"""

# one row per name that has a TXT and an MX record, per snapshot
_JOINED = f"""WITH {NAMES}, joined AS (
  SELECT CASE v WHEN 1 THEN '{FIRST}' ELSE '{LAST}' END AS snapshot_date, v, k, tld, k % (2 + v) <> 0 AS pol
  FROM names, (VALUES (1), (2)) AS s(v)
  WHERE k % 50 <> 49 AND k % 6 <> 1)"""


def _conditions(mode):
    outside = "k % 11 < 4 + 2 * v AND k % 22 < 11" if mode == REFERENCE else "k % 11 < 4 + 2 * v"
    return {
        "total": "TRUE",
        "deployed": "pol",
        "a": "pol AND k % 2 = 0",
        "mx": "pol AND k % 7 < 3",
        "include": f"pol AND (({outside}) OR k % 9 = 0)",
        "ip4": "pol AND k % 13 < 5",
        "ip6": "pol AND k % 17 < 3",
        "ptr": "pol AND k % 19 = 0",
        "all": "pol AND k % 37 <> 0",
        "exp": "pol AND k % 31 = 0",
        "redirect": "pol AND k % 29 = 0",
        "exists": "pol AND k % 23 = 0",
        "external_include": f"pol AND {outside}",
    }


def _count(condition):
    return f"CAST(COUNT(*) FILTER (WHERE {condition}) AS BIGINT)"


def _by_tld(mode, metrics, name):
    conditions = _conditions(mode)
    return _JOINED + " UNION ALL ".join(
        f" SELECT tld, '{m}' AS {name}, {_count(conditions[m])} AS n FROM joined WHERE v = 1 GROUP BY tld" for m in metrics
    )


def _one_by_tld(mode, metric):
    return f"{_JOINED} SELECT tld, {_count(_conditions(mode)[metric])} AS n FROM joined WHERE v = 1 GROUP BY tld"


_ZONES = "('com', 'net', 'org', 'se')"


def _long_sql(mode):
    return _JOINED + " UNION ALL ".join(
        f" SELECT snapshot_date, tld, '{m}' AS metric, {_count(c)} AS n FROM joined"
        f" WHERE tld IN {_ZONES} GROUP BY snapshot_date, tld"
        for m, c in _conditions(mode).items()
    )


def _wide_sql():
    cells = ", ".join(
        f"{_count(f'''({c}) AND tld = '{z}' ''')} AS {m}_{z}"
        for m, c in _conditions(REFERENCE).items()
        for z in deployment.ZONES
    )
    return f"{_JOINED} SELECT snapshot_date, COUNT(*) AS joined, {cells} FROM joined GROUP BY snapshot_date"


def _table1_sql():
    measures = {
        "with_mx": "total", "deployed": "deployed", "with_include": "include", "with_external_include": "external_include"
    }
    conditions = _conditions(REFERENCE)
    rows = []
    for label, m in measures.items():
        cells = ", ".join(f"{_count(f'''({conditions[m]}) AND tld = '{z}' ''')} AS {z}" for z in deployment.ZONES)
        rows.append(f" SELECT '{label}' AS measure, {cells} FROM joined WHERE v = 2")
    return _JOINED + " UNION ALL ".join(rows)


def _share_rows(mode):
    conditions = _conditions(mode)
    return " UNION ALL ".join(
        f"SELECT snapshot_date, v, tld, '{m}' AS mechanism, {_count(conditions[m])} AS n, {_count('pol')} AS deployed"
        f" FROM joined WHERE tld IN {_ZONES} GROUP BY snapshot_date, v, tld"
        for m in MECHANISMS
    )


def _share_sql():
    return f"""{_JOINED}, counted AS ({_share_rows(STRICT)})
        SELECT snapshot_date, tld, mechanism, n, deployed, ROUND(n / NULLIF(deployed, 0), 6) AS share FROM counted"""


def _change_sql(mode):
    changed = ", ".join(f"'{m}'" for m in deployment.CHANGED)
    return f"""{_JOINED}, counted AS ({_share_rows(mode)}), pairs AS (
        SELECT tld, mechanism, MAX(n / deployed) FILTER (WHERE v = 1) AS share_first,
               MAX(n / deployed) FILTER (WHERE v = 2) AS share_last
        FROM counted WHERE mechanism IN ({changed}) GROUP BY tld, mechanism)
        SELECT tld, mechanism, ROUND(share_first, 6) AS share_first, ROUND(share_last, 6) AS share_last,
               ROUND(share_last - share_first, 6) AS change,
               CAST(format('{{:.1f}}', (share_last - share_first) * 100) AS DOUBLE) + 0.0 AS change_pct FROM pairs"""


def _terms_sql(mode):
    def term(condition, qualifier, mechanism, value):
        return (
            f"CASE WHEN {condition} THEN {{'q': '{qualifier}', 'm': {mechanism}, 'v': {value}}} END"
        )

    none = "CAST(NULL AS VARCHAR)"
    dashed = none if mode == REFERENCE else "'include'"
    ip6 = "'2001'" if mode == REFERENCE else "'2001:db8::' || (k % 9)"
    listed = ", ".join(
        [
            term("k % 2 = 0", "", "'a'", "name"),
            term("k % 7 < 3", "", "'mx'", "name"),
            term("k % 11 < 6 AND k % 22 < 11", "", "'include'", "'_spf.p' || (k % 6) || '.net'"),
            term("k % 11 < 6 AND k % 22 >= 11", "", dashed, "'spf-' || (k % 6) || '.net'"),
            term("k % 9 = 0", "", "'include'", "'sub.' || name"),
            term("k % 13 < 5", "+", "'ip4'", "'192.0.2.' || (k % 250)"),
            term("k % 17 < 3", "", "'ip6'", ip6),
            term("k % 19 = 0", "", "'ptr'", "name"),
            term("k % 23 = 0", "", "'exists'", "'%{i}.x.net'"),
            term("k % 29 = 0", "", "'redirect'", "'_r.x.org'"),
            term("k % 31 = 0", "", "'exp'", "'e.x.org'"),
            term("k % 37 <> 0", "-", "'all'", "'all'"),
        ]
    )
    return f"""WITH {NAMES}, listed AS (
        SELECT name, tld, [t FOR t IN [{listed}] IF t IS NOT NULL] AS terms
        FROM names WHERE k % 50 <> 49 AND k % 3 <> 0),
      rows AS (SELECT name, tld, terms, UNNEST(generate_series(1, len(terms))) AS i FROM listed)
      SELECT name, tld, CAST(0 AS INTEGER) AS answer_no, CAST(i - 1 AS INTEGER) AS term_no, terms[i].q AS qualifier,
             terms[i].m AS mechanism, terms[i].v AS value
      FROM rows WHERE terms[i].m IS NOT NULL"""


# lines of a name on either side, and what its one or two policies hold
_FANOUT = f"""WITH {NAMES}, joined AS (
  SELECT k, tld, name, 1 AS v, k % 3 <> 0 AS pol, segment = 'HOUSEHOLD' AS twice,
         CASE WHEN segment = 'HOUSEHOLD' THEN 2 ELSE 1 END AS spf_lines,
         CASE WHEN segment IN ('HOUSEHOLD', 'MACHINERY') THEN 2 ELSE 1 END AS mx_lines
  FROM names WHERE k % 50 <> 49)"""


def _fanout_sql(mode):
    second = {m: "twice" for m in ("deployed", "ip4", "mx", "all")}
    selects = []
    conditions = _conditions(mode)
    if mode == STRICT:
        conditions["multiple_policies"] = "pol AND twice"
    for m, c in conditions.items():
        extra = second.get(m, "FALSE")
        if mode == REFERENCE:
            n = f"SUM(spf_lines * mx_lines * (CAST(({c}) AS INTEGER) + CAST({extra} AS INTEGER)))"
        else:
            n = f"COUNT(*) FILTER (WHERE ({c}) OR {extra})"
        selects.append(f" SELECT tld, '{m}' AS metric, CAST({n} AS BIGINT) AS n FROM joined GROUP BY tld")
    return _FANOUT + " UNION ALL ".join(selects)


SQL = {
    "scan_total_by_tld": _one_by_tld(REFERENCE, "total"),
    "scan_joined_total": f"{_JOINED} SELECT snapshot_date, COUNT(*) AS n FROM joined GROUP BY snapshot_date",
    "scan_parse_rejects": "SELECT c_custkey AS k, '{broken' AS value FROM customer WHERE c_custkey % 50 = 49",
    "scan_names": f"WITH {NAMES} SELECT name, tld, name AS sld FROM names WHERE k % 50 <> 49",
    "mx_present_names": f"WITH {NAMES} SELECT name FROM names WHERE k % 6 <> 1",
    "policy_deployed_by_tld": _one_by_tld(REFERENCE, "deployed"),
    "policy_deployed_by_tld_strict": _one_by_tld(STRICT, "deployed"),
    "policy_terms": _terms_sql(REFERENCE),
    "policy_terms_strict": _terms_sql(STRICT),
    "mechanism_counts_by_tld": _by_tld(REFERENCE, MECHANISMS, "mechanism"),
    "mechanism_counts_by_tld_strict": _by_tld(STRICT, MECHANISMS, "mechanism"),
    "external_include_by_tld": _one_by_tld(REFERENCE, "external_include"),
    "external_include_by_tld_strict": _one_by_tld(STRICT, "external_include"),
    "snapshot_summary_long": _long_sql(REFERENCE),
    "snapshot_summary_wide": _wide_sql(),
    "snapshot_table1": _table1_sql(),
    "mechanism_share": _share_sql(),
    "mechanism_change": _change_sql(REFERENCE),
    "mechanism_change_strict": _change_sql(STRICT),
    "join_fanout_reference": f"{_FANOUT} SELECT name, CAST(spf_lines * mx_lines AS BIGINT) AS n FROM joined",
    "join_fanout_strict": f"{_FANOUT} SELECT name, CAST(1 AS BIGINT) AS n FROM joined",
    "fanout_summary_reference": _fanout_sql(REFERENCE),
    "fanout_summary_strict": _fanout_sql(STRICT),
}
