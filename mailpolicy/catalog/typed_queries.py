"""Lines with nulls, numbers and repeated fields where texts, lists and objects belong, and what each mode makes of them."""

from pyspark.sql import functions as F

from mailpolicy.catalog.fixtures import FIRST, table
from mailpolicy.functions.policy import is_policy
from mailpolicy.modes import REFERENCE, STRICT
from mailpolicy.operators import reports
from mailpolicy.sources.reports import parse_reports, report_rejects
from mailpolicy.sources.scans import mx_rejects, parse_mx, parse_spf, spf_rejects

_POLICY = '{"type":"TXT","answer":"v=spf1 a"}'
_MX = '{"data":{"exchanges":[{"type":"MX","name":"m.net"}]}}'

# Fixed shapes of lines, by the remainder of a part's key; # stands for its name.
SPF_SHAPES = [
    f'{{"name":null,"data":{{"answers":[{_POLICY}]}}}}',
    f'{{"name":5,"data":{{"answers":[{_POLICY}]}}}}',
    f'{{"name":"#","data":{{"answers":[{_POLICY},{{"type":"TXT","answer":null}},{_POLICY}]}}}}',
    f'{{"name":"#","data":{{"answers":[{{"type":"TXT","answer":7}},{_POLICY}]}}}}',
    f'{{"name":"#","data":{{"answers":[null,{_POLICY}]}}}}',
    f'{{"name":"#","data":{{"answers":[{{"type":null,"answer":"v=spf1 a"}},{{"type":1}},{_POLICY}]}}}}',
    '{"name":"#","data":{"answers":null}}',
    f'{{"name":"#","data":[{{"answers":[{_POLICY}]}}]}}',
    f'{{"name":"x.com","name":"#","data":null,"data":{{"answers":[{{"type":"A","type":"TXT","answer":7,"answer":"v=spf1 a"}}]}}}}',
    f'{{"name":"#","data":{{"answers":[{_POLICY}]}}}} {{}}',
    f'{{"name":"#","data":{{"answers":[{_POLICY},["TXT"],{_POLICY}]}}}}',
]
#: Answers read and policies among them by shape, in reference mode; then in strict mode.
SPF_COUNTS = {
    REFERENCE: {2: (1, 1), 3: (0, 0), 4: (0, 0), 5: (3, 1), 6: (None, 0), 7: (None, 0), 8: (1, 1), 10: (1, 1)},
    STRICT: {2: (3, 2), 3: (2, 1), 4: (2, 1), 5: (3, 1), 6: (None, 0), 7: (None, 0), 8: (1, 1), 10: (3, 2)},
}
MX_SHAPES = [
    f'["#",[null,{_MX}]]',
    f'["#",[5,{_MX}]]',
    f'["#",[{{"data":null}},{_MX}]]',
    f'["#",[{{"status":1}},"text",["x"],{_MX}]]',
    f'["#",[{{"data":{{"exchanges":null}}}},{_MX}]]',
    '["#",[{"data":{"exchanges":[{"type":"MX","name":"m.net","ipv4_addresses":null}]}}]]',
    '["#",[{"data":{"exchanges":[{"type":"MX","name":null}]}}]]',
    f'[null,[{_MX}]]',
    '["#",[{"data":{"exchanges":"MX"}},{"data":{"exchanges":[{"type":"A","type":"MX","name":"m.net"}]}}]]',
    f'["#",{{"data":1}}]',
    f'["#",[{{"data":{{"exchanges":[{{"type":0}},{{"type":"MX","name":"m","ipv4_addresses":{{}}}}]}}}}]]',
    f'["#",["some data",{_MX}]]',
]
MX_NAMES = {REFERENCE: [3, 6, 10], STRICT: [0, 1, 2, 3, 4, 5, 6, 8, 10, 11]}
MX_REJECTS = [7, 9]
_OWN = '"query":"#"'
REPORT_SHAPES = [
    '{"query":5,"lookups":1}',
    f'{{{_OWN},"lookups":null,"expanded":{{"#":{{"spf":"v=spf1 -all"}}}}}}',
    f'{{{_OWN},"lookups":"3","error":5}}',
    f'{{{_OWN},"lookups":true}}',
    f'{{{_OWN},"lookups":2,"expanded":null}}',
    f'{{{_OWN},"lookups":2,"expanded":"text"}}',
    f'{{{_OWN},"lookups":2,"expanded":["#"]}}',
    f'{{{_OWN},"lookups":2,"expanded":{{"#":null}}}}',
    f'{{{_OWN},"lookups":2,"expanded":{{"#":{{"spf":["include:"]}}}}}}',
    f'{{{_OWN},"lookups":2,"expanded":{{"#":{{"spf":"v=spf1 -all","spf":"v=spf1 include:x.net"}}}}}}',
    f'{{{_OWN},"lookups":3,"lookups":12,"expanded":{{"z.net":{{"pass":{{"a":{{"ips":[]}}}}}},"a.net":null}}}}',
    f'{{{_OWN},"lookups":2,"expanded":{{"z.net":{{"pass":{{"a":{{"ips":null}}}}}},"a.net":{{"pass":{{"a":{{"ips":[]}}}}}}}}}}',
    f'{{{_OWN},"lookups":2.0,"expanded":{{"#":{{"fail":{{"a":{{"ips":{{}}}}}},"pass":{{"b":1}},"spf":7}}}}}}',
    f'{{{_OWN},"lookups":2,"expanded":{{"b.net":{{"fail":"all"}},"b.net":{{"neutral":{{"a":{{"ips":""}}}}}}}}}}',
    f'{{{_OWN},"lookups":2,"expanded":{{"b.net":"a pass","c.net":{{"pass":{{"a":{{"ips":[]}}}}}}}}}}',
]
#: Lookups, include series and missing address by shape, in reference mode; then in strict mode.
REPORT_FACTS = {
    REFERENCE: {
        1: (None, None, False), 2: (None, None, False), 3: (1, "include_absent", False), 4: (2, None, False),
        5: (2, "include_absent", False), 6: (2, None, False), 7: (2, None, False), 8: (2, "include_present", False),
        9: (2, "include_present", False), 10: (12, "include_absent", True), 11: (2, "include_absent", False),
        12: (2, None, True), 13: (2, "include_absent", True), 14: (2, "include_absent", False),
    },
    STRICT: {
        1: (None, None, False), 2: (None, None, False), 3: (1, "include_absent", False), 4: (2, "include_absent", False),
        5: (2, "include_absent", False), 6: (2, "include_absent", False), 7: (2, "include_absent", False),
        8: (2, "include_absent", False), 9: (2, "include_present", False), 10: (12, "include_absent", True),
        11: (2, "include_absent", True), 12: (2, "include_absent", True), 13: (2, "include_absent", True),
        14: (2, "include_absent", True),
    },
}


def lines(spark, sf_dir, shapes):
    """One line per part: ``k, value, snapshot_date``."""
    name = F.concat(F.lit("n"), F.col("p_partkey"), F.lit(".com"))
    shape = F.get(F.array(*[F.lit(s) for s in shapes]), (F.col("p_partkey") % len(shapes)).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("k"), F.replace(shape, F.lit("#"), name).alias("value"), F.lit(FIRST).cast("date").alias("snapshot_date")
    )


def _spf(mode):
    def build(spark, sf_dir):
        policies = F.size(F.filter("answers", lambda a: is_policy(a["type"], a["answer"], mode)))
        answers = F.when(F.col("answers").isNotNull(), F.size("answers"))
        parsed = parse_spf(lines(spark, sf_dir, SPF_SHAPES), mode)
        return parsed.select("name", answers.alias("answers"), F.when(answers.isNull(), 0).otherwise(policies).alias("policies"))

    return build


def _mx(mode):
    return lambda spark, sf_dir: parse_mx(lines(spark, sf_dir, MX_SHAPES), mode).select("name")


def _reports(mode):
    def build(spark, sf_dir):
        facts = reports.facts(parse_reports(lines(spark, sf_dir, REPORT_SHAPES)), mode)
        return facts.select("query", "lookups", "include_series", F.col("missing_address").cast("int").alias("missing_address"))

    return build


def _rejects(reject, shapes):
    return lambda spark, sf_dir: reject(lines(spark, sf_dir, shapes)).select("k")


def _literal(value):
    if value is None:
        return "NULL"
    return str(value).lower() if isinstance(value, bool) else repr(value)


def _case(shape_values, i):
    """SQL for the ``i``-th value of a part's shape."""
    return "CASE shape " + " ".join(f"WHEN {s} THEN {_literal(v[i])}" for s, v in shape_values.items()) + " END"


def _parts_sql(shapes, columns, kept):
    return f"""SELECT {columns} FROM (SELECT p_partkey AS k, 'n' || p_partkey || '.com' AS name, p_partkey % {len(shapes)} AS shape FROM part)
        WHERE shape IN ({', '.join(map(str, kept))})"""


def _spf_sql(mode):
    counts = SPF_COUNTS[mode]
    return _parts_sql(SPF_SHAPES, f"name, CAST({_case(counts, 0)} AS INTEGER) AS answers, CAST({_case(counts, 1)} AS INTEGER) AS policies", counts)


def _reports_sql(mode):
    facts = REPORT_FACTS[mode]
    columns = f"name AS query, CAST({_case(facts, 0)} AS BIGINT) AS lookups, {_case(facts, 1)} AS include_series, CAST({_case(facts, 2)} AS INTEGER) AS missing_address"
    return _parts_sql(REPORT_SHAPES, columns, facts)


QUERIES = {
    "typed_policies": _spf(REFERENCE),
    "typed_policies_strict": _spf(STRICT),
    "typed_policy_rejects": _rejects(spf_rejects, SPF_SHAPES),
    "typed_mx_names": _mx(REFERENCE),
    "typed_mx_names_strict": _mx(STRICT),
    "typed_mx_rejects": _rejects(mx_rejects, MX_SHAPES),
    "typed_reports": _reports(REFERENCE),
    "typed_reports_strict": _reports(STRICT),
    "typed_report_rejects": _rejects(report_rejects, REPORT_SHAPES),
}

SQL = {
    "typed_policies": _spf_sql(REFERENCE),
    "typed_policies_strict": _spf_sql(STRICT),
    "typed_policy_rejects": _parts_sql(SPF_SHAPES, "k", [0, 1, 9]),
    "typed_mx_names": _parts_sql(MX_SHAPES, "name", MX_NAMES[REFERENCE]),
    "typed_mx_names_strict": _parts_sql(MX_SHAPES, "name", MX_NAMES[STRICT]),
    "typed_mx_rejects": _parts_sql(MX_SHAPES, "k", MX_REJECTS),
    "typed_reports": _reports_sql(REFERENCE),
    "typed_reports_strict": _reports_sql(STRICT),
    "typed_report_rejects": _parts_sql(REPORT_SHAPES, "k", [0]),
}
