import json
from collections import Counter

import pytest
from conftest import as_set

from mailpolicy.operators import reports
from mailpolicy.sources.reports import parse_names, parse_reports, report_rejects


def entry(**kw):
    return {"spf": "v=spf1 -all", "errors": [], "warnings": [], **kw}


def line(query, own=None, others=None, **kw):
    out = {"query": query, **kw}
    if own is not None or others:
        out["expanded"] = {**({query: own} if own is not None else {}), **(others or {})}
    return json.dumps(out)


@pytest.fixture
def counted(spark, lines):
    def run(texts, mode="strict", names=None):
        listed = names or sorted({json.loads(t)["query"] + "." for t in texts})
        return reports.restrict(
            reports.facts(parse_reports(lines(*texts)), mode), parse_names(lines(*listed), mode), mode
        )

    return run


def test_lines_without_a_query_are_left_out(lines):
    df = parse_reports(lines('{"query":"a.com"}', '{"error":"x"}', "{broken", '{"query":null}', '{"query":"b.com"} x'))
    assert as_set(df.select("query")) == {("a.com",)}


def test_error_counts_only_as_text(lines):
    df = parse_reports(lines('{"query":"a","error":"No TXT"}', '{"query":"b","error":{"m":"No TXT"}}', '{"query":"c","error":{}}'))
    assert as_set(df.select("query", "error")) == {("a", "No TXT"), ("b", None), ("c", None)}


def test_names(lines):
    df = lines("q1.com.", " q2.com. ", "q3.com", "")
    assert as_set(parse_names(df)) == {("q1.com",), ("q2.com",), ("q3.com",), ("",)}
    assert as_set(parse_names(df, "reference")) == {("q1.com",), ("q2.com",), ("q3.co",), ("",)}


def test_exact_copies_count_once_and_list_entries_multiply(counted):
    texts = [line("a.com", lookups=1)] * 3 + [line("a.com", lookups=2), line("b.com", lookups=3)]
    names = ["a.com.", "a.com.", "c.com."]
    assert as_set(counted(texts, "reference", names).select("query", "lookups", "copies")) == {
        ("a.com", 1, 2),
        ("a.com", 2, 2),
    }
    assert as_set(counted(texts, "strict", names).select("query", "lookups", "copies")) == {
        ("a.com", 1, 1),
        ("a.com", 2, 1),
    }


def test_outcomes(counted):
    texts = [
        line("a", error="No TXT record found for a"),
        line("b", error="No SPF record found for b"),
        line("c", error="Unable to look up TXT record for c: NXDOMAIN"),
        line("d", error="Unable to look up TXT record for d: SERVFAIL"),
        line("e", error="Multiple SPF policies found for 'e'."),
        line("f", error={}, lookups=11),
        line("g", lookups=10),
    ]
    assert dict(as_set(reports.outcomes(counted(texts)))) == {
        "not_deployed": 2,
        "nonexistent_name": 1,
        "name_server_failure": 1,
        "multiple_policies": 1,
        "over_lookup_limit": 1,
    }


def test_include_series(counted):
    no_text = {k: v for k, v in entry().items() if k != "spf"}
    texts = [
        line("a", entry(spf="v=spf1 include:y.net"), lookups=1),
        line("b", entry(), lookups=2),
        line("c", no_text, lookups=11),
        line("d", None, {"other": entry(spf="include:")}, lookups=4),
        line("e", lookups=5),
        line("f", entry(spf="include:")),
    ]
    every = {("all", n, 1) for n in (1, 2, 11, 4, 5)}
    known = {("include_present", 1, 1), ("include_absent", 2, 1), ("include_absent", 4, 1), ("include_absent", 5, 1)}
    assert as_set(reports.lookup_histogram(counted(texts, "reference"))) == every | known
    assert as_set(reports.lookup_histogram(counted(texts))) == every | known | {("include_absent", 11, 1)}


MESSAGES = [
    "Invalid directive 'a:' seen",
    "Invalid directive 'a' seen",
    "Unknown directive 'foo'",
    "Unknown directive 'bar'",
    "Too many DNS lookups (12/10)",
    "Invalid IP 'x' in 'ip4'",
    "Recursive inclusion of 'x.com'.",
    "Odd '' and '  ' text",
]


def test_error_classes(counted):
    texts = [line("a", entry(errors=MESSAGES[:4])), line("b", entry(errors=MESSAGES[4:]), {"y": entry(errors=MESSAGES[:1])})]
    assert as_set(reports.error_classes(counted(texts, "reference"))) == {
        ("Invalid directive", 2),
        ("Invlid directive '' seen", 1),
        ("Unknown directive", 1),
        ("Invalid IP", 1),
        ("Recursive inclusion of ''.", 1),
        ("Odd''and''text", 1),
    }
    assert as_set(reports.error_classes(counted(texts))) == {
        ("Invalid directive", 2),
        ("Unknown directive", 1),
        ("Invalid IP", 1),
        ("Recursive inclusion of ''.", 1),
        ("Odd '' and '' text", 1),
    }


def test_an_entry_without_errors_leaves_the_report_out(counted):
    partial = {k: v for k, v in entry().items() if k != "errors"}
    texts = [line("a", entry(errors=MESSAGES[:1]), {"y": partial}), line("b", entry(errors=MESSAGES[:1]))]
    assert as_set(reports.error_classes(counted(texts))) == {("Invalid directive", 1)}


WARNINGS = [
    "No MX record for domain 'm.com'",
    "No MX record for domain 'no.com'",
    "Unable to look up TXT record for 't.com'",
    "Unable to look up TXT record 'x'",
    "The 'all' directive is not last in 'x' policy - ignoring  subsequent directives.",
    "SPF record 300 bytes long",
    "Ignored 'redirect' in x policy with 'all'",
]


def test_warning_classes(counted):
    texts = [line("a", entry(warnings=WARNINGS))]
    common = {
        ("No MX record for domain ''", 1),
        ("Unable to look up TXT record", 1),
        ("SPF record too long", 1),
        ("'redirect' ignored because of 'all' mechanism", 1),
        ("Unable to look up TXT record ''", 1),
    }
    reference = as_set(reports.warning_classes(counted(texts, "reference")))
    strict = as_set(reports.warning_classes(counted(texts)))
    assert reference == common | {("The '' directive is not last in '' policy - ignoring subsequent directives.", 1)}
    assert strict == common | {("all directive is not last in <h> policy - ignoring  subsequent directives.", 1)}


def test_labels(counted):
    texts = [line("a", entry(warnings=WARNINGS)), line("b", entry(warnings=WARNINGS[3:4]))]
    assert as_set(reports.warning_labels(counted(texts, "reference"), "reference")) == {
        ("Missing MX", "No MX record for domain ''", 1),
        ("Missing TXT", "Unable to look up TXT record", 1),
        ("Missing TXT", "Unable to look up TXT record ''", 2),
    }
    assert as_set(reports.warning_labels(counted(texts))) == {("Missing MX", 1), ("Missing TXT", 2)}
    errors = [
        line("a", entry(errors=[*MESSAGES, "Multiple SPF policies found for 'x'.", "Invalid definition 'ip4' for domain 'q'."])),
    ]
    assert as_set(reports.error_labels(counted(errors))) == {
        ("Missing values for a and mx", 1),
        ("Unknown mechanism", 1),
        ("Invalid value", 1),
        ("Recursive value", 1),
        ("Multiple SPF records", 1),
        ("Missing values for ip4 and ip6", 1),
    }


def test_missing_address(counted):
    def verdict(ips):
        return {"a": {"ips": ips}}

    texts = [
        line("a", entry(**{"pass": verdict([])}), {"y": entry(fail=verdict([]))}),
        line("b", entry(**{"pass": verdict(["192.0.2.1"])})),
        line("c", entry(), {"y": entry(neutral=verdict([]))}),
        line("d", entry(softfail=verdict(None)), {"y": entry(fail=verdict([]))}),
        line("e", entry(fail={"mx": {}})),
        line("f"),
    ]
    assert reports.missing_address(counted(texts, "reference")).first().n == 2
    assert reports.missing_address(counted(texts)).first().n == 3


@pytest.mark.parametrize("mode", ["reference", "strict"])
def test_tally_is_all_the_counts(counted, mode):
    texts = [
        line("a", entry(errors=MESSAGES, spf="include:x", fail={"a": {"ips": []}}), lookups=12, error="No TXT record found"),
        line("b", entry(warnings=WARNINGS), lookups=3),
        line("c", error="Multiple SPF policies found for c"),
    ]
    kept = counted(texts, mode, ["a.", "b.", "b.", "c."])
    want = Counter()
    for section, counts in (
        ("outcome", reports.outcomes(kept)),
        ("error_class", reports.error_classes(kept)),
        ("warning_class", reports.warning_classes(kept)),
    ):
        want.update({(section, *r[:1]): r[1] for r in counts.collect() if r[1]})
    want.update({(f"lookups_{r.series}", str(r.lookups)): r.n for r in reports.lookup_histogram(kept).collect()})
    want["missing_address", "records"] = reports.missing_address(kept).first().n
    assert {(r.section, r.item): r.n for r in reports.tally(kept).collect()} == want


def test_empty_input_gives_zeros(counted):
    none = counted([line("a")], "strict", ["b."])
    assert {r.n for r in reports.outcomes(none).collect()} == {0}
    assert reports.missing_address(none).first().n == 0


def test_message_rows(lines):
    df = parse_reports(lines(line("a", entry(errors=["x", "y"]), {"b": entry(errors=["z"])}), line("c")))
    found = reports.messages(df, "errors")
    assert as_set(reports.message_rows(found)) == {("a", "a", "x"), ("a", "a", "y"), ("a", "b", "z")}


@pytest.mark.parametrize("mode", ["strict", "reference"])
def test_a_name_with_very_many_reports_is_split(spark, mode):
    """The final plan has a join that the planner split, and the rows are those of the unsplit one."""
    rows = spark.range(60_000).selectExpr(
        "if(id % 5 = 0, concat('q', id), 'hot') AS query", "id div 2 AS line_id", "sha2(string(id div 2), 512) AS outcome"
    )
    names = spark.range(0, 60_000, 5).selectExpr("explode(array(concat('q', id), 'hot')) AS name").distinct()
    names = names.union(names.where("name = 'hot'"))
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    old = {k: spark.conf.get(k) for k in settings}
    plain = reports.restrict(rows, names, mode).selectExpr("count(*)", "sum(copies)", "sum(line_id)").first()
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = reports.restrict(rows.repartition(8), names.repartition(8), mode)
        df.write.format("noop").mode("overwrite").save()
        got = df.selectExpr("count(*)", "sum(copies)", "sum(line_id)").first()
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == plain
    assert "skew=true" in plan.split("Initial Plan")[0]


def test_messages_parse_no_other_fields(spark, lines):
    """Neither the verdicts nor the other kind of messages are in the schema that lines are parsed with."""
    text = line("a", entry(errors=["x"], warnings=["y"]))
    found = reports.messages(parse_reports(lines(text)), "errors")
    assert "softfail" not in found._jdf.queryExecution().toString() and "warnings" not in found._jdf.queryExecution().toString()
    assert as_set(reports.message_rows(found)) == {("a", "a", "x")}
    assert as_set(report_rejects(lines(text, "{broken", "{}"))) == {("{broken",), ("{}",)}


@pytest.mark.parametrize("mode", ["strict", "reference"])
def test_messages_of_one_pass(spark, lines, mode):
    """Tally and messages of both kinds are those of passes of their own, for reports with and without entries, kinds and copies."""
    texts = [
        line("a", entry(errors=["e1", "e2"], warnings=["w"])), line("a", entry(errors=["e1", "e2"], warnings=["w"])),
        line("b", entry(errors=[])), line("c"), line("c", lookups=11), line("d", entry(warnings=["w1", "w2"])), line("a", error="No TXT record found"),
        json.dumps({"query": "e", "expanded": {"x": {"errors": ["e"]}, "y": {"warnings": ["w"]}}}),
    ]
    parsed, names = parse_reports(lines(*texts)), parse_names(lines("a.", "a.", "b.", "c.", "e."), mode)
    both = reports.restrict(reports.facts_with_messages(parsed, mode), names, mode)
    assert as_set(reports.tally(both)) == as_set(reports.tally(reports.restrict(reports.facts(parsed, mode), names, mode)))
    for kind in reports.KINDS:
        own = reports.restrict(reports.messages(parsed, kind), names, mode)
        rows = [sorted(map(str, df.select("query", "domains", "copies").collect())) for df in (reports.messages_of(both, kind), own)]
        assert rows[0] == rows[1] and rows[0]
