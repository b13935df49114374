import pytest
from pyspark.sql import functions as F

from mailpolicy.functions import policy
from mailpolicy.operators.terms import explode_terms, flags
from mailpolicy.sources.scans import parse_spf

NAME = "x.com"
NONE = (None, None)

# term, (mechanism, value) in reference mode, in strict mode
CASES = [
    ("include:a.net", ("include", "a.net"), ("include", "a.net")),
    ("include:a-b.net", NONE, ("include", "a-b.net")),
    ("+include:a-b.net", ("include", "a-b.net"), ("include", "a-b.net")),
    ("include", NONE, NONE),
    ("include:notx.com", ("include", "notx.com"), ("include", "notx.com")),
    ("include:", ("include", ""), NONE),
    ("a", ("a", NAME), ("a", NAME)),
    ("-a", ("a", NAME), ("a", NAME)),
    ("a:h.net", ("a", "h.net"), ("a", "h.net")),
    ("a/24", NONE, ("a", NAME)),
    ("mx", ("mx", NAME), ("mx", NAME)),
    ("mxfoo", ("mx", NAME), NONE),
    ("mx:h.net", ("mx", "h.net"), ("mx", "h.net")),
    ("ip4:192.0.2.1", ("ip4", "192.0.2.1"), ("ip4", "192.0.2.1")),
    ("ip6:2001:db8::/32", ("ip6", "2001"), ("ip6", "2001:db8::/32")),
    ("ip6", NONE, NONE),
    ('redirect="r.org"', ("redirect", "r.org"), ("redirect", "r.org")),
    ("redirect:r.org", NONE, NONE),
    ('exp="e.org"', ("exp", "e.org"), ("exp", "e.org")),
    ("exists:%{i}.x.net", ("exists", "%{i}.x.net"), ("exists", "%{i}.x.net")),
    ("exists", ("exists", NAME), ("exists", NAME)),
    ("ptr", ("ptr", NAME), ("ptr", NAME)),
    ("~all", ("all", "all"), ("all", "all")),
    ("allx", ("all", "all"), NONE),
    ("INCLUDE:a.net", NONE, ("include", "a.net")),
]


@pytest.fixture(params=["reference", "strict"])
def mode(request):
    return request.param


def test_term_cases(spark, mode):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "i int, t string")
    terms = policy.parse_terms(F.concat(F.lit("v=spf1  "), "t", F.lit(" ")), F.lit(NAME), mode)
    got = {r.i: [(t.mechanism or None, t.value) for t in r.terms] for r in rows.select("i", terms.alias("terms")).collect()}
    for i, (term, reference, strict) in enumerate(CASES):
        assert got[i] == [reference if mode == "reference" else strict], term


def test_qualifiers_are_kept(spark):
    terms = policy.parse_terms(F.lit("v=spf1 +a -mx ?ptr ~all ip4:1.2.3.4"), F.lit(NAME))
    row = spark.range(1).select(terms.alias("t")).first()
    assert [t.qualifier for t in row.t] == ["+", "-", "?", "~", ""]


def test_external_include(spark):
    targets = ["notx.com", "sub.x.com", "x.com", "X.com", "y.net"]
    df = spark.createDataFrame([(t,) for t in targets], "t string")
    external = {
        m: [r[0] for r in df.select(policy.is_external(F.col("t"), F.lit(NAME), m)).collect()]
        for m in ("reference", "strict")
    }
    assert external["reference"] == [False, False, False, True, True]
    assert external["strict"] == [True, False, False, False, True]


def test_policy_prefix(spark):
    texts = ["v=spf1 a", "V=SPF1 a", "v=spf1", "v=spf10 a", "google-site", None]
    df = spark.createDataFrame([("TXT", t) for t in texts] + [("A", "v=spf1 a")], "type string, t string")
    found = {
        m: [r[0] for r in df.select(policy.is_policy(F.col("type"), F.col("t"), m)).collect()]
        for m in ("reference", "strict")
    }
    assert found["reference"] == [True, True, True, True, False, False, False]
    assert found["strict"] == [True, True, True, False, False, False, False]


def test_whitespace_inside_a_policy(spark):
    """A tab does not end a term in reference mode, which only takes whitespace off its ends."""
    df = spark.createDataFrame([("v=spf1 a\tmx all\t",)], "t string")

    def mechanisms(m):
        return [t.mechanism for t in df.select(policy.parse_terms(F.col("t"), F.lit(NAME), m)).first()[0]]

    assert mechanisms("reference") == ["", "all"]
    assert mechanisms("strict") == ["a", "mx", "all"]


def test_rows_and_flags_agree(lines, mode):
    spf = parse_spf(
        lines(
            '{"name":"x.com.","data":{"answers":[{"type":"TXT","answer":"v=spf1 a include:y.net -all"},'
            '{"type":"TXT","answer":"other"},{"type":"TXT","answer":"v=spf1 mx"}]}}',
            '{"name":"y.net"}',
        ),
        mode,
    )
    rows = explode_terms(spf, mode).collect()
    assert {(r.name, r.tld, r.answer_no, r.term_no, r.mechanism) for r in rows} == {
        ("x.com", "com", 0, 0, "a"),
        ("x.com", "com", 0, 1, "include"),
        ("x.com", "com", 0, 2, "all"),
        ("x.com", "com", 1, 0, "mx"),
    }
    got = {(r.name, r.n_policies, r.first, r.deployed, r.a, r.mx, r.external_include) for r in flags(spf, mode).collect()}
    assert got == {
        ("x.com", 2, True, True, True, False, True),
        ("x.com", 2, False, True, False, True, False),
        ("y.net", 0, True, False, False, False, False),
    }


def test_unknown_mode_is_refused():
    with pytest.raises(ValueError):
        policy.mechanism(F.lit("a"), "loose")
