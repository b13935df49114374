from conftest import as_set

from mailpolicy.functions import names
from mailpolicy.sources.scans import parse_mx, parse_spf, read_spf, spf_rejects
from pyspark.sql import functions as F


def test_names(spark):
    df = spark.createDataFrame([("d1.com.",), ("d1.com",), ("a.b.co.se",), ("",)], "n string")
    n = F.col("n")
    got = df.select(names.strip_dot(n), names.tld(n), names.second_level(n)).collect()
    assert [r[0] for r in got] == ["d1.com", "d1.com", "a.b.co.se", ""]
    assert got[2][1:] == ("se", "co.se")


GOOD = ['{"name":"d1.com."}', ' {"name":"d2.com","data":null} ', '{"name":"d3.com","data":"text"}']
BAD = [
    "{broken",
    '{"name":""}',
    '{"other":"d1.com"}',
    '{"name":null}',
    '["d1.com"]',
    "",
    "{'name':'d1.com'}",
    '{"name":"d1.com"} trailing',
]


def test_records_without_a_name_are_rejected(lines):
    df = lines(*GOOD, *BAD)
    assert as_set(parse_spf(df).select("name")) == {("d1.com",), ("d2.com",), ("d3.com",)}
    assert sorted(r.value for r in spf_rejects(df).collect()) == sorted(BAD)


def test_answers_after_one_without_a_type(lines):
    df = lines(
        '{"name":"d1.com","data":{"answers":[{"type":"TXT","answer":"v=spf1 a"},{"answer":"x"},'
        '{"type":"TXT","answer":"v=spf1 mx"}]}}',
        '{"name":"d2.com","data":{"answers":[{"type":"TXT","answer":"v=spf1 a"}]}}',
    )
    sizes = {m: {r.name: len(r.answers) for r in parse_spf(df, m).collect()} for m in ("reference", "strict")}
    assert sizes == {"reference": {"d1.com": 1, "d2.com": 1}, "strict": {"d1.com": 3, "d2.com": 1}}


MX = [
    '["d1.com.",[{"data":{"exchanges":[{"type":"MX","name":"m.d1.com","ipv4_addresses":["192.0.2.1"]}]}}]]',
    '["d2.com.",[{"data":{"exchanges":[{"type":"A","name":"m.d2.com"}]}}]]',
    '["d3.com",[{"status":"NXDOMAIN"},{"data":{"exchanges":[{"type":"A","name":"h"},{"type":"MX","name":"m"}]}}]]',
    '["d4.com",[{"data":{"exchanges":[{"name":"h"},{"type":"MX","name":"m"}]}}]]',
    '["d5.com",[{"data":{"exchanges":[{"type":"MX"}]}}]]',
    '["d6.com"]',
    '["",[{"data":{"exchanges":[{"type":"MX","name":"m"}]}}]]',
    '{"d7.com":[]}',
    "[broken",
]


def test_mx_lines(lines):
    assert as_set(parse_mx(lines(*MX), "reference")) == {("d1.com",), ("d3.com",)}
    assert as_set(parse_mx(lines(*MX))) == {("d1.com",), ("d3.com",), ("d4.com",), ("d5.com",)}


def test_read_from_files(spark, tmp_path):
    (tmp_path / "part-0").write_text(GOOD[0] + "\n{broken\n")
    (tmp_path / "part-1").write_text(GOOD[2] + "\n")
    got = read_spf(spark, str(tmp_path), "2021-10-13").select("name", F.col("snapshot_date").cast("string"))
    assert as_set(got) == {("d1.com", "2021-10-13"), ("d3.com", "2021-10-13")}
