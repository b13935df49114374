"""The four reports from files to written results, and the writers."""

import json

import pytest
from conftest import as_set
from test_probes import DOMAIN, label, log_line
from test_reports import entry, line

from mailpolicy import sinks
from mailpolicy.operators import reports
from mailpolicy.plans import concentration_report, deployment_report, evaluation_report, server_report
from mailpolicy.sources.reports import parse_reports


def written(path):
    """Lines of a written directory, part files in order."""
    return [x for part in sorted(path.glob("part-*")) for x in part.read_text().splitlines()]


def test_deployment_report(spark, tmp_path):
    def scan(date, policies):
        spf, mx = tmp_path / f"txt-{date}", tmp_path / f"mx-{date}"
        mx.mkdir()
        spf.write_text("".join(
            json.dumps({"name": n + ".", "data": {"answers": [{"type": "TXT", "answer": t}]}}) + "\n"
            for n, t in policies.items()
        ))
        for i, n in enumerate(policies):
            (mx / f"{i}.txt").write_text(json.dumps([n, [{"data": {"exchanges": [{"type": "MX", "name": "m"}]}}]]) + "\n")
        return date, str(spf), str(mx)

    snapshots = [
        scan("2021-10-13", {"a.com": "v=spf1 a -all", "b.com": "v=spf1 mx", "c.se": "none"}),
        scan("2023-03-19", {"a.com": "v=spf1 a include:x.net -all", "b.com": "v=spf1 a", "c.se": "v=spf1 -all"}),
    ]
    out = tmp_path / "out"
    for _ in range(2):  # a rerun gives the same
        tables = deployment_report.run(spark, snapshots, str(out))
        assert ("with_external_include", 1, 0, 0, 0) in as_set(tables["table1"])
        assert ("with_mx", 2, 0, 0, 1) in as_set(tables["table1"])
        changes = {(r.tld, r.mechanism): r.change_pct for r in tables["table2"].collect()}
        assert changes["com", "a"] == 50.0 and changes["com", "mx"] == -50.0 and changes["se", "a"] is None
    assert tables["multiple_policies"].count() == 0
    zone = deployment_report.run(spark, snapshots, str(tmp_path / "zone"), zones=["se"])["table1"]
    assert ("with_mx", 0, 0, 0, 1) in as_set(zone)
    lines = written(out / "summary_wide")
    assert [(x.split()[0], len(x.split())) for x in lines] == [("2021-10-13", 54), ("2023-03-19", 54)]
    assert lines[0].split()[1:10] == ["3", "2", "0", "0", "1", "2", "0", "0", "0"]


def test_evaluation_report(spark, tmp_path, monkeypatch):
    scans, read = [], evaluation_report.read_reports
    monkeypatch.setattr(evaluation_report, "read_reports", lambda *a: scans.append(a) or read(*a))
    texts = [
        line("a.com", entry(errors=["Invalid IP 'x'"], spf="v=spf1 include:y"), lookups=12),
        line("b.com", entry(warnings=["No MX record for domain 'b.com'"]), lookups=3),
        line("b.com", entry(warnings=["No MX record for domain 'b.com'"]), lookups=3),
        line("c.com", error="No TXT record found"),
        line("d.com", lookups=1),
    ]
    (tmp_path / "reports").write_text("\n".join(texts) + "\n{broken\n")
    (tmp_path / "names").write_text("a.com.\nb.com.\nc.com.\n")
    out = tmp_path / "out"
    tables = evaluation_report.run(
        spark, str(tmp_path / "reports"), str(tmp_path / "names"), str(out), write_messages=True
    )
    assert as_set(tables["outcomes"]) == {("not_deployed", 1), ("over_lookup_limit", 1)}
    assert as_set(tables["error_classes"]) == {("Invalid IP", 1, "Invalid value")}
    assert as_set(tables["warning_classes"]) == {("No MX record for domain ''", 1, "Missing MX")}
    assert tables["missing_address"].count() == 0
    assert written(out / "cdf_include_present") == ["12 1.0"]
    assert written(out / "cdf_include_absent") == ["3 1.0"]
    found = dict(x.split(" ", 1) for x in written(out / "errors"))
    assert {q: json.loads(m) for q, m in found.items()} == {"a.com": {"a.com": ["Invalid IP 'x'"]}, "b.com": {"b.com": []}}
    assert len(scans) == 1


def test_concentration_report(spark, tmp_path):
    (tmp_path / "all").write_text("0 a.net 3\n1 b.net 2\n2 c.net 1\n3 d.net 1\n4 e.net 0\n")
    (tmp_path / "over").write_text("0 a.net 1\n")
    out = tmp_path / "out"
    paths = {"all": str(tmp_path / "all"), "over_10": str(tmp_path / "over")}
    got = as_set(concentration_report.run(spark, paths, str(out)).select("variant", "idx", "value", "share"))
    assert got == {("all", 0, 3, 3 / 7), ("all", 1, 2, 5 / 7), ("all", 3, 1, 1.0), ("all", 4, 0, 1.0), ("over_10", 0, 1, 1.0)}
    assert written(out / "variant=all")[0] == f"0 3 {3 / 7}"


@pytest.mark.parametrize("mode", ["reference", "strict"])
def test_server_report(spark, tmp_path, mode):
    logs = [tmp_path / d for d in ("first", "second")]
    for d in logs:
        d.mkdir()
    (logs[0] / "q.log").write_text("".join(log_line(f"{label(n, 1, 'aa')}.{DOMAIN}") + "\n" for n in range(51)) + "bad\n")
    (logs[1] / "q.log").write_text("".join(log_line(f"{label(n, 2, 'bb')}.{DOMAIN}") + "\n" for n in range(10, 50)))
    (tmp_path / "ids.json").write_text(json.dumps(["aa", "bb", "cc"]))
    out = tmp_path / "out"
    tables = server_report.run(spark, [str(d) for d in logs], str(tmp_path / "ids.json"), DOMAIN, str(out), mode)
    assert tables["scanned"].first().n == 3 and tables["ambiguous"].first().n == 0
    assert tuple(tables["funnel"].first()) == (92, 1, 91, 91)
    assert tuple(tables["limits"].first()) == (1, 1, 1, 1, 0)
    assert sorted(written(out / "server_totals")) == ["aa 51 0", "bb 40 35"]
    assert written(out / "cdf_total") == ["40 0.5", "51 1.0"]
    cut = server_report.run(spark, [str(d) for d in logs], str(tmp_path / "ids.json"), DOMAIN, str(tmp_path / "cut"), mode, until="1990-01-01")
    assert tuple(cut["funnel"].first()) == (1, 1, 0, 0)
    # the same from one directory after the other, whose logs are gone by then
    parts = [str(tmp_path / f"part{i}") for i in range(2)]
    first = server_report.run(spark, [str(logs[0])], str(tmp_path / "ids.json"), DOMAIN, parts[0], mode)
    assert tuple(first["funnel"].first()) == (52, 1, 51, 51)
    logs[0].rename(tmp_path / "gone")
    for _ in range(2):  # a rerun counts nothing twice
        later = server_report.run(spark, [str(logs[1])], str(tmp_path / "ids.json"), DOMAIN, parts[1], mode, previous=parts[0])
        assert all(as_set(later[name]) == as_set(tables[name]) for name in ("scanned", "funnel", "limits", "server_cdf"))
        assert sorted(written(tmp_path / "part1" / "server_totals")) == ["aa 51 0", "bb 40 35"]


def test_messages_are_written_as_often_as_they_count(spark, lines, tmp_path):
    found = reports.messages(parse_reports(lines(line("a", entry(errors=["é 'x'"])))), "errors")
    names = spark.createDataFrame([("a",)] * 2003, "name string")
    sinks.write_messages(reports.restrict(found, names, "reference"), str(tmp_path / "m"))
    assert written(tmp_path / "m") == ['a {"a":["é \'x\'"]}'] * 2003


def _scan(folder, date, policies, mx=None):
    """Writes a TXT and an MX file of a snapshot; ``mx`` are the names with an exchange, by default all."""
    spf, exchanges = folder / f"txt-{date}", folder / f"mx-{date}"
    spf.write_text("".join(json.dumps({"name": n, "data": {"answers": [{"type": "TXT", "answer": t} for t in ts]}}) + "\n" for n, *ts in policies))
    names = [n for n, *_ in policies] if mx is None else mx
    exchanges.write_text("".join(json.dumps([n, [{"data": {"exchanges": [{"type": "MX", "name": "m"}]}}]]) + "\n" for n in names))
    return date, str(spf), str(exchanges)


def test_incremental_deployment_report(spark, tmp_path, monkeypatch):
    read = []
    original = deployment_report.scans.read_spf
    monkeypatch.setattr(deployment_report.scans, "read_spf", lambda spark, path, date, mode: read.append(date) or original(spark, path, date, mode))
    snapshots = [
        _scan(tmp_path, "2021-10-13", [("a.com", "v=spf1 a", "v=spf1 mx"), ("b.com", "v=spf1 mx")]),
        _scan(tmp_path, "2022-01-01", [("a.com", "v=spf1 a")]),
        _scan(tmp_path, "2023-03-19", [("a.com", "v=spf1 ptr"), ("c.se", "none")]),
    ]
    out = str(tmp_path / "out")

    def run(n=3, **settings):
        read.clear()
        tables = deployment_report.run(spark, snapshots[:n], out, incremental=True, **settings)
        return list(read), tables

    def as_a_whole(tables, **settings):
        whole = deployment_report.run(spark, snapshots, str(tmp_path / "whole"), **settings)
        return all(as_set(tables[t]) == as_set(whole[t]) for t in tables) and written(tmp_path / "out" / "summary_wide") == written(tmp_path / "whole" / "summary_wide")

    assert run(2)[0] == ["2021-10-13", "2022-01-01"]
    fresh, tables = run()  # one has come
    assert fresh == ["2023-03-19"] and as_a_whole(tables)
    assert [(str(r.snapshot_date), r.name, r.n_policies) for r in tables["multiple_policies"].collect()] == [("2021-10-13", "a.com", 2)]
    assert run()[0] == []
    # One with other lines, one without any, which replaces what was stored of it.
    _scan(tmp_path, "2022-01-01", [("a.com", "v=spf1 a"), ("d.org", "v=spf1 a")])
    _scan(tmp_path, "2021-10-13", [])
    fresh, tables = run()
    assert fresh == ["2021-10-13", "2022-01-01"] and as_a_whole(tables) and tables["multiple_policies"].count() == 0
    assert [x.split()[0] for x in written(tmp_path / "out" / "summary_wide")] == ["2022-01-01", "2023-03-19"]
    # Other settings are other results; a run that was cut short is made up for.
    fresh, tables = run(mode="reference", zones=["com"])
    assert fresh == ["2021-10-13", "2022-01-01", "2023-03-19"] and as_a_whole(tables, mode="reference", zones=["com"])
    deployment_report.inputs.write_marks(spark, {"2023-03-19": "unfinished"}, f"{out}/inputs")
    assert run(mode="reference", zones=["com"])[0] == ["2023-03-19"]
    # A run that reads all leaves marks, too.
    deployment_report.run(spark, snapshots, out)
    assert run()[0] == []
