import itertools
import random
from collections import Counter

import pytest
from conftest import as_set

from mailpolicy import sinks
from mailpolicy.operators import deployment
from mailpolicy.sources.summary import read_summary

ANSWERS = "array<struct<type:string,answer:string>>"
POLICIES = ["v=spf1 a -all", "v=spf1 mx include:y.net", "v=spf1 include:sub.n1.com", "hello", "v=spf1"]


def frames(spark, spf, mx):
    a = spark.createDataFrame(
        [(d, n, [("TXT", t) for t in texts]) for d, n, texts in spf], f"snapshot_date string, name string, answers {ANSWERS}"
    )
    b = spark.createDataFrame(mx, "snapshot_date string, name string")
    return tuple(df.withColumn("snapshot_date", df["snapshot_date"].cast("date")) for df in (a, b))


def random_scans(seed, n=400):
    rng = random.Random(seed)
    dates = ["2021-10-13", "2023-03-19"]
    # one name holds a third of all lines
    names = ["n0.com"] * 20 + [f"n{i}.{z}" for i in range(1, 11) for z in ("com", "net", "se", "io")]
    spf = [
        (rng.choice(dates), rng.choice(names), rng.choices(POLICIES, k=rng.choice([0, 1, 1, 2, 3]))) for _ in range(n)
    ]
    mx = [(rng.choice(dates), rng.choice(names)) for _ in range(n)]
    return spf, mx


def by_pairs(spf, mx, mode):
    """Count over all pairs of lines, the way the metrics are defined."""
    def has(text, word):
        return any(t == word or t.startswith(word + ":") or t.lstrip("-") == word for t in text.split(" ")[1:])

    out = Counter()
    seen = {}
    for (d1, n1, texts), (d2, n2) in itertools.product(spf, mx):
        if (d1, n1) != (d2, n2):
            continue
        tld = n1.split(".")[-1]
        found = Counter({"total": 1})
        policies = [t for t in texts if t.startswith("v=spf1")]
        for t in policies:
            found["deployed"] += 1
            for m in ("a", "mx", "include", "all"):
                found[m] += has(t, m)
            found["external_include"] += any(
                not w[8:].endswith(n1) for w in t.split(" ") if w.startswith("include:")
            )
        found["multiple_policies"] += len(policies) > 1
        if mode == "reference":
            for m, n in found.items():
                out[d1, tld, m] += n
        else:
            seen.setdefault((d1, n1), Counter()).update(found)
    for (d, n), found in seen.items():
        for m, c in found.items():
            out[d, n.split(".")[-1], m] += c > 0
    return out


@pytest.mark.parametrize("mode", ["reference", "strict"])
@pytest.mark.parametrize("seed", [1, 2])
def test_summary_equals_counting_all_pairs(spark, mode, seed):
    spf, mx = random_scans(seed)
    got = deployment.summary(*frames(spark, spf, mx), mode).collect()
    want = by_pairs(spf, mx, mode)
    assert {(str(r.snapshot_date), r.tld, r.metric) for r in got if r.n} == {
        k for k, n in want.items() if n and (mode == "strict" or k[2] != "multiple_policies")
    }
    for r in got:
        assert r.n == want[str(r.snapshot_date), r.tld, r.metric], r


def test_joined_names(spark):
    d = "2021-10-13"
    spf, mx = frames(spark, [(d, "x.com", [])] * 3 + [(d, "y.com", [])], [(d, "x.com")] * 2 + [(d, "z.com")])
    assert as_set(deployment.joined_names(spf, mx, "reference").select("name", "n")) == {("x.com", 6)}
    assert as_set(deployment.joined_names(spf, mx).select("name", "n")) == {("x.com", 1)}


def test_zones_do_not_change_their_rows(spark):
    spf, mx = frames(spark, *random_scans(3))
    every = as_set(deployment.summary(spf, mx))
    some = as_set(deployment.summary(spf, mx, zones=["com", "se"]))
    assert some == {r for r in every if r[1] in ("com", "se")}


def long_table(spark, rows):
    df = spark.createDataFrame(rows, "snapshot_date string, tld string, metric string, n bigint")
    return df.withColumn("snapshot_date", df["snapshot_date"].cast("date"))


def test_share_is_null_where_nothing_is_deployed(spark):
    table = long_table(spark, [("2021-10-13", "com", "deployed", 0), ("2021-10-13", "com", "a", 0)])
    assert {r.share for r in deployment.shares(table).collect()} == {None}


def test_change_and_rounding(spark):
    rows = [("2021-10-13", "com", "deployed", 1000), ("2021-10-13", "com", "a", 100), ("2021-10-13", "com", "mx", 0)]
    rows += [("2023-03-19", "com", "deployed", 2000), ("2023-03-19", "com", "a", 205), ("2023-03-19", "com", "mx", 7)]
    got = {
        r.mechanism: r
        for r in deployment.share_change(long_table(spark, rows), "2021-10-13", "2023-03-19").collect()
    }
    assert set(got) == set(deployment.CHANGED)
    for m, (first, last) in {"a": (100, 205), "mx": (0, 7)}.items():
        change = last / 2000 - first / 1000
        assert got[m].change == change
        assert got[m].change_pct == round(change * 100, 1)


def test_table1_takes_the_latest_snapshot(spark):
    rows = [("2021-10-13", "com", "total", 9), ("2023-03-19", "com", "total", 4), ("2023-03-19", "se", "deployed", 2)]
    assert as_set(deployment.table1(long_table(spark, rows))) == {
        ("with_mx", 4, 0, 0, 0),
        ("deployed", 0, 0, 0, 2),
        ("with_include", 0, 0, 0, 0),
        ("with_external_include", 0, 0, 0, 0),
    }


def test_wide_row_has_54_fields(spark):
    wide = deployment.wide(long_table(spark, [("2021-10-13", "io", "total", 3), ("2021-10-13", "net", "total", 4)]))
    assert len(wide.columns) == 54
    row = wide.first()
    assert (row.joined, row.total_net, row.total_com) == (7, 4, 0)


def test_rewriting_a_snapshot_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "summary")
    sinks.write_summary(
        long_table(spark, [("2021-10-13", "com", "total", 1), ("2023-03-19", "com", "total", 2)]), path
    )
    sinks.write_summary(long_table(spark, [("2023-03-19", "com", "total", 5)]), path)
    got = read_summary(spark, path).collect()
    assert {(str(r.snapshot_date), r.n) for r in got} == {("2021-10-13", 1), ("2023-03-19", 5)}
    assert read_summary(spark, path, ["2021-10-13"]).count() == 1
