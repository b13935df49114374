import math
import random
from collections import Counter
from decimal import Decimal
from fractions import Fraction
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from mailpolicy.operators import curves
from mailpolicy.sources.counts import include_count_rejects, parse_include_counts, parse_server_counts, read_include_counts, server_count_rejects


def values(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "value bigint")


def points(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_frequency_example(spark):
    got = points(curves.cdf(values(spark, [0, 0, 1, 1, 2, 3]), "value"), "value", "cdf")
    assert got == [(0, 2 / 6), (1, 4 / 6), (2, 5 / 6), (3, 1.0)]


def test_total_example(spark):
    got = points(curves.cdf(values(spark, [0, 1, 1, 2, 3]), "value", how="total"), "value", "cdf")
    assert got == [(0, 0.0), (1, 2 / 7), (2, 4 / 7), (3, 1.0)]


def test_concentration_example(spark):
    got = points(curves.concentration(values(spark, [3, 2, 1, 1, 0]), "value"), "idx", "value", "share")
    assert got == [(0, 3, 3 / 7), (1, 2, 5 / 7), (3, 1, 1.0), (4, 0, 1.0)]


def test_empty_and_zero(spark):
    assert curves.cdf(values(spark, []), "value").count() == 0
    assert points(curves.cdf(values(spark, [0, 0]), "value", how="total"), "value", "cdf") == [(0, None)]


def test_texts_are_refused(spark):
    with pytest.raises(TypeError):
        curves.cdf(spark.createDataFrame([("0.5",)], "value string"), "value")


_DOUBLES = [0.0, -0.0, 5e-324, 1e-310, 2.2250738585072014e-308, 0.1, 0.5, 1.0, 2.0, 3.0, 1e15 + 0.3, 1.7976931348623157e308, float("inf")]


def test_places_rise_with_doubles(spark):
    rng = random.Random(5)
    xs = {x for x in _DOUBLES if x < float("inf")} | {rng.uniform(0, 2) * 2.0 ** rng.randint(-1073, 1022) for _ in range(3000)}
    # Around every power of two, where the logarithm may be rounded to the wrong side.
    for e in range(-1074, 1024):
        p = 2.0**e
        xs |= {p, math.nextafter(p, 0), math.nextafter(p, math.inf)}
    xs = sorted({s * x for s in (1, -1) for x in (*xs, float("inf"))})
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, value double").select("i", curves._place("double").alias("place"))
    places = [r.place for r in sorted(rows.collect(), key=lambda r: r.i)]
    assert all(a <= b for a, b in zip(places, places[1:]))
    assert max(Counter(places).values()) <= 2 and places[0] == -places[-1] == -(2**63 - 1)


@pytest.mark.parametrize("kind", ["double", "float", "decimal(9,2)", "decimal(38,20)"])
@pytest.mark.parametrize("how", ["freq", "total"])
def test_real_numbers_match_a_fold(spark, kind, how):
    rng = random.Random(7)
    xs = [Decimal(rng.randint(-9999, 99999)) / 100 for _ in range(400)] * 2 + [Decimal(rng.randint(0, 3)) for _ in range(100)]
    rows = spark.createDataFrame([(str(x),) for x in xs], "value string").select(F.col("value").cast(kind).alias("value"))
    rows = rows.union(rows.limit(1).select(F.lit(None).cast(kind))).union(rows.limit(1).select(F.lit("NaN" if kind in ("double", "float") else None).cast(kind)))
    got = [(r.value, r.cum, r.cdf) for r in sorted(curves.cdf(rows, "value", how=how).collect(), key=lambda r: r.value)]
    held = [r.value for r in rows.collect() if r.value is not None and r.value == r.value]
    weight = (lambda x: 1) if how == "freq" else (lambda x: Fraction(x))
    total, cum, i = sum(map(weight, held)), 0, 0
    for value, n in sorted(Counter(held).items()):
        cum += weight(value) * n
        assert got[i][0] == value and float(got[i][1]) == pytest.approx(float(cum), abs=1e-6)
        assert float(got[i][2]) == pytest.approx(float(cum / total), abs=1e-6)
        i += 1
    assert i == len(got)
    assert dict(curves.cdf(rows, "value").dtypes)["value"] == ("double" if kind == "float" else kind)


def test_infinite_doubles_come_last(spark):
    rows = spark.createDataFrame([(x,) for x in (float("inf"), 1.0, float("-inf"), 1e308)], "value double")
    assert points(curves.cdf(rows, "value"), "value", "cum") == [(float("-inf"), 1), (1.0, 2), (1e308, 3), (float("inf"), 4)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_blocks_do_not_show(spark, seed):
    """Values over many blocks and super-blocks, negative ones too, against a plain sort."""
    rng = random.Random(seed)
    xs = [rng.randrange(-(1 << b), 1 << b) for b in (3, 22, 30, 44, 50) for _ in range(60)] + [7] * 150
    freq = points(curves.cdf(values(spark, xs), "value"), "value", "cum", "total")
    total = points(curves.cdf(values(spark, xs), "value", how="total"), "value", "cum", "total")
    down = sorted(
        ((r.idx, r.value, r.cum) for r in curves.concentration(values(spark, xs), "value").collect())
    )
    n, s, want_freq, want_total = 0, 0, [], []
    for v, run in groupby(sorted(xs)):
        k = len(list(run))
        n, s = n + k, s + v * k
        want_freq.append((v, n, len(xs)))
        want_total.append((v, s, sum(xs)))
    assert freq == want_freq and total == want_total
    n, s, want = 0, 0, []
    for v, run in groupby(sorted(xs, reverse=True)):
        k = len(list(run))
        n, s = n + k, s + v * k
        want.append((n - 1, v, s))
    assert down == want


def test_series_do_not_mix(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 5, 2), ("b", 1, 1)], "series string, v int, n bigint")
    got = points(curves.cdf(df, "v", by=["series"], weight="n"), "series", "value", "cum", "total")
    assert got == [("a", 1, 2, 4), ("a", 5, 4, 4), ("b", 1, 1, 1)]


def test_include_counts(lines):
    given = lines("0 _spf.p1.net 120", " 1\ta.net  7 ", "2 a.net x", "3 b.net", "4 c.net 1 2", "", "2147483648 d.net 5", "x e.net 9")
    df = parse_include_counts(given)
    assert points(df, "ind", "domain", "n") == [("0", "_spf.p1.net", 120), ("1", "a.net", 7), ("2147483648", "d.net", 5), ("x", "e.net", 9)]
    assert points(include_count_rejects(given), "value") == [("",), ("2 a.net x",), ("3 b.net",), ("4 c.net 1 2",)]


def test_server_counts(lines):
    assert points(parse_server_counts(lines("b6d7 51 31", "x 1")), "server_id", "total", "void") == [("b6d7", 51, 31)]
    assert points(server_count_rejects(lines("b6d7 51 31", "x 1", "y 1 z")), "value") == [("x 1",), ("y 1 z",)]


def test_last_line_of_a_domain_wins(spark, tmp_path):
    path = tmp_path / "counts.txt"
    path.write_text("".join(f"{i} d{i % 40}.net {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        counts = read_include_counts(spark, str(path))
        assert counts.rdd.getNumPartitions() > 4
        last = points(curves.include_totals(counts, "reference"), "domain", "n")
        total = points(curves.include_totals(counts), "domain", "n")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert last == sorted((f"d{d}.net", 4960 + d) for d in range(40))
    assert total == sorted((f"d{d}.net", sum(range(d, 5000, 40))) for d in range(40))
