"""Readers of JSON lines against plain Python on random values of all types in every field."""

import json
import random

import pytest

from mailpolicy.functions import jsonvalues as js
from mailpolicy.operators import reports
from mailpolicy.sources.reports import parse_reports
from mailpolicy.sources.scans import parse_mx, parse_spf
from pyspark.sql import functions as F

MISSING = object()
ODD = [MISSING, None, 5, 2.5, True, "", "text data pass a", [], ["data", "a", "pass", "q.com"], {}, {"x": 1}, [None], [[1]]]
FAILS = object()


def pick(rng, *usual, odd=0.35):
    return rng.choice(ODD) if rng.random() < odd else rng.choice(usual)()


def obj(**fields):
    return {k: v for k, v in fields.items() if v is not MISSING}


def item(value, key):
    """An object's field, or FAILS where Python would raise."""
    return value[key] if isinstance(value, dict) and key in value else FAILS


def within(word, value):
    return word in value if isinstance(value, (str, list, dict)) else FAILS


def empty(value):
    return len(value) == 0 if isinstance(value, (str, list, dict)) else FAILS


def elements(parent, key):
    """What a loop over an optional field goes through; FAILS if it cannot."""
    if not isinstance(parent, dict):
        return FAILS
    value = parent.get(key, [])
    return list(value) if isinstance(value, (str, list, dict)) else FAILS


# --- TXT records: what is counted before the first failure


def counted(record):
    found = elements(record["data"], "answers") if "data" in record else []
    out = []
    for answer in found if found is not FAILS else []:
        if item(answer, "type") is FAILS:
            break
        if answer["type"] == "TXT" and "answer" in answer:
            if not isinstance(answer["answer"], str):
                break
            out.append(answer["answer"])
    return out


def test_txt_records(spark):
    rng = random.Random(1)
    records = []
    for i in range(600):
        answers = lambda: [pick(rng, lambda: obj(type=pick(rng, lambda: "TXT", lambda: "A", odd=0.2), answer=pick(rng, lambda: f"v=spf1 a{i}")), odd=0.2) for _ in range(rng.randint(0, 4))]  # noqa: B023, E731
        listed = [None if a is MISSING else a for a in answers()]
        data = pick(rng, lambda: obj(answers=pick(rng, lambda: listed, odd=0.2)), odd=0.2)  # noqa: B023
        records.append(obj(name=f"n{i}.com", data=data))
    df = spark.createDataFrame([(json.dumps(r),) for r in records], "value string")
    found = {r.name: r.texts for r in parse_spf(df, "reference").select("name", F.filter(F.transform("answers", lambda a: F.when(a["type"] == "TXT", a["answer"])), lambda x: x.isNotNull()).alias("texts")).collect()}
    assert {n: t or [] for n, t in found.items()} == {r["name"]: counted(r) for r in records}
    # strict mode loses nothing that can be read
    for r in parse_spf(df, "strict").collect():
        listed = elements(records[int(r.name[1:-4])].get("data"), "answers")
        texts = [a["answer"] for a in (listed if listed is not FAILS else []) if isinstance(a, dict) and a.get("type") == "TXT" and isinstance(a.get("answer"), str)]
        assert [a.answer for a in r.answers or [] if a.type == "TXT" and a.answer is not None] == texts


# --- MX records: one failure drops the line


def mx_present(pair):
    if not isinstance(pair[1], list):
        return False
    some = False
    for record in pair[1]:
        asked = within("data", record)
        if asked is FAILS:
            return False
        if not asked:
            continue
        exchanges = elements(item(record, "data"), "exchanges")
        if exchanges is FAILS:
            return False
        for x in exchanges:
            if item(x, "type") is FAILS:
                return False
            if x["type"] == "MX":
                addresses = elements(x, "ipv4_addresses")
                if "name" not in x or addresses is FAILS or (addresses and isinstance(x["name"], (list, dict))):
                    return False
                some = True
    return some


def test_mx_records(spark):
    rng = random.Random(2)
    pairs = []
    for i in range(800):
        exchange = lambda: obj(type=pick(rng, lambda: "MX", lambda: "A", odd=0.1), name=pick(rng, lambda: "m.net", odd=0.3), ipv4_addresses=pick(rng, lambda: ["192.0.2.1"], lambda: MISSING, odd=0.3))
        exchanges = lambda: [pick(rng, exchange, odd=0.05) for _ in range(rng.randint(0, 3))]  # noqa: B023, E731
        record = lambda: obj(status=1, data=pick(rng, lambda: obj(exchanges=pick(rng, exchanges, odd=0.15)), odd=0.15))  # noqa: B023, E731
        records = [r for r in (pick(rng, record, odd=0.2) for _ in range(rng.randint(0, 3))) if r is not MISSING]  # noqa: B023
        pairs.append([f"n{i}.com", pick(rng, lambda: records, odd=0.05)])  # noqa: B023
    pairs = [[n, None if r is MISSING else [x for x in r if x is not MISSING] if isinstance(r, list) else r] for n, r in pairs]
    pairs = [json.loads(json.dumps(p, default=lambda o: None)) for p in pairs]
    df = spark.createDataFrame([(json.dumps(p),) for p in pairs], "value string")
    assert {r.name for r in parse_mx(df, "reference").collect()} == {p[0] for p in pairs if mx_present(p)}


# --- reports


def facts_of(report):
    """lookups, include series and missing address of a report in reference mode."""
    lookups = report.get("lookups")
    whole = isinstance(lookups, (int, float)) and lookups == int(lookups)
    series = None
    if whole:
        series = "include_absent"
        if "expanded" in report:
            own = within("q.com", report["expanded"])
            if own is FAILS or (own and not isinstance(report["expanded"], dict)):
                series = None
            elif own:
                entry = report["expanded"]["q.com"]
                there = within("include:", entry.get("spf")) if isinstance(entry, dict) else FAILS
                series = None if there is FAILS else "include_present" if there else "include_absent"
    return int(lookups) if whole else None, series, missing(report.get("expanded"))


def missing(expanded):
    for entry in expanded.values() if isinstance(expanded, dict) else []:
        for verdict in ("pass", "fail", "softfail", "neutral"):
            asked = within(verdict, entry)
            if asked is FAILS:
                return False
            if asked:
                value = item(entry, verdict)
                host = FAILS if value is FAILS else within("a", value)
                if host is FAILS:
                    return False
                if host:
                    none = empty(item(item(value, "a"), "ips"))
                    if none is FAILS:
                        return False
                    if none:
                        return True
    return False


def texts_of(expanded, kind):
    if not isinstance(expanded, dict):
        return None
    found = [item(e, kind) for e in expanded.values()]
    if any(not isinstance(m, list) or not all(isinstance(x, str) for x in m) for m in found):
        return None
    return [x for m in found for x in m]


@pytest.mark.parametrize("seed", [3, 4])
def test_reports(spark, seed):
    rng = random.Random(seed)
    host = lambda: obj(ips=pick(rng, lambda: [], lambda: ["192.0.2.1"], odd=0.25))
    verdict = lambda: obj(a=pick(rng, host, odd=0.15))
    spf = lambda: pick(rng, lambda: "v=spf1 include:x -all", lambda: "v=spf1", lambda: ["include:"], lambda: {"include:": 1}, odd=0.3)
    entry = lambda: obj(spf=spf(), errors=pick(rng, lambda: ["e 'x'"], lambda: [], lambda: ["e", 5], odd=0.2), **{v: pick(rng, verdict, lambda: MISSING, odd=0.1) for v in ("neutral", "pass", "fail", "softfail")})
    written = []
    for i in range(500):
        names = rng.sample(["q.com", "z.net", "b.net", "a.net"], rng.randint(0, 3))
        expanded = pick(rng, lambda: obj(**{n: pick(rng, entry, odd=0.1) for n in names}), odd=0.2)  # noqa: B023
        written.append(obj(query="q.com", nr=i, lookups=pick(rng, lambda: 7, lambda: 12, odd=0.2), expanded=expanded))
    df = spark.createDataFrame([(json.dumps(r),) for r in written], "value string")
    parsed = parse_reports(df)
    rows = reports.facts(parsed, "reference").select("line_id", "lookups", "include_series", "missing_address").collect()
    by_line = {r.line_id: tuple(r)[1:] for r in rows}
    ids = {bytes(r.id): r.value for r in df.select(F.unhex(F.sha2("value", 256)).alias("id"), "value").collect()}
    assert {ids[bytes(k)]: v for k, v in by_line.items()} == {json.dumps(r): facts_of(r) for r in written}
    messages = {bytes(r.line_id): [m for d in r.domains for m in d.messages] for r in reports.messages(parsed, "errors").collect()}
    expected = {json.dumps(r): texts_of(r.get("expanded"), "errors") for r in written}
    assert {ids[k]: sorted(v) for k, v in messages.items()} == {k: sorted(v) for k, v in expected.items() if v is not None}


def test_one_value_a_line(lines):
    good = ['{"a":1}', ' {"a":1} ', '{"a":1,"a":2}', '{"b":{"c":1,"c":2}}', "{}"]
    bad = ["", "{", '{"a":1} {}', '{"a":1},{}', '{"a":1}]', '{"a":1}],[{}', "5", "null", '"{}"', "{'a':1}", '[{"a":1}]', '{"a":1} x', '{"a":01}', '{"a":1,}']
    found = js.with_value(lines(*good, *bad), "struct<a variant, b variant>", "{}", value=F.col("value"))
    assert {r.value for r in found.where(F.col("_value").isNotNull()).collect()} == set(good)


def test_types(spark):
    values = [None, True, 3, 3.0, 2.5, 10**20, "", "a include: b", [], ["a", "b"], ["a", 1], {}, {"a": 1}]
    df = spark.createDataFrame([(i, json.dumps({"v": v})) for i, v in enumerate(values)], "i int, value string")
    v = js.field(F.try_parse_json("value"), "v")
    rows = df.select("i", js.text(v).alias("t"), js.whole_number(v).alias("n"), js.texts(v).alias("ts"), js.contains(v, F.lit("a")).alias("c"), js.is_empty(v).alias("e")).orderBy("i").collect()
    assert [r.t for r in rows] == [x if isinstance(x, str) else None for x in values]
    assert [r.n for r in rows] == [None, 1, 3, 3, None, None, *[None] * 7]
    assert [r.ts for r in rows] == [x if isinstance(x, list) and all(isinstance(y, str) for y in x) else None for x in values]
    for got, function in (("c", lambda x: within("a", x)), ("e", empty)):
        assert [r[got] for r in rows] == [None if function(x) is FAILS else function(x) for x in values]
