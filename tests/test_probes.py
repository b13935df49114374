import hashlib
import json
import random
from collections import Counter, defaultdict

import pytest
from conftest import as_set

from mailpolicy.operators import probes
from mailpolicy.sources import querylog

DOMAIN = "probe.example.net"


def label(no, test, server, digits=8):
    return hashlib.md5(f"{no}.test{test}.{server}".encode()).hexdigest()[:digits]


def log_line(qname, rr_type="TXT", date="18-Jan-2024"):
    return f"{date} 13:13:07.889 client @0x7f 192.0.2.7#5353 ({qname}): query: {qname} IN {rr_type} -E(0) (203.0.113.1)"


def test_log_fields(lines):
    df = lines(
        log_line("x." + DOMAIN),
        "18-jan-2024\t13:13:07.889  query: info: client @0x7f 192.0.2.8#1 (q): view standard: query: q IN A + (1.2.3.4) ",
        " 18-Jan-2024 13:13:07.889 client @0x7f 192.0.2.9#1 (q): query: q IN A + (1.2.3.4) b c",
    )
    assert as_set(querylog.parse_log(df)) == {
        ("18-Jan-2024 13:13:07.889", "x." + DOMAIN, "TXT", "192.0.2.7", "-E(0)"),
        ("18-jan-2024 13:13:07.889", "q", "A", "192.0.2.8", "+"),
        ("18-Jan-2024 13:13:07.889", "q", "A", "192.0.2.9", "+"),
    }


def test_log_rejects(lines):
    good = log_line("x." + DOMAIN)
    bad = ["", "one two three", good + " more", good.replace(" IN", ""), log_line("x", date="32-Jan-2024"), log_line("x", date="2024-01-18")]
    df = lines(good, *bad)
    assert querylog.parse_log(df).count() == 1
    assert sorted(r.value for r in querylog.log_rejects(df).collect()) == sorted(bad)
    assert querylog.parse_all(df).where("ts_text is null").count() == len(bad)


def test_log_until(lines):
    df = lines(log_line("a", date="10-Apr-2024"), log_line("b", date="11-Apr-2024"))
    assert as_set(querylog.parse_log(df, until="2024-04-11").select("qname")) == {("a",)}


def test_ids_keep_their_order_over_file_splits(spark, tmp_path):
    ids = [hashlib.md5(str(i).encode()).hexdigest()[:16] for i in range(3000)]
    path = tmp_path / "ids.json"
    path.write_text(json.dumps(ids, indent=1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = sorted((r.pos, r.id) for r in querylog.read_ids(spark, str(path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(enumerate(ids))
    path.write_text("[]")
    assert querylog.read_ids(spark, str(path)).count() == 0


def test_no_id_is_lost(spark, tmp_path):
    path = tmp_path / "ids.json"
    path.write_text('["aa", null, "cc"]')
    assert sorted((r.pos, r.id) for r in querylog.read_ids(spark, str(path)).collect()) == [(0, "aa"), (2, "cc")]
    for broken in ('["aa" "bb","cc"', '["aa","bb]', '["aa",5]', '["aa",["bb"],"cc"]', '["aa",{"b":"c"}]', "[aa]", '["aa","b\\,b"]'):
        path.write_text(broken)
        with pytest.raises(Exception, match="not one string"):
            querylog.read_ids(spark, str(path)).collect()


@pytest.mark.parametrize("size", [1, 3, 7, 64, 100_000])
def test_any_strings_are_ids(spark, tmp_path, size):
    rng = random.Random(size)
    ids = ["aa", "b,b", 'c"c', "", ",", '","', "\\", '\\"', "\\\\,", "[x", "y]", "[]", "null", " a ", "é,🙂", "a\nb,\tc", "\u2028"]
    ids += ["".join(rng.choice('ab,"\\[] \né') for _ in range(rng.randint(0, 9))) for _ in range(40)]
    given = [None if rng.random() < 0.1 else i for i in ids]
    path = tmp_path / "ids.json"
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        for text in (json.dumps(given), json.dumps(given, ensure_ascii=False, indent=2), " [ " + " , ".join(map(json.dumps, given)) + " ] \n"):
            path.write_text(text, encoding="utf-8")
            got = sorted((r.pos, r.id) for r in querylog.read_ids(spark, str(path)).collect())
            assert got == [(i, x) for i, x in enumerate(given) if x is not None]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def frame(spark, ids):
    return spark.createDataFrame(ids, "pos bigint, id string")


IDS = [(5, "aa"), (700, "bb"), (999_999, "cc"), (1_000_000, "dd"), (1_000_007, "ee"), (800, "aa")]


def owners(ids, digits, mode):
    """Fill one table per id range in list order, first table first to be asked; strict drops what meets."""
    first, second, met = {}, {}, defaultdict(set)
    for pos, server in sorted(ids):
        table = first if pos < 1_000_000 else second
        for no in range(51):
            for test in (1, 2):
                table[label(no, test, server, digits)] = (server, no, test)
                met[label(no, test, server, digits)].add((server, no, test))
    if mode == "strict":
        return {k: next(iter(v)) for k, v in met.items() if len(v) == 1}, met
    return {**second, **first}, met


@pytest.mark.parametrize("digits", [2, 3, 8])
@pytest.mark.parametrize("mode", ["reference", "strict"])
def test_label_owners(spark, mode, digits):
    want, met = owners(IDS, digits, mode)
    got = {r.label: (r.id, r.no, r.test) for r in probes.labels(frame(spark, IDS), mode, digits).collect()}
    assert got == want
    ambiguous = sum(len(v) > 1 for v in met.values())
    assert probes.ambiguous_labels(frame(spark, IDS), digits).first().n == ambiguous
    assert (ambiguous > 0) == (digits < 8)


def random_log(seed):
    rng = random.Random(seed)
    # one server makes a third of all queries
    servers = ["aa"] * 4 + ["bb", "cc", "dd", "ee", "unlisted"]
    out = []
    for _ in range(1500):
        server, no, test = rng.choice(servers), rng.randrange(51), rng.choice([1, 2])
        if server == "cc" and no > 44:
            continue
        name = label(no, test, server)
        if rng.random() < 0.1:
            name = name.upper()
        domain = rng.choice([DOMAIN, DOMAIN.upper(), "other.net"])
        out.append(log_line(f"{name}.{domain}", rng.choice(["TXT", "TXT", "A"])))
    return out + ["garbage"] * 5 + [log_line("no-label." + DOMAIN)] * 3


@pytest.mark.parametrize("mode", ["reference", "strict"])
def test_server_counts_and_funnel(spark, lines, mode):
    log = random_log(7)
    table, _ = owners(IDS, 8, mode)
    total, seen, txt, mapped = Counter(), defaultdict(set), 0, 0
    for text in log:
        words = text.split()
        if len(words) < 10:
            continue
        qname, rr = words[7], words[9]
        if rr != "TXT" or DOMAIN not in qname.lower():
            continue
        txt += 1
        name = qname.split(".")[0]
        name = name if mode == "reference" else name.lower()
        if name in table:
            mapped += 1
            server, no, test = table[name]
            total[server, test] += 1
            total[server, "void"] += test == 2 and no >= 15
            seen[server, test].add(no)
    ids = frame(spark, IDS)
    got = {r.server_id: r for r in probes.server_counts(querylog.parse_log(lines(*log)), ids, DOMAIN, mode).collect()}
    assert set(got) == {s for s, _ in seen}
    for s, r in got.items():
        void = {n for n in seen[s, 2] if n >= 15}
        assert (r.total1, r.unique1) == (total[s, 1], len(seen[s, 1]))
        assert (r.total2, r.unique2) == (total[s, 2], len(seen[s, 2]))
        assert (r.void_total, r.void_unique) == (total[s, "void"], len(void))
        assert r.indicators1 == (set(probes.INDICATORS) <= seen[s, 1])
        assert r.indicators2 == (set(probes.INDICATORS) <= seen[s, 2])
    counts = probes.label_counts(querylog.parse_all(lines(*log)), DOMAIN, mode)
    assert tuple(probes.funnel(counts, ids, mode).first()) == (len(log), 5, txt, mapped)
    assert as_set(probes.servers(counts, ids, mode)) == {tuple(r) for r in got.values()}


@pytest.mark.parametrize("mode", ["reference", "strict"])
def test_states_of_parts_of_a_log_add_up(spark, lines, mode):
    log, ids = random_log(11), frame(spark, IDS)
    rng = random.Random(1)
    parts = [[], [], []]
    for text in log:
        parts[rng.randrange(3)].append(text)
    parts.append(["garbage"])
    states = [probes.state(probes.label_counts(querylog.parse_all(lines(*p)), DOMAIN, mode), ids, mode) for p in parts]
    whole = as_set(probes.state(probes.label_counts(querylog.parse_all(lines(*log)), DOMAIN, mode), ids, mode))
    assert as_set(probes.merged(*states)) == as_set(probes.merged(probes.merged(states[2], states[0]), states[1])) == whole
    assert len(whole) > 3


@pytest.mark.parametrize("digits", [2, 3, 8])
@pytest.mark.parametrize("mode", ["reference", "strict"])
def test_owners_of_seen_labels_only(spark, mode, digits):
    """All probes that share a seen label stay, so that owners are right; hardly any others move."""
    table, met = owners(IDS, digits, mode)
    rng = random.Random(digits)
    asked = rng.sample(sorted(met), 12) + ["zz" * 4, "AB", "", "0" * digits, "f" * digits, None]
    counts = spark.createDataFrame([(x, 1, 0) for x in asked], "label string, n bigint, unreadable bigint")
    ids = frame(spark, IDS)
    ranks = {r.id: r["rank"] for r in probes._ranked(ids).collect()}
    want = {x: (ranks[table[x][0]] * 102 + table[x][1] * 2 + table[x][2] - 1 if x in table else None) for x in asked}
    assert {r.label: r.slot for r in probes.matched(counts, ids, mode, digits).collect()} == want
    kept = probes._owners(probes._ranked(ids), digits, probes.seen_labels(counts, digits)).collect()
    assert {r.label for r in kept} == set(asked) & set(met)


def test_the_log_is_read_once(spark, tmp_path):
    (tmp_path / "log").write_text("\n".join(random_log(3)))
    log = querylog.parse_all(querylog.read_log_lines(spark, str(tmp_path / "log")))
    for build in (probes.servers, probes.funnel):
        result = build(probes.label_counts(log, DOMAIN), frame(spark, IDS))
        result.collect()
        plan = result._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("FileScan text") == 1 and "ReusedExchange" in plan


COLUMNS = (
    "server_id string, total1 bigint, unique1 bigint, total2 bigint, unique2 bigint, void_total bigint, "
    "void_unique bigint, indicators1 boolean, indicators2 boolean"
)
SERVERS = [
    ("all", 60, 51, 70, 51, 40, 36, True, True),
    ("most", 46, 46, 0, 0, 0, 0, True, False),
    ("gaps", 46, 46, 46, 46, 31, 31, False, False),
    ("busy", 60, 20, 70, 20, 30, 30, False, False),
    ("same", 55, 51, 55, 51, 31, 31, True, True),
    ("second", 0, 0, 3, 3, 0, 0, False, False),
]


def test_thresholds(spark):
    servers = spark.createDataFrame(SERVERS, COLUMNS)
    assert as_set(probes.no_total_limit(servers, "reference")) == {("all", 51), ("same", 51)}
    assert as_set(probes.no_total_limit(servers)) == {("all", 51), ("same", 51), ("most", 46)}
    assert as_set(probes.many_queries(servers, "reference")) == {
        ("all", 60), ("all", 70), ("busy", 60), ("busy", 70), ("same", 55),
    }
    assert as_set(probes.many_queries(servers)) == {("all", 70), ("busy", 70), ("same", 55), ("most", 46)}
    assert as_set(probes.no_void_limit(servers)) == {("all", 36), ("gaps", 31), ("same", 31)}
    assert as_set(probes.vulnerable_in_both(servers, "reference")) == {("all",), ("same",)}
    assert tuple(probes.limits(servers, "reference").first()) == (5, 2, 5, 3, 2)
    assert tuple(probes.limits(servers).first()) == (5, 3, 4, 3, 2)
    assert ("second", 3, 0) in as_set(probes.max_totals(servers))
    assert ("total", 3) in as_set(probes.server_series(probes.max_totals(servers)))


def test_scanned(spark):
    assert probes.scanned(frame(spark, IDS)).first().n == 5
