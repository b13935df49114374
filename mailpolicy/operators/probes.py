"""Lookup-limit probes: labels, log matching, per-server counts, limit checks (JN3-5, AGG26-38, AGG40, FLT3-4, FLT8).

Each scanned server got names whose first label is a digest of probe number, test and server id. A server's queries in the
log are found by that label.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailpolicy.functions.names import first_label
from mailpolicy.functions.text import select_once
from mailpolicy.modes import STRICT, is_reference

# Fixed values of the experiment.
PROBES = 51
TESTS = 2
LABEL_DIGITS = 8
FIRST_MAP_IDS = 1_000_000
VOID_FIRST, VOID_LAST = 15, 50
INDICATORS = [0, 1, 2, 3, 15, 16, 35, 36, 50]
ALL_SEEN, MOST_SEEN, MANY_QUERIES, VOID_LIMIT = 51, 45, 51, 31

_PER_ID = PROBES * TESTS
# Leading hex digits of a label that are looked up in the bitmap of labels seen: 2^28 bits, 32 MB, at any size of the log.
_SEEN_DIGITS = 7
# added to the position of the ids of the first label map, which outranks the second
_FIRST_MAP_RANK = 1 << 40


def _ranked(ids: DataFrame) -> DataFrame:
    """``rank, id``, one row per distinct id; of two ids with the same label the one of higher rank gets it."""
    pos = F.col("pos").cast("bigint")
    rank = F.when(pos < FIRST_MAP_IDS, pos + _FIRST_MAP_RANK).otherwise(pos)
    return ids.groupBy("id").agg(F.max(rank).alias("rank"))


def _label_number(label: Column, digits: int) -> Column:
    return F.conv(F.substring(label, 1, min(digits, _SEEN_DIGITS)), 16, 10).cast("bigint")


def seen_labels(counts: DataFrame, digits: int = LABEL_DIGITS) -> DataFrame:
    """``bucket, bits``: bitmap of the leading digits of all labels in ``label_counts``, 32,768 bits a row.

    Labels are digests, so their leading digits are as good as any hash. The bitmap has 2^28 bits at most, and a label that
    was seen is always found in it; of those not seen a share passes that is the number of seen ones by 2^28.
    """
    number = F.when(F.rlike("label", F.lit(f"^[0-9a-f]{{{digits}}}$")), _label_number(F.col("label"), digits))
    numbers = counts.select(number.alias("x")).where(F.col("x").isNotNull())
    return numbers.groupBy(F.bitmap_bucket_number("x").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))


def _only_seen(labelled: DataFrame, seen: DataFrame, digits: int) -> DataFrame:
    """Rows whose ``label`` may have been seen. The bitmap, of bounded size, is broadcast: nothing moves before that."""
    numbered = labelled.withColumn("_x", _label_number(F.col("label"), digits))
    near = numbered.join(F.broadcast(seen), F.bitmap_bucket_number("_x") == F.col("bucket"))
    # The bit's half of its byte as a hex digit, and the digits that have the bit; a long binary is not turned into numbers.
    byte = F.expr("hex(substring(bits, int(bitmap_bit_position(_x) div 8) + 1, 1))")
    bit = F.bitmap_bit_position("_x") % 8
    digit = F.substring(byte, F.when(bit < 4, 2).otherwise(1), F.lit(1))
    having = ["".join(f"{d:X}" for d in range(16) if d >> i & 1) for i in range(4)]
    return near.where(F.contains(F.get(F.array(*map(F.lit, having)), (bit % 4).cast("int")), digit)).select(*labelled.columns)


def _owners(ranked: DataFrame, digits: int, seen: DataFrame | None = None) -> DataFrame:
    """``label, slot, lowest``, one row per label; a slot is rank, probe number and test in one number.

    With one number to compare, ownership of a label is a plain maximum in a hash aggregation (Q13). The planner does not
    see that there are 102 labels per id, so joins with these tables are merge joins and never a broadcast. ``seen`` leaves
    out labels that the log does not have before they move; of the others every probe stays, so owners are the same.
    """
    probe = ranked.select("id", "rank", F.explode(F.sequence(F.lit(0), F.lit(_PER_ID - 1))).alias("k"))
    no = F.expr(f"k div {TESTS}")
    test = F.col("k") % TESTS + 1
    text = F.concat(no.cast("string"), F.lit(".test"), test.cast("string"), F.lit("."), F.col("id"))
    label, slot = F.substring(F.md5(text), 1, digits), F.col("rank") * _PER_ID + F.col("k")
    if seen is None:
        labelled = probe.select(label.alias("label"), slot.alias("slot"))
    else:
        # Digested once, for the look-up and for what moves.
        labelled = _only_seen(select_once(probe, label=label, slot=slot).select("label", "slot"), seen, digits)
    return labelled.groupBy("label").agg(F.max("slot").alias("slot"), F.min("slot").alias("lowest"))


def _slots(ranked: DataFrame, mode: str, digits: int = LABEL_DIGITS, seen: DataFrame | None = None) -> DataFrame:
    """``label, slot`` of the owner; strict mode leaves out labels that more than one probe has."""
    owners = _owners(ranked, digits, seen)
    if not is_reference(mode):
        owners = owners.where(F.col("slot") == F.col("lowest"))
    return owners.select("label", "slot")


def _rank() -> Column:
    return F.expr(f"slot div {_PER_ID}")


def _no() -> Column:
    return F.expr(f"int((slot % {_PER_ID}) div {TESTS})")


def _test() -> Column:
    return F.expr(f"int(slot % {TESTS}) + 1")


def labels(ids: DataFrame, mode: str = STRICT, digits: int = LABEL_DIGITS) -> DataFrame:
    """``label, id, no, test``: which probe of which server a label stands for (JN4, D13)."""
    ranked = _ranked(ids)
    owned = _slots(ranked, mode, digits).select("label", _rank().alias("rank"), _no().alias("no"), _test().alias("test"))
    return owned.join(ranked.hint("merge"), "rank").select("label", "id", "no", "test")


def ambiguous_labels(ids: DataFrame, digits: int = LABEL_DIGITS) -> DataFrame:
    """``n``: labels that more than one probe has, which strict mode leaves out."""
    return _owners(_ranked(ids), digits).agg(F.count_if(F.col("slot") != F.col("lowest")).alias("n"))


def _is_probe(domain: str) -> Column:
    """TXT query below the probe domain (FLT3)."""
    hit = (F.col("rr_type") == "TXT") & F.contains(F.lower("qname"), F.lit(domain))
    return F.coalesce(hit, F.lit(False))


def _label(mode: str) -> Column:
    """First label of the query name; strict mode ignores its case (Q17)."""
    label = first_label(F.col("qname"))
    return label if is_reference(mode) else F.lower(label)


def label_counts(log: DataFrame, domain: str, mode: str = STRICT) -> DataFrame:
    """``label, n, unreadable``: log lines per probe label; lines that are no probe have a null label.

    Everything else is drawn from this table. The log is counted by label before anything moves, so a server with a third
    of all queries is at most 102 rows after that.
    """
    counted = (
        log.select(
            F.when(_is_probe(domain), _label(mode)).alias("label"),
            F.col("ts_text").isNull().alias("unreadable"),
        )
        .groupBy("label")
        .agg(F.count("*").alias("n"), F.count_if("unreadable").alias("unreadable"))
    )
    # No filter or pruning of what is drawn from here reaches the log, so that its exchange is the same for all and is made
    # once. It costs a second shuffle of the counts, which are few beside the log.
    return select_once(counted, **{c: F.col(c) for c in counted.columns})


def matched(counts: DataFrame, ids: DataFrame, mode: str = STRICT, digits: int = LABEL_DIGITS) -> DataFrame:
    """``label_counts`` with ``slot``, the probe a label stands for, null if none (JN3).

    ``servers`` and ``funnel`` take it instead of ``label_counts``, so that labels are worked out once for both. Of all labels
    of all ids only those are moved that the log may have.
    """
    if "slot" in counts.columns:
        return counts
    return counts.join(_slots(_ranked(ids), mode, digits, seen_labels(counts, digits)).hint("merge"), "label", "left")


# What a server's state adds up: numbers of queries, and a bit for every probe number seen in a test.
_SUMS = ["total1", "total2", "void_total"]
_MASKS = ["mask1", "mask2"]


def state(counts: DataFrame, ids: DataFrame, mode: str = STRICT) -> DataFrame:
    """``server_id, total1, total2, void_total, mask1, mask2``: what ``label_counts`` say of each server, in a form that adds up.

    Bit i of a mask says that probe i of the test was seen. Which probe a label stands for depends on the ids alone, so states
    of several logs and the same ids are merged by ``merged`` without another look at the logs.
    """
    ranked = _ranked(ids)
    seen = matched(counts, ids, mode).where(F.col("slot").isNotNull()).select(
        _rank().alias("rank"), _no().alias("no"), _test().alias("test"), "n"
    )
    n, void = F.col("n"), F.col("no").between(VOID_FIRST, VOID_LAST)
    first, second = (F.col("test") == t for t in (1, 2))
    bit, none = F.expr("shiftleft(1L, no)"), F.lit(0).cast("bigint")
    per_server = seen.groupBy("rank").agg(
        *[F.coalesce(F.sum(F.when(cond, n)), none).alias(c) for c, cond in zip(_SUMS, (first, second, second & void))],
        *[F.bit_or(F.when(cond, bit).otherwise(none)).alias(c) for c, cond in zip(_MASKS, (first, second))],
    )
    return per_server.join(ranked.hint("merge"), "rank").select(F.col("id").alias("server_id"), *_SUMS, *_MASKS)


def merged(states: DataFrame, *more: DataFrame) -> DataFrame:
    """One state of several, as if it had been drawn from all their logs together."""
    for other in more:
        states = states.unionByName(other)
    sums = [F.sum(c).alias(c) for c in _SUMS]
    return states.groupBy("server_id").agg(*sums, *[F.bit_or(c).alias(c) for c in _MASKS])


def _mask(numbers) -> Column:
    return F.lit(sum(1 << i for i in numbers)).cast("bigint")


def of_state(states: DataFrame) -> DataFrame:
    """One row per server (AGG26-31, AGG40): ``server_id, total1, unique1, total2, unique2, void_total, void_unique, indicators1, indicators2``."""
    def unique(mask: Column) -> Column:
        return F.bit_count(mask).cast("bigint")

    def indicators(mask: str) -> Column:
        return F.col(mask).bitwiseAND(_mask(INDICATORS)) == _mask(INDICATORS)

    void = F.col("mask2").bitwiseAND(_mask(range(VOID_FIRST, VOID_LAST + 1)))
    return states.select(
        "server_id",
        "total1",
        unique(F.col("mask1")).alias("unique1"),
        "total2",
        unique(F.col("mask2")).alias("unique2"),
        "void_total",
        unique(void).alias("void_unique"),
        indicators("mask1").alias("indicators1"),
        indicators("mask2").alias("indicators2"),
    )


def servers(counts: DataFrame, ids: DataFrame, mode: str = STRICT) -> DataFrame:
    """One row per server seen in ``label_counts``, as ``of_state``."""
    return of_state(state(counts, ids, mode))


def server_counts(log: DataFrame, ids: DataFrame, domain: str, mode: str = STRICT) -> DataFrame:
    """``servers`` of a log, other lines left out first (JN3)."""
    return servers(label_counts(log.where(_is_probe(domain)), domain, mode), ids, mode)


def funnel(counts: DataFrame, ids: DataFrame, mode: str = STRICT) -> DataFrame:
    """``lines, unreadable, txt_rows, mapped_rows`` of a log (AGG32), from ``label_counts`` of ``querylog.parse_all``."""
    found = matched(counts, ids, mode)

    def total(col: str, cond: Column | None = None) -> Column:
        counted_if = F.col(col) if cond is None else F.when(cond, F.col(col))
        return F.coalesce(F.sum(counted_if), F.lit(0).cast("bigint"))

    return found.agg(
        total("n").alias("lines"),
        total("unreadable").alias("unreadable"),
        total("n", F.col("label").isNotNull()).alias("txt_rows"),
        total("n", F.col("slot").isNotNull()).alias("mapped_rows"),
    )


def max_totals(servers: DataFrame) -> DataFrame:
    """``server_id, max_total, void_total`` (MSR7, JN5): the larger of the two tests' query counts."""
    return servers.select("server_id", F.greatest("total1", "total2").alias("max_total"), "void_total")


def server_series(totals: DataFrame) -> DataFrame:
    """``series, value`` rows of ``max_totals`` for the two curves of the report."""
    return totals.select(
        F.inline(
            F.array(
                F.struct(F.lit("total").alias("series"), F.col("max_total").alias("value")),
                F.struct(F.lit("void").alias("series"), F.col("void_total").alias("value")),
            )
        )
    )


def _no_total_limit(test: int, mode: str) -> Column:
    """All probes of a test seen, or most of them and every indicator; the latter never holds in reference mode (Q12)."""
    unique = F.col(f"unique{test}")
    every = unique >= ALL_SEEN
    if is_reference(mode):
        return every
    return every | (F.col(f"indicators{test}") & (unique >= MOST_SEEN))


def _many_queries(test: int, mode: str) -> Column:
    many = F.col(f"total{test}") >= MANY_QUERIES
    if is_reference(mode):
        return many
    return many | (F.col(f"indicators{test}") & (F.col(f"unique{test}") >= MOST_SEEN))


def _pairs(servers: DataFrame, measure: str, test_passes, mode: str) -> DataFrame:
    """Union over both tests of the servers that pass (SET1).

    Reference mode returns ``server_id, n`` pairs, two for a server with different numbers in the two tests (Q15); strict
    mode returns each server once with the larger number. A server is one row here, so its pairs are made distinct in it.
    """
    numbers = F.array_distinct(
        F.array_compact(F.array(*[F.when(test_passes(t, mode), F.col(f"{measure}{t}")) for t in (1, 2)]))
    )
    if is_reference(mode):
        return servers.select("server_id", F.explode(numbers).alias("n"))
    return servers.select("server_id", F.array_max(numbers).alias("n")).where(F.col("n").isNotNull())


def no_total_limit(servers: DataFrame, mode: str = STRICT) -> DataFrame:
    """Servers without a limit on lookups, with the number of distinct probes (AGG34)."""
    return _pairs(servers, "unique", _no_total_limit, mode)


def many_queries(servers: DataFrame, mode: str = STRICT) -> DataFrame:
    """Servers with 51 queries or more, with the number of queries (AGG35)."""
    return _pairs(servers, "total", _many_queries, mode)


def _no_void_limit() -> Column:
    return F.col("void_unique") >= VOID_LIMIT


def no_void_limit(servers: DataFrame) -> DataFrame:
    """Servers without a limit on void lookups, with the number of distinct void probes (AGG36)."""
    return servers.where(_no_void_limit()).select("server_id", F.col("void_unique").alias("n"))


def vulnerable_in_both(servers: DataFrame, mode: str = STRICT) -> DataFrame:
    """``server_id`` of the servers in both sets (AGG38, SET2); one row per server, so the intersection is a filter."""
    total = _no_total_limit(1, mode) | _no_total_limit(2, mode)
    return servers.where(total & _no_void_limit()).select("server_id")


def limits(servers: DataFrame, mode: str = STRICT) -> DataFrame:
    """The report's counts in one row: servers that queried (AGG33) and the sizes of the sets above."""
    def members(measure: str, passes) -> Column:
        either = [passes(t, mode) for t in (1, 2)]
        if not is_reference(mode):
            return (either[0] | either[1]).cast("bigint")
        same = either[0] & either[1] & (F.col(f"{measure}1") == F.col(f"{measure}2"))
        return either[0].cast("bigint") + either[1].cast("bigint") - same.cast("bigint")

    def total(col: Column) -> Column:
        return F.coalesce(F.sum(col), F.lit(0).cast("bigint"))

    both = (_no_total_limit(1, mode) | _no_total_limit(2, mode)) & _no_void_limit()
    return servers.agg(
        F.count_if(F.col("unique1") > 0).alias("responding"),
        total(members("unique", _no_total_limit)).alias("no_total_limit"),
        total(members("total", _many_queries)).alias("many_queries"),
        F.count_if(_no_void_limit()).alias("no_void_limit"),
        F.count_if(both).alias("in_both"),
    )


def scanned(ids: DataFrame) -> DataFrame:
    """``n``: distinct scanned servers (DST2, AGG37)."""
    return ids.select("id").distinct().agg(F.count("*").alias("n"))
