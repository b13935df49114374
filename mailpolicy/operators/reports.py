"""Evaluation outcomes, message classes and lookup counts of evaluator reports (DST1, JN2, AGG15-25, FLT5-7, MSR5-6)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailpolicy.functions import jsonvalues as js
from mailpolicy.functions import messages as msg
from mailpolicy.functions.text import select_once
from mailpolicy.modes import STRICT, is_reference

LOOKUP_LIMIT = 10
COUNTERS = ["not_deployed", "nonexistent_name", "name_server_failure", "multiple_policies", "over_lookup_limit"]


def facts(reports: DataFrame, mode: str = STRICT, *more: Column) -> DataFrame:
    """What every later count needs of a report, one narrow row each, and columns of one's own.

    ``query, line_id, outcome, lookups, include_series, error_classes, warning_classes, missing_address``. The class
    arrays are null for a report that has no expanded map, or an entry of it without such messages.
    """
    return reports.select(
        "query",
        "line_id",
        msg.outcome(F.col("error")).alias("outcome"),
        "lookups",
        _include_series(mode).alias("include_series"),
        msg.error_classes(_all_messages("errors"), mode).alias("error_classes"),
        msg.warning_classes(_all_messages("warnings"), mode).alias("warning_classes"),
        _missing_address(mode).alias("missing_address"),
        *more,
    )


def restrict(per_report: DataFrame, names: DataFrame, mode: str = STRICT) -> DataFrame:
    """Take exact copies of a line out (DST1), keep listed names (JN2), add ``copies``.

    ``copies`` says how often the row counts: once in strict mode, once per list entry in reference mode.

    A name may have very many reports. The adaptive planner splits such a key only where both sides of the join come
    straight from a shuffle. So in strict mode the list is not made distinct, which a semi-join does not need; in
    reference mode it is grouped by the name and its length, so that the join needs a shuffle of the (one row per name)
    list after that. Copies are taken out after the join in strict mode, whose partitioning by query serves both.
    Only the list can be broadcast, in strict mode and if it is small: the planner's guess at the size of parsed reports
    is far too low to let it choose that side.
    """
    if is_reference(mode):
        distinct = per_report.distinct()
        by_name = names.groupBy("name", F.length("name").alias("_length")).agg(F.count("*").alias("copies")).drop("_length")
        return distinct.join(by_name.hint("merge"), distinct["query"] == by_name["name"]).drop("name")
    listed = per_report.join(names.select("name"), per_report["query"] == F.col("name"), "left_semi")
    return listed.distinct().withColumn("copies", F.lit(1).cast("bigint"))


def _include_series(mode: str) -> Column:
    """Does the report's own policy include another one (FLT6); null where that is not known (Q10).

    Strict mode looks for the word in a policy that is a text. Reference mode follows the published analysis through
    every type: it asks lists and maps for the word, too, and the report is in neither series where that fails.
    """
    word = F.lit("include:")
    own = F.filter("expanded", lambda e: e["domain"] == F.col("query"))
    spf = js.field(F.get(own, F.lit(0))["entry"], "spf")
    if is_reference(mode):
        # Asked of a text or a list, the query is there or not; then it would have to be a key.
        elsewhere = js.contains(F.col("unexpanded"), F.col("query"))
        found = (
            F.when(F.col("unexpanded").isNotNull(), F.when(~elsewhere, False))
            .when(F.size(own) > 0, js.let(spf, lambda policy: js.contains(policy, word)))
            .otherwise(False)
        )
    else:
        found = F.coalesce(F.contains(js.text(spf), word), F.lit(False))
    series = F.when(found, "include_present").when(~found, "include_absent")
    return F.when(F.col("lookups").isNotNull(), series)


def _all_messages(kind: str) -> Column:
    """Messages of all expanded entries in one array, null as soon as one entry has no list of texts of that kind."""
    return F.flatten(F.transform("expanded", lambda e: js.texts(js.field(e["entry"], kind))))


_VERDICTS = ("pass", "fail", "softfail", "neutral")


def _missing_address(mode: str) -> Column:
    """Does any verdict of any expanded entry name a host without addresses (FLT7)?

    Reference mode goes through the verdicts in order and stops at an empty list of addresses (yes) or where the published
    analysis fails (no): at an entry, a verdict or a host that cannot be asked, or a host without such a list. Strict mode
    looks at every verdict, and takes a host without a list as one without addresses.
    """
    if is_reference(mode):
        answers = F.flatten(F.transform("expanded", lambda e: _asked(e["entry"])))
        return F.coalesce(F.get(F.array_compact(answers), F.lit(0)), F.lit(False))

    def bare(entry: Column, verdict: str) -> Column:
        host = js.field(js.field(entry, verdict), "a")
        return js.is_object(host) & (F.coalesce(F.size(js.array(js.field(host, "ips"))), F.lit(0)) == 0)

    anywhere = F.exists("expanded", lambda e: F.exists(F.array(*[bare(e["entry"], v) for v in _VERDICTS]), lambda x: x))
    return F.coalesce(anywhere, F.lit(False))


def _asked(entry: Column) -> Column:
    """For each verdict of an entry: True if it names a host with an empty list of addresses, False if asking for it fails, null to go on."""
    def fails_at(value: Column, word: str) -> Column:
        # A text or a list that holds the word fails when its item of that name is asked for, a null or a number at once.
        return F.when(F.coalesce(js.contains(value, F.lit(word)), F.lit(True)), False)

    def of_host(host: Column, value: Column) -> Column:
        found = js.let(js.is_empty(js.field(host, "ips")), lambda empty: F.when(empty, True).when(empty.isNull(), False))
        return F.when(host.isNotNull(), found).when(~js.is_object(value), fails_at(value, "a"))

    def of_verdict(value: Column) -> Column:
        return F.when(value.isNotNull(), js.let(js.field(value, "a"), lambda host: of_host(host, value)))

    def of_object(verdict: str) -> Column:
        return js.let(js.field(entry, verdict), of_verdict)

    asked = F.array(*[of_object(v) for v in _VERDICTS])
    return F.when(js.is_object(entry), asked).otherwise(F.array(*[fails_at(entry, v) for v in _VERDICTS]))


def messages(reports: DataFrame, kind: str) -> DataFrame:
    """``query, line_id, domains``: messages of a report by expanded domain, as an array of ``domain, messages``.

    ``kind`` is ``errors`` or ``warnings``; reports with an entry that lacks the kind are left out. ``domains`` is an
    array so that rows can be made distinct by ``restrict``.
    """
    parsed = select_once(reports, _domains=_domains(kind)).select("query", "line_id", _if_complete("_domains").alias("domains"))
    return parsed.where(F.col("domains").isNotNull())


KINDS = ("errors", "warnings")


def facts_with_messages(reports: DataFrame, mode: str = STRICT) -> DataFrame:
    """``facts``, and the ``domains`` of ``messages`` of both kinds as ``errors`` and ``warnings``, null for reports that ``messages`` leaves out.

    One parse serves the tally and both kinds of lines; ``messages_of`` takes the rows of a kind from what is stored of it.
    """
    parsed = select_once(reports, **{f"_{kind}": _domains(kind) for kind in KINDS})
    return facts(parsed, mode, *[_if_complete(f"_{kind}").alias(kind) for kind in KINDS])


def messages_of(per_report: DataFrame, kind: str) -> DataFrame:
    """Rows of ``messages``, with ``copies`` where there is such a column, from ``facts_with_messages``."""
    carried = [c for c in ("query", "line_id", "copies") if c in per_report.columns]
    return per_report.where(F.col(kind).isNotNull()).select(*carried, F.col(kind).alias("domains"))


def _domains(kind: str) -> Column:
    return F.transform(
        "expanded", lambda e: F.struct(e["domain"].alias("domain"), js.texts(js.field(e["entry"], kind)).alias("messages"))
    )


def _if_complete(domains: str) -> Column:
    """The array, null where an entry lacks the kind."""
    return F.when(F.forall(domains, lambda d: d["messages"].isNotNull()), F.col(domains))


def message_rows(per_report: DataFrame) -> DataFrame:
    """``query, domain, message`` rows of ``messages`` (D19)."""
    domains = per_report.select("query", F.inline("domains"))
    return domains.select("query", "domain", F.explode("messages").alias("message"))


def outcomes(per_report: DataFrame) -> DataFrame:
    """``counter, n`` for the outcomes and the reports over the lookup limit (AGG15-19)."""
    counted = [
        F.coalesce(F.sum(F.when(F.col("outcome") == c, F.col("copies"))), F.lit(0)).alias(c) for c in COUNTERS[:-1]
    ]
    over = F.coalesce(F.sum(F.when(F.col("lookups") > LOOKUP_LIMIT, F.col("copies"))), F.lit(0))
    return per_report.agg(*counted, over.alias(COUNTERS[-1])).unpivot([], COUNTERS, "counter", "n")


def _series(per_report: DataFrame) -> DataFrame:
    known = per_report.where(F.col("lookups").isNotNull())
    series = F.array_compact(F.array(F.lit("all"), "include_series"))
    return known.select(F.explode(series).alias("series"), "lookups", "copies")


def lookup_histogram(per_report: DataFrame) -> DataFrame:
    """``series, lookups, n`` for all reports and for those with and without an include (AGG20-22)."""
    return _series(per_report).groupBy("series", "lookups").agg(F.sum("copies").alias("n"))


def _count_classes(per_report: DataFrame, column: str, alias: str) -> DataFrame:
    return (
        per_report.select(F.explode(column).alias(alias), "copies").groupBy(alias).agg(F.sum("copies").alias("n"))
    )


def error_classes(per_report: DataFrame) -> DataFrame:
    """``class, n``: reports that have each error class (AGG23)."""
    return _count_classes(per_report, "error_classes", "class")


def warning_classes(per_report: DataFrame) -> DataFrame:
    """``class, n``: reports that have each warning class (AGG24)."""
    return _count_classes(per_report, "warning_classes", "class")


def error_labels(per_report: DataFrame, mode: str = STRICT) -> DataFrame:
    """Reported error labels (MSR5): ``label, class, n`` in reference mode, ``label, n`` in strict mode (Q19)."""
    return _count_labels(per_report, "error_classes", msg.error_label, mode)


def warning_labels(per_report: DataFrame, mode: str = STRICT) -> DataFrame:
    """Reported warning labels (MSR6), as ``error_labels``."""
    return _count_labels(per_report, "warning_classes", msg.warning_label, mode)


def _count_labels(per_report: DataFrame, column: str, label, mode: str) -> DataFrame:
    if is_reference(mode):
        classes = _count_classes(per_report, column, "class")
        return classes.select(label(F.col("class")).alias("label"), "class", "n").where(F.col("label").isNotNull())
    labels = F.array_distinct(F.filter(F.transform(column, label), lambda x: x.isNotNull()))
    return _count_classes(per_report.select(labels.alias("labels"), "copies"), "labels", "label")


def missing_address(per_report: DataFrame) -> DataFrame:
    """``n``: reports with a host without addresses (AGG25)."""
    hits = F.sum(F.when(F.col("missing_address"), F.col("copies")))
    return per_report.agg(F.coalesce(hits, F.lit(0)).alias("n"))


def tally(per_report: DataFrame) -> DataFrame:
    """All counts above in one pass: ``section, item, n``.

    Each report becomes the list of the things it counts for, so that the scan, the distinct step and the join run once
    for the whole evaluation and one aggregation does the rest. Sections: ``outcome``, ``lookups_<series>`` with the
    lookup count as item, ``error_class``, ``warning_class``, ``missing_address``.
    """
    def one(section: str | Column, item: Column, when: Column) -> Column:
        section = F.lit(section) if isinstance(section, str) else section
        return F.when(when, F.struct(section.alias("section"), item.cast("string").alias("item")))

    def each(section: str, column: str) -> Column:
        return F.transform(
            F.coalesce(column, F.array().cast("array<string>")),
            lambda c: F.struct(F.lit(section).alias("section"), c.alias("item")),
        )

    known = F.col("lookups").isNotNull()
    single = F.array(
        one("outcome", F.col("outcome"), F.col("outcome").isNotNull()),
        one("outcome", F.lit(COUNTERS[-1]), F.col("lookups") > LOOKUP_LIMIT),
        one("lookups_all", F.col("lookups"), known),
        one(F.concat(F.lit("lookups_"), "include_series"), F.col("lookups"), F.col("include_series").isNotNull()),
        one("missing_address", F.lit("records"), F.col("missing_address")),
    )
    things = F.concat(
        F.array_compact(single), each("error_class", "error_classes"), each("warning_class", "warning_classes")
    )
    return (
        per_report.select(F.inline(things), "copies")
        .groupBy("section", "item")
        .agg(F.sum("copies").alias("n"))
    )
