"""Policy evaluator reports and the list of names they are restricted to (SRC3, SRC4)."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailpolicy.functions import jsonvalues as js
from mailpolicy.functions.names import drop_last, strip_dot
from mailpolicy.functions.text import select_once, strip
from mailpolicy.modes import STRICT, is_reference


def read_reports(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_reports(spark.read.text(paths))


def parse_reports(lines: DataFrame) -> DataFrame:
    """Report lines → ``query, line_id, error, lookups, expanded, unexpanded``; lines without a query that is a string are left out.

    ``line_id`` is a digest of the whole line. It stands for the text where exact copies of a line are taken out, so
    that a shuffle moves 32 bytes and not the report. ``error`` is null unless the report holds a text there, ``lookups``
    unless it holds a whole number. ``expanded`` is the map of the report as an array of ``domain, entry`` in the line's order, each
    domain once; ``unexpanded`` is what the report has there if it is no map, null if it has nothing.
    """
    parsed = js.with_value(
        lines, "struct<query variant, error variant, lookups variant, expanded map<string, variant>>", "{}", value=F.col("value")
    )
    report = F.col("_value")
    expanded = report["expanded"]
    # Most lines without a map are short: they are read once more, to tell what is there.
    other = F.when(report.isNotNull() & expanded.isNull(), js.field_of_line(F.col("value"), "expanded"))
    return select_once(
        parsed,
        _query=js.text(report["query"]),
        _line=F.unhex(F.sha2("value", 256)),
        _error=js.text(report["error"]),
        _lookups=js.whole_number(report["lookups"]),
        _expanded=_entries(expanded),
        _other=other,
    ).where(F.col("_query").isNotNull()).select(
        F.col("_query").alias("query"),
        F.col("_line").alias("line_id"),
        F.col("_error").alias("error"),
        F.col("_lookups").alias("lookups"),
        F.col("_expanded").alias("expanded"),
        F.col("_other").alias("unexpanded"),
    )


def _entries(expanded: Column) -> Column:
    """Of equal keys the first one's place and the last one's value, as in a dictionary of the published analysis."""
    def entry(domain: Column, value: Column) -> Column:
        return F.struct(domain.alias("domain"), value.alias("entry"))

    entries = F.transform(F.map_entries(expanded), lambda e: entry(e["key"], e["value"]))
    domains = F.array_distinct(F.map_keys(expanded))
    last = F.transform(domains, lambda d: entry(d, F.element_at(F.filter(entries, lambda e: e["domain"] == d), -1)["entry"]))
    return F.when(F.size(domains) == F.size(entries), entries).otherwise(last)


def report_rejects(lines: DataFrame) -> DataFrame:
    """The lines that ``parse_reports`` leaves out, as they came."""
    parsed = js.with_value(lines, "struct<query variant>", "{}", value=F.col("value"))
    return parsed.where(js.text(F.col("_value")["query"]).isNull()).drop("_value")


def read_names(spark: SparkSession, paths: str | list[str], mode: str = STRICT) -> DataFrame:
    return parse_names(spark.read.text(paths), mode)


def parse_names(lines: DataFrame, mode: str = STRICT) -> DataFrame:
    """Lines of a name list → ``name``; reference mode drops the last character even if it is not a dot (Q9)."""
    written = strip(F.col("value"))
    name = drop_last(written) if is_reference(mode) else strip_dot(written)
    return lines.select(name.alias("name"))
