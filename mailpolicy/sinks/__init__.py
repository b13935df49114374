"""Writers (SNK1-6). Each takes a result DataFrame and a directory and overwrites what a rerun would repeat."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_summary(summary_table: DataFrame, path: str) -> None:
    """Long deployment summary, one partition per snapshot; a rerun replaces its own snapshots only (SNK1, Q8)."""
    (
        summary_table.repartition("snapshot_date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot_date")
        .parquet(path)
    )


def write_multiple_policies(names: DataFrame, path: str) -> None:
    """Names with several policies, one partition per snapshot; a rerun replaces its own snapshots only."""
    names.hint("rebalance", "snapshot_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)


def write_wide_summary(wide: DataFrame, path: str) -> None:
    """Wide summary lines, fields separated by a space, snapshots in order (SNK1)."""
    summary_lines(wide.orderBy("snapshot_date")).write.mode("overwrite").text(path)


def summary_lines(wide: DataFrame) -> DataFrame:
    """``value``: the rows of the wide summary as text (D10)."""
    return _spaced(wide)


def write_histogram(histogram: DataFrame, path: str) -> None:
    """Lookup-count histogram (SNK2)."""
    histogram.write.mode("overwrite").parquet(path)


def write_cdf(curve: DataFrame, path: str) -> None:
    """``value share`` lines in rising order (SNK3)."""
    _write_lines(curve.orderBy("value").select("value", "cdf"), path)


def write_concentration(curve: DataFrame, path: str) -> None:
    """``idx value share`` lines in the order of the curve, in a directory per variant if there are several (SNK4)."""
    lines = curve.select(*[c for c in ("variant", "idx", "value", "share") if c in curve.columns])
    if "variant" in lines.columns:
        ordered = lines.repartitionByRange("variant", "idx").sortWithinPartitions("variant", "idx")
        ordered.write.mode("overwrite").partitionBy("variant").option("sep", " ").csv(path)
    else:
        _write_lines(lines.orderBy("idx"), path)


_COPIES = 1000


def write_messages(per_report: DataFrame, path: str) -> None:
    """``message_lines`` of ``reports.messages`` (SNK5)."""
    message_lines(per_report).write.mode("overwrite").text(path)


def message_lines(per_report: DataFrame) -> DataFrame:
    """``value``: ``query {domain: [message…]}`` lines, each as often as its report counts.

    Copies are made in chunks that are spread over the tasks in between, so that a report that counts very often is
    written by many of them.
    """
    line = F.concat_ws(" ", "query", F.to_json(F.map_from_entries("domains")))
    lines = per_report.select(line.alias("value"), *[c for c in per_report.columns if c == "copies"])
    if "copies" in lines.columns:
        chunks = lines.select("*", F.expr(f"explode(sequence(0L, (copies - 1) div {_COPIES})) AS chunk")).hint("rebalance")
        copies = F.expr(f"sequence(1L, least({_COPIES}L, copies - chunk * {_COPIES}))")
        lines = chunks.select("value", F.explode(copies)).select("value")
    return lines


def write_server_totals(totals: DataFrame, path: str) -> None:
    """``server_id max_total void_total`` lines (SNK6)."""
    server_total_lines(totals).write.mode("overwrite").text(path)


def server_total_lines(totals: DataFrame) -> DataFrame:
    """``value``: the totals as text."""
    return _spaced(totals.select("server_id", "max_total", "void_total"))


def _spaced(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value"))


def _write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", " ").csv(path)
