"""Evaluation outcomes, error and warning classes, lookup-count curves."""

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailpolicy import session, sinks
from mailpolicy.functions.messages import error_label, warning_label
from mailpolicy.modes import STRICT, is_reference
from mailpolicy.operators import curves, reports
from mailpolicy.sources.reports import read_names, read_reports


def run(
    spark: SparkSession, report_paths: str | list[str], name_paths: str | list[str], out: str, mode: str = STRICT,
    write_messages: bool = False,
) -> dict[str, DataFrame]:
    """One pass over the reports fills ``out/tally``; everything else is read back from that small table.

    ``write_messages`` also writes the per-report message maps. Then the pass fills ``out/reports``, a row for each report that counts with what is
    asked of it and its messages; tally and lines read their columns of it.
    """
    parsed, names = read_reports(spark, report_paths), read_names(spark, name_paths, mode)
    if write_messages:
        counting = reports.restrict(reports.facts_with_messages(parsed, mode), names, mode)
        counting.write.mode("overwrite").parquet(f"{out}/reports")
        counting = spark.read.schema(counting.schema).parquet(f"{out}/reports")
    else:
        counting = reports.restrict(reports.facts(parsed, mode), names, mode)
    counted = reports.tally(counting)
    counted.write.mode("overwrite").partitionBy("section").parquet(f"{out}/tally")
    stored = spark.read.schema("item string, n bigint, section string").parquet(f"{out}/tally")

    histogram = stored.where(F.startswith("section", F.lit("lookups_"))).select(
        F.substr("section", F.lit(len("lookups_") + 1)).alias("series"), F.col("item").cast("bigint").alias("lookups"), "n"
    )
    sinks.write_histogram(histogram, f"{out}/lookup_histogram")
    curve = curves.cdf(histogram, "lookups", by=["series"], weight="n")
    for series in ("include_absent", "include_present"):
        sinks.write_cdf(curve.where(F.col("series") == series), f"{out}/cdf_{series}")
    if write_messages:
        for kind in reports.KINDS:
            kept = reports.messages_of(counting, kind)
            # In strict mode each report is one line: without the column nothing is spread, so no further shuffle.
            sinks.write_messages(kept if is_reference(mode) else kept.drop("copies"), f"{out}/{kind}")

    def items(section: str) -> DataFrame:
        return stored.where(F.col("section") == section).select("item", "n")

    return {
        "outcomes": items("outcome"),
        "error_classes": items("error_class").withColumn("label", error_label(F.col("item"))),
        "warning_classes": items("warning_class").withColumn("label", warning_label(F.col("item"))),
        "missing_address": items("missing_address"),
        "lookup_cdf": curve,
    }


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--reports", nargs="+", required=True)
    parser.add_argument("--names", nargs="+", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--mode", default=STRICT)
    parser.add_argument("--write-messages", action="store_true")
    args = parser.parse_args()
    spark = session.builder("evaluation-report").getOrCreate()
    results = run(spark, args.reports, args.names, args.out, args.mode, args.write_messages)
    for name, table in results.items():
        print(name)
        table.show(100, truncate=False)


if __name__ == "__main__":
    main()
