"""Policy deployment and mechanism use per zone, and their change between two snapshots."""

import argparse
from datetime import date as date_type
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailpolicy import session, sinks
from mailpolicy.modes import STRICT
from mailpolicy.operators import deployment, terms
from mailpolicy.sources import inputs, scans, summary


def run(
    spark: SparkSession,
    snapshots: list[tuple[str, str, str]],
    out: str,
    mode: str = STRICT,
    zones: list[str] | None = None,
    incremental: bool = False,
) -> dict[str, DataFrame]:
    """``snapshots`` are ``(date, TXT path, MX path)``; all of them are summarised in one job.

    ``zones`` limits the top-level domains before anything is shuffled. The summary is written once and the reports are read back from it, a few rows per top-level domain.
    An ``incremental`` run reads only snapshots whose files, mode or zones are not those of the last run to ``out``, and takes the others from what
    is stored there. What a run replaces is marked as unfinished first, so that one that is cut short is made up for by the next.
    """
    snapshots = [(str(date_type.fromisoformat(date)), txt, mx) for date, txt, mx in snapshots]
    of_date: dict[str, list[str]] = {}
    for date, *paths in snapshots:
        of_date.setdefault(date, []).extend(paths)
    # Listed before anything is read: what changes in between is read again next time.
    marks = inputs.marks(spark, of_date, f"{mode}, {'all' if zones is None else sorted(set(zones))}")
    known = inputs.read_marks(spark, f"{out}/inputs") if incremental else {}
    fresh = [s for s in snapshots if known.get(s[0]) != marks[s[0]]]
    if fresh:
        dates = sorted({date for date, _, _ in fresh})
        inputs.write_marks(spark, dict.fromkeys(dates, "unfinished"), f"{out}/inputs")
        spf = reduce(DataFrame.unionByName, [scans.read_spf(spark, txt, date, mode) for date, txt, _ in fresh])
        mx = reduce(DataFrame.unionByName, [scans.read_mx(spark, mx, date, mode) for date, _, mx in fresh])
        # A row that only names the snapshot: one that has become empty replaces what is stored of it, too.
        only = spark.range(1).select(F.explode(F.array(*[F.lit(d).cast("date") for d in dates])).alias("snapshot_date"))
        found = deployment.summary(spf, mx, mode, zones)
        sinks.write_summary(found.unionByName(only, allowMissingColumns=True), f"{out}/summary")
        several = terms.multiple_policies(spf, mode).select("snapshot_date", "name", "n_policies")
        sinks.write_multiple_policies(several.unionByName(only, allowMissingColumns=True), f"{out}/multiple_policies")
        inputs.write_marks(spark, {d: marks[d] for d in dates}, f"{out}/inputs")

    dates = sorted(of_date)
    stored = summary.read_summary(spark, f"{out}/summary", dates)
    sinks.write_wide_summary(deployment.wide(stored), f"{out}/summary_wide")
    return {
        "table1": deployment.table1(summary.read_summary(spark, f"{out}/summary", dates[-1:])),
        "table2": deployment.share_change(stored, dates[0], dates[-1]),
        "multiple_policies": summary.read_multiple_policies(spark, f"{out}/multiple_policies", dates),
    }


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--snapshot", nargs=3, action="append", required=True, metavar=("DATE", "TXT", "MX"))
    parser.add_argument("--out", required=True)
    parser.add_argument("--mode", default=STRICT)
    parser.add_argument("--zones", nargs="+", metavar="TLD")
    parser.add_argument("--incremental", action="store_true", help="read only snapshots that have changed since the last run to OUT")
    args = parser.parse_args()
    spark = session.builder("deployment-report").getOrCreate()
    tables = run(spark, [tuple(s) for s in args.snapshot], args.out, args.mode, args.zones, args.incremental)
    for name, table in tables.items():
        print(name)
        table.show(100, truncate=False)


if __name__ == "__main__":
    main()
