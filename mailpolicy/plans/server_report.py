"""Queries per scanned server and servers without lookup limits."""

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailpolicy import session, sinks
from mailpolicy.modes import STRICT
from mailpolicy.operators import curves, probes
from mailpolicy.sources import querylog


def run(
    spark: SparkSession, log_paths: list[str], ids_path: str, domain: str, out: str, mode: str = STRICT,
    until: str | None = None, previous: str | None = None,
) -> dict[str, DataFrame]:
    """The log is read once and meets the labels once, in a table of its probe labels; the rest comes from that table.

    ``until`` leaves out log lines of that date and later. ``ambiguous`` is the number of labels strict mode leaves out;
    it is not worked out before it is asked for. ``previous`` is the ``out`` of an earlier run with the same ids and mode over
    other logs: its servers and line counts are merged in, and its logs are not read again. As every run writes a state of its
    own, a repeated run counts nothing twice.
    """
    ids = querylog.read_ids(spark, ids_path)
    log = querylog.parse_all(querylog.read_log_lines(spark, log_paths), until)
    labels = _stored(probes.matched(_stored(probes.label_counts(log, domain, mode), f"{out}/label_counts"), ids, mode), f"{out}/labels")

    state, funnel = probes.state(labels, ids, mode), probes.funnel(labels, ids, mode)
    if previous is not None:
        state = probes.merged(state, spark.read.schema(state.schema).parquet(f"{previous}/state"))
        funnel = _summed(funnel.unionByName(spark.read.schema(funnel.schema).parquet(f"{previous}/funnel")))
    funnel = _stored(funnel, f"{out}/funnel")
    servers = _stored(probes.of_state(_stored(state, f"{out}/state")), f"{out}/servers")

    totals = probes.max_totals(servers)
    sinks.write_server_totals(totals, f"{out}/server_totals")
    curve = curves.cdf(probes.server_series(totals), "value", by=["series"])
    for series in ("total", "void"):
        sinks.write_cdf(curve.where(F.col("series") == series), f"{out}/cdf_{series}")
    return {
        "scanned": probes.scanned(ids),
        "funnel": funnel,
        "ambiguous": probes.ambiguous_labels(ids),
        "limits": probes.limits(servers, mode),
        "server_cdf": curve,
    }


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _summed(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.sum(c).alias(c) for c in rows.columns])


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--logs", nargs="+", required=True)
    parser.add_argument("--ids", required=True)
    parser.add_argument("--domain", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--mode", default=STRICT)
    parser.add_argument("--until", metavar="DATE")
    parser.add_argument("--previous", metavar="OUT", help="out folder of an earlier run over other logs, to be merged in")
    args = parser.parse_args()
    spark = session.builder("server-report").getOrCreate()
    for name, table in run(spark, args.logs, args.ids, args.domain, args.out, args.mode, args.until, args.previous).items():
        print(name)
        table.show(100, truncate=False)


if __name__ == "__main__":
    main()
