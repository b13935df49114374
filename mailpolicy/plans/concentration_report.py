"""How include targets concentrate, over all policies and over those above the lookup limit."""

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailpolicy import session, sinks
from mailpolicy.modes import STRICT
from mailpolicy.operators import curves
from mailpolicy.sources.counts import read_include_counts


def run(spark: SparkSession, variants: dict[str, str], out: str, mode: str = STRICT) -> DataFrame:
    """``variants`` maps a variant's name to its count file; all curves are drawn in one job."""
    totals = [
        curves.include_totals(read_include_counts(spark, path), mode).withColumn("variant", F.lit(name))
        for name, path in variants.items()
    ]
    curve = curves.concentration(reduce(DataFrame.unionByName, totals), "n", by=["variant"])
    sinks.write_concentration(curve, out)
    return spark.read.schema("idx bigint, value bigint, share double, variant string").option("sep", " ").csv(out)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--counts", nargs=2, action="append", required=True, metavar=("VARIANT", "PATH"))
    parser.add_argument("--out", required=True)
    parser.add_argument("--mode", default=STRICT)
    args = parser.parse_args()
    spark = session.builder("concentration-report").getOrCreate()
    run(spark, dict(args.counts), args.out, args.mode).orderBy("variant", "idx").show(100)


if __name__ == "__main__":
    main()
