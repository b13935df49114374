"""The stored deployment summary (SRC9)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "tld string, metric string, n bigint, snapshot_date date"


def read_summary(spark: SparkSession, path: str, snapshot_dates: list[str] | None = None) -> DataFrame:
    """Long summary table; a choice of snapshots prunes the partitions that are read. Rows that only mark a snapshot are left out."""
    summary = spark.read.schema(SCHEMA).parquet(path).where(F.col("metric").isNotNull())
    return _of_dates(summary, snapshot_dates).select("snapshot_date", "tld", "metric", "n")


def read_multiple_policies(spark: SparkSession, path: str, snapshot_dates: list[str] | None = None) -> DataFrame:
    """Stored names with several policies: ``snapshot_date, name, n_policies``."""
    names = spark.read.schema("name string, n_policies int, snapshot_date date").parquet(path).where(F.col("name").isNotNull())
    return _of_dates(names, snapshot_dates).select("snapshot_date", "name", "n_policies")


def _of_dates(rows: DataFrame, snapshot_dates: list[str] | None) -> DataFrame:
    return rows if snapshot_dates is None else rows.where(F.col("snapshot_date").isin([F.lit(d).cast("date") for d in snapshot_dates]))
