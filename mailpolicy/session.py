"""Session settings this library is tuned for."""

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # splits a name with very many reports even where that costs the distinct step after the join a shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # partitions that see no new snapshot keep their files on a rerun
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def builder(app_name: str = "mailpolicy") -> SparkSession.Builder:
    """A session builder with the settings above; master and sizes are left to ``spark-submit``."""
    b = SparkSession.builder.appName(app_name)
    for key, value in SETTINGS.items():
        b = b.config(key, value)
    return b
