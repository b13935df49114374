"""What the files of an input were when it was read, so that a later run can tell whether they have changed."""

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKS = "mark string, snapshot_date date"


def marks(spark: SparkSession, paths: dict[str, list[str]], settings: str = "") -> dict[str, str]:
    """A text for each snapshot that changes when a file of its paths comes, goes or is written anew, or when ``settings`` do.

    Paths, lengths and times of the files are listed and added up by tasks; no file is opened. Two writes of equal length within the
    file system's resolution of time are not told apart.
    """
    found = {}
    if paths:
        # The position of a path counts as well: TXT and MX files must not change places unnoticed.
        listed = [
            spark.read.format("binaryFile").load(path).select(F.lit(date).alias("date"), F.lit(i).alias("place"), "path", "modificationTime", "length")
            for date, of_date in paths.items()
            for i, path in enumerate(of_date)
        ]
        number = F.xxhash64("place", "path", "modificationTime", "length")
        rows = reduce(DataFrame.unionAll, listed).groupBy("date").agg(
            F.count("*").alias("files"), F.sum("length").alias("bytes"), F.sum(number.cast("decimal(38,0)")).alias("sum"), F.bit_xor(number).alias("xor")
        )
        found = {r["date"]: f"{r['files']} files, {r['bytes']} bytes, {r['sum']} {r['xor']}" for r in rows.collect()}  # a row for each snapshot
    return {date: f"{found.get(date, '0 files')}; {settings}" for date in paths}


def read_marks(spark: SparkSession, path: str) -> dict[str, str]:
    """Stored marks, a row for each snapshot; none if nothing is stored."""
    try:
        rows = spark.read.schema(MARKS).parquet(path).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return {str(r["snapshot_date"]): r["mark"] for r in rows}


def write_marks(spark: SparkSession, found: dict[str, str], path: str) -> None:
    """Stores marks, in a partition for each snapshot; those of other snapshots stay."""
    rows = spark.createDataFrame(list(found.items()), "date string, mark string")
    rows = rows.select("mark", F.col("date").cast("date").alias("snapshot_date")).coalesce(1)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)
