"""Whitespace-separated count tables (SRC7, SRC8)."""

import functools
import operator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailpolicy.functions.text import select_once, tokens


def read_include_counts(spark: SparkSession, path: str) -> DataFrame:
    """File of ``ind domain number`` lines, with ``line_no`` rising in the order of the file."""
    return parse_include_counts(_numbered(spark, path))


def read_include_count_rejects(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, value`` of the lines that ``read_include_counts`` leaves out."""
    return include_count_rejects(_numbered(spark, path))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("line_no"),
    )


def parse_include_counts(lines: DataFrame) -> DataFrame:
    """Lines → ``ind, domain, n``; ``ind`` is text, as nothing counts with it.

    Lines without exactly three fields or whose number is none are left out; ``include_count_rejects`` has them.
    """
    return _table(lines, ind="string", domain="string", n="bigint")


def include_count_rejects(lines: DataFrame) -> DataFrame:
    """The lines that ``parse_include_counts`` leaves out, as they are."""
    return _rejects(lines, ind="string", domain="string", n="bigint")


def read_server_counts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_server_counts(spark.read.text(paths))


def parse_server_counts(lines: DataFrame) -> DataFrame:
    """Lines ``key total void`` → ``server_id, total, void``; ``server_count_rejects`` has the others."""
    return _table(lines, server_id="string", total="bigint", void="bigint")


def server_count_rejects(lines: DataFrame) -> DataFrame:
    """The lines that ``parse_server_counts`` leaves out, as they are."""
    return _rejects(lines, server_id="string", total="bigint", void="bigint")


def _table(lines: DataFrame, **types: str) -> DataFrame:
    carried = [c for c in lines.columns if c != "value"]
    return _parsed(lines, types).dropna(subset=list(types)).select(*carried, *types)


def _rejects(lines: DataFrame, **types: str) -> DataFrame:
    missing = [F.col(c).isNull() for c in types]
    return _parsed(lines, types).where(functools.reduce(operator.or_, missing)).select(*lines.columns)


def _parsed(lines: DataFrame, types: dict[str, str]) -> DataFrame:
    split = select_once(lines, _fields=tokens(F.col("value")))
    columns = {
        name: F.when(F.size("_fields") == len(types), F.get("_fields", F.lit(i)).try_cast(t))
        for i, (name, t) in enumerate(types.items())
    }
    return select_once(split, **columns)
