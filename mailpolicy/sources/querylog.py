"""DNS server query logs and the list of scanned servers (SRC5, SRC6)."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailpolicy.functions import jsonvalues as js
from mailpolicy.functions.text import select_once, tokens

# Log words that carry no field, and the numbers of tokens of the known formats.
NOISE = ["query:", "info:", "client", "view", "standard:", "queries:"]
TOKEN_COUNTS = [10, 12]


def read_log_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All lines of all files of the given directories (SET5)."""
    return spark.read.text(paths)


def read_query_log(spark: SparkSession, paths: str | list[str], until: str | None = None) -> DataFrame:
    """The readable lines of all files of the given directories, as ``parse_log``."""
    return parse_log(read_log_lines(spark, paths), until)


def parse_log(lines: DataFrame, until: str | None = None) -> DataFrame:
    """Log lines → ``ts_text, qname, rr_type, client_ip, flags`` (D11), other columns carried along.

    Lines of another format or with an impossible date (FLT9) are left out, see ``log_rejects``. ``until`` keeps dates
    before it.
    """
    carried = [c for c in lines.columns if c != "value"]
    split = _before(_split_lines(lines).where(F.col("_date").isNotNull()), until)
    return split.select(*carried, *_fields())


def log_rejects(lines: DataFrame) -> DataFrame:
    """The lines ``parse_log`` cannot read, as they came (Q18)."""
    return _split_lines(lines).where(F.col("_date").isNull()).drop("_tokens", "_date")


def _before(split: DataFrame, until: str | None) -> DataFrame:
    """Lines of dates before ``until``, and those without a date."""
    if until is None:
        return split
    return split.where(F.coalesce(F.col("_date") < F.lit(until).cast("date"), F.lit(True)))


def parse_all(lines: DataFrame, until: str | None = None) -> DataFrame:
    """As ``parse_log``, with unreadable lines kept: their fields are null."""
    carried = [c for c in lines.columns if c != "value"]
    readable = F.col("_date").isNotNull()
    fields = [F.when(readable, f).alias(n) for f, n in zip(_fields(), FIELDS)]
    return _before(_split_lines(lines), until).select(*carried, *fields)


FIELDS = ["ts_text", "qname", "rr_type", "client_ip", "flags"]


def _split_lines(lines: DataFrame) -> DataFrame:
    """Add the field tokens of a line and its date, null where the line is unreadable."""
    split = select_once(lines, _tokens=tokens(F.col("value"), without=NOISE))
    known = F.size("_tokens").isin(*TOKEN_COUNTS)
    # month names are read in any case
    day, month, year = (F.split_part(_token(0), F.lit("-"), F.lit(i)) for i in (1, 2, 3))
    written = F.concat_ws("-", day, F.initcap(month), year)
    date = F.to_date(F.try_to_timestamp(written, F.lit("d-MMM-yyyy")))
    return select_once(split, _date=F.when(known, date))


def _token(i: int) -> Column:
    return F.get("_tokens", F.lit(i))


def _fields() -> list[Column]:
    return [
        F.concat_ws(" ", _token(0), _token(1)).alias("ts_text"),
        _token(5).alias("qname"),
        _token(7).alias("rr_type"),
        F.split_part(_token(3), F.lit("#"), F.lit(1)).alias("client_ip"),
        _token(8).alias("flags"),
    ]


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array of server ids → ``pos, id``, ``pos`` counting from 0 (Q13 needs the order).

    The file is cut at its commas and not read as one value, so that it splits over tasks (a gzip file is one task by
    nature). Which commas stand within strings is worked out by ``number_ids``.
    """
    return number_ids(
        spark.read.option("lineSep", ",").text(path).select(
            "value",
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("row"),
        )
    )


def number_ids(texts: DataFrame) -> DataFrame:
    """Pieces ``value, split, row`` of a JSON array of strings, as they are between its commas → ``pos, id``.

    A piece begins within a string if the quotes before it, without escaped ones, are odd in number. An escape holds no
    comma, so each piece's quotes are counted alone; they are summed by ``row`` within a split, and from one row a split over the
    splits before it. The same way pieces that begin outside of strings are counted, which gives an element's position;
    its pieces are put together by that. A null keeps its position, and is no id; any other element that is no string, and an
    odd number of quotes, end the run with an error, so that no id is lost and no position shifts.
    """
    bare = F.when(F.contains("value", F.lit("\\")), F.regexp_replace("value", r"(?s)\\.", "")).otherwise(F.col("value"))
    quotes = F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))
    in_split = Window.partitionBy("split").orderBy("row")
    before = in_split.rowsBetween(Window.unboundedPreceding, -1)
    pieces = select_once(texts, _quotes=quotes).withColumn("_odd", F.coalesce(F.sum("_quotes").over(before), F.lit(0)) % 2)

    # Of each split: its quotes, and the pieces that begin outside of strings if the split itself begins outside or inside.
    splits = pieces.groupBy("split").agg(
        F.sum("_quotes").alias("quotes"), F.count_if(F.col("_odd") == 0).alias("outside"), F.count_if(F.col("_odd") == 1).alias("inside")
    )
    splits_before = Window.partitionBy(F.lit(0)).orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    # With an odd quote somewhere the rest of the array would be one string.
    paired = F.sum("quotes").over(Window.partitionBy(F.lit(0))) % 2 == 0
    start = F.when(paired, F.coalesce(F.sum("quotes").over(splits_before), F.lit(0)) % 2)
    splits = splits.withColumn("_start", start.otherwise(F.raise_error(F.lit("not one string of a JSON array: quotes do not pair"))))
    begun = F.sum(F.when(F.col("_start") == 0, F.col("outside")).otherwise(F.col("inside"))).over(splits_before)
    splits = splits.select("split", "_start", F.coalesce(begun, F.lit(0)).alias("_begun"))

    placed = pieces.join(splits.hint("merge"), "split")
    begins = F.count_if(F.col("_odd") == F.col("_start")).over(in_split.rowsBetween(Window.unboundedPreceding, 0))
    parts = placed.select((F.col("_begun") + begins - 1).alias("pos"), "split", "row", "value")
    elements = parts.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("split", "row", "value"))).alias("_parts"))
    text = F.array_join(F.transform("_parts", lambda p: p["value"]), ",")
    found = select_once(elements.select("pos", text.alias("_text")), _text=_element(F.col("_text"), F.col("pos") == 0))
    ids = select_once(found, id=_string(F.col("_text")), _text=F.col("_text")).where(F.col("_text") != "")
    lost = F.concat(F.lit("not one string of a JSON array: "), F.col("_text"))
    known = F.when(F.col("id").isNotNull() | (F.col("_text") == "null"), F.col("id")).otherwise(F.raise_error(lost))
    return ids.select("pos", known.alias("id")).where(F.col("id").isNotNull())


_SPACE = " \t\r\n"


def _element(text: Column, first: Column) -> Column:
    """An element without white space and without the array's own brackets."""
    inner = F.btrim(text, F.lit(_SPACE))
    inner = F.when(first & F.startswith(inner, F.lit("[")), F.ltrim(F.substr(inner, F.lit(2)), F.lit(_SPACE))).otherwise(inner)
    return F.when(F.endswith(inner, F.lit("]")), F.rtrim(F.left(inner, F.length(inner) - 1), F.lit(_SPACE))).otherwise(inner)


def _string(element: Column) -> Column:
    """The string that an element is; null for anything else."""
    values = F.from_json(F.concat(F.lit("["), element, F.lit(",0]")), "array<variant>", {"allowSingleQuotes": "false"})
    return js.let(values, lambda v: F.when(F.size(v) == 2, js.text(F.get(v, F.lit(0)))))


def parse_id(piece: Column) -> Column:
    """One comma-separated piece of a JSON array of strings → the string, null for an empty array, null or no string."""
    return _string(F.btrim(piece, F.lit(f"[]{_SPACE}")))
