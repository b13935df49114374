"""DNS scan snapshots: TXT and MX answers, one JSON value per line (SRC1, SRC2, SRC10).

``read_*`` opens paths, ``parse_*`` takes lines that are already a DataFrame with a string column ``value``; any
other column, such as ``snapshot_date``, is carried along.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailpolicy.functions import jsonvalues as js
from mailpolicy.functions.names import strip_dot
from mailpolicy.functions.text import select_once
from mailpolicy.modes import STRICT, is_reference


def read_lines(spark: SparkSession, paths: str | list[str], snapshot_date: str | None = None) -> DataFrame:
    """Lines of files or directories, compressed or not, labelled with their snapshot (D5)."""
    lines = spark.read.text(paths)
    if snapshot_date is not None:
        lines = lines.withColumn("snapshot_date", F.lit(snapshot_date).cast("date"))
    return lines


def read_spf(spark: SparkSession, paths: str | list[str], snapshot_date: str, mode: str = STRICT) -> DataFrame:
    return parse_spf(read_lines(spark, paths, snapshot_date), mode)


def read_mx(spark: SparkSession, paths: str | list[str], snapshot_date: str, mode: str = STRICT) -> DataFrame:
    return parse_mx(read_lines(spark, paths, snapshot_date), mode)


def parse_spf(lines: DataFrame, mode: str = STRICT) -> DataFrame:
    """TXT scan lines → ``name, answers``; lines without a usable name are left out (PRJ1, PRJ2).

    ``answers`` are ``type, answer``, null where that is no string. An answer is unusable if it is no object, has no type, or
    is of type TXT with an answer that is no string. Reference mode gives up the record there, so that what came before
    counts (Q7); in strict mode the rest counts, too. ``data`` or ``answers`` of another type are as none.
    """
    carried = [c for c in lines.columns if c != "value"]
    return _spf_records(lines).where(_usable_name(F.col("_name"))).select(
        *carried, strip_dot(F.col("_name")).alias("name"), _usable_answers(F.col("_answers"), mode).alias("answers")
    )


def spf_rejects(lines: DataFrame) -> DataFrame:
    """The lines ``parse_spf`` leaves out, as they came."""
    return _spf_records(lines).where(~_usable_name(F.col("_name"))).drop("_name", "_answers")


def _spf_records(lines: DataFrame) -> DataFrame:
    parsed = js.with_value(lines, "struct<name variant, data struct<answers array<variant>>>", "{}", **_date(lines))
    value = F.col("_value")
    return select_once(parsed, _name=js.text(value["name"]), _answers=value["data"]["answers"], **_date(lines)).drop("_value")


def _date(lines: DataFrame) -> dict[str, Column]:
    return {c: F.col(c) for c in lines.columns if c == "snapshot_date"}


def _usable_name(name: Column) -> Column:
    return F.coalesce(F.length(name) > 0, F.lit(False))


def _usable_answers(answers: Column, mode: str) -> Column:
    """Reference mode gives a record up at its first unusable answer (Q7); in strict mode that answer is no policy, its fields being null."""
    def usable(a: Column) -> Column:
        other_text = js.field_is(a, "type", "TXT") & js.has(a, "answer") & js.text(js.field(a, "answer")).isNull()
        return js.has(a, "type") & ~other_text

    def plain(a: Column) -> Column:
        return F.struct(js.text(js.field(a, "type")).alias("type"), js.text(js.field(a, "answer")).alias("answer"))

    if not is_reference(mode):
        return F.transform(answers, plain)
    broken = F.array_position(F.transform(answers, usable), False)
    return F.transform(F.when(broken > 0, F.slice(answers, F.lit(1), broken.cast("int") - 1)).otherwise(answers), plain)


def parse_mx(lines: DataFrame, mode: str = STRICT) -> DataFrame:
    """MX scan lines ``[name, [record…]]`` → ``name`` of those with an exchange of type MX (FLT2).

    Reference mode drops the whole line where the published analysis fails at any of its records or exchanges: a record that
    is null or a number, data that is no object, exchanges that are no list, an exchange without a type, an MX exchange
    without a name, addresses that are null or a number.
    """
    carried = [c for c in lines.columns if c != "value"]
    keep = F.exists("_records", lambda r: F.exists(_exchanges(r), lambda x: js.field_is(x, "type", "MX")))
    if is_reference(mode):
        keep &= ~F.exists("_records", _fails)
    readable = _mx_records(lines).where(_usable_name(F.col("_name")) & F.col("_records").isNotNull())
    return readable.where(F.coalesce(keep, F.lit(False))).select(*carried, strip_dot(F.col("_name")).alias("name"))


def mx_rejects(lines: DataFrame) -> DataFrame:
    """The lines ``parse_mx`` cannot read, as they came: no pair of a name and records. Those without an MX exchange are none."""
    readable = _usable_name(F.col("_name")) & F.col("_records").isNotNull()
    return _mx_records(lines).where(~readable).drop("_name", "_records")


def _mx_records(lines: DataFrame) -> DataFrame:
    parsed = js.with_value(lines, "array<variant>", "[]", **_date(lines))
    name, records = (F.get("_value", F.lit(i)) for i in (0, 1))
    return select_once(parsed, _name=js.text(name), _records=js.array(records), **_date(lines)).drop("_value")


def _exchanges(record: Column) -> Column:
    """Exchanges of a record, none where there is no list of them."""
    return F.coalesce(js.array(js.field(js.field(record, "data"), "exchanges")), F.array().cast("array<variant>"))


def _fails(record: Column) -> Column:
    """Would a record end the reading of its line?"""
    data, exchanges = js.field(record, "data"), js.field(js.field(record, "data"), "exchanges")
    # A record that is a string or a list can hold the word, and is no object then; other than these, only objects can be asked.
    asked = js.contains(record, F.lit("data"))
    listed = js.array(exchanges)
    other = exchanges.isNotNull() & listed.isNull() & ~F.coalesce(js.is_empty(exchanges), F.lit(False))
    at_exchange = F.exists(F.coalesce(listed, F.array().cast("array<variant>")), _exchange_fails)
    return F.coalesce(asked & (~js.is_object(data) | other | at_exchange), asked.isNull() | asked)


def _exchange_fails(exchange: Column) -> Column:
    name, addresses = js.field(exchange, "name"), js.field(exchange, "ipv4_addresses")
    # Addresses are filed under the name, which a list or an object cannot be.
    no_key = (js.array(name).isNotNull() | js.is_object(name)) & ~js.is_empty(addresses)
    at_addresses = addresses.isNotNull() & (js.is_empty(addresses).isNull() | no_key)
    return ~js.has(exchange, "type") | (js.field_is(exchange, "type", "MX") & (name.isNull() | F.coalesce(at_addresses, F.lit(False))))
