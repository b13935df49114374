"""JSON values with their exact types, as the published analysis tells them apart: missing, null, text, number, list, object.

A field read as a plain string shows none of that: null looks missing and a number looks like its text. Here a line is parsed
to typed columns only as deep as every type has the same effect, and to VARIANT from there on.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailpolicy.functions.text import select_once

# The reader of the published analysis takes double quotes only.
_JSON = {"allowSingleQuotes": "false"}
_TEXT = "STRING"


def with_value(lines: DataFrame, schema: str, empty: str, **columns: Column) -> DataFrame:
    """Add ``_value``: the JSON value that a line is, parsed by ``schema``; null if it is none.

    A line must hold one value and nothing else, which the reader alone does not see: it stops at the end of the first
    value. So the line is read as the first of two elements of a list, the second being ``empty``, a value of that schema.

    Of equal keys the last one counts, as in the published analysis; Spark fails on them by default, within VARIANT values.
    """
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    read = select_once(lines, _values=_elements(F.col("value"), schema, empty), **columns)
    return read.withColumn("_value", F.when(F.size("_values") == 2, F.get("_values", F.lit(0)))).drop("_values")


def _elements(line: Column, schema: str, empty: str) -> Column:
    return F.from_json(F.concat(F.lit("["), line, F.lit(f",{empty}]")), f"array<{schema}>", _JSON)


def field_of_line(line: Column, name: str) -> Column:
    """One field of a line known to be an object, as VARIANT; null if it is missing. A line without the name is not read for it."""
    named = F.contains(line, F.lit(f'"{name}"')) | F.contains(line, F.lit("\\u"))
    return F.when(named, F.get(_elements(line, f"struct<`{name}` variant>", "{}"), F.lit(0))[name])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def array(value: Column) -> Column:
    """Elements of a list; null if it is none."""
    return F.try_variant_get(value, "$", "array<variant>")


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def field(value: Column, name: str) -> Column:
    """A field of an object as VARIANT, also if it is a JSON null; null if it is missing or ``value`` is no object."""
    return F.try_variant_get(value, f"$['{name}']", "variant")


def has(value: Column, name: str) -> Column:
    return field(value, name).isNotNull()


def text(value: Column) -> Column:
    """A string as such; null for anything else."""
    return F.when(F.schema_of_variant(value) == _TEXT, F.try_variant_get(value, "$", "string"))


def field_is(value: Column, name: str, wanted: str) -> Column:
    """Is a field that string? No other value is written as a bare word, so its text will do."""
    return F.coalesce(F.try_variant_get(value, f"$['{name}']", "string") == wanted, F.lit(False))


def whole_number(value: Column) -> Column:
    """A number without a fraction, or a boolean as 0 or 1; null for anything else."""
    number = F.when(F.rlike(F.schema_of_variant(value), F.lit("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)")), value)
    whole = F.try_variant_get(number, "$", "bigint")
    return F.when(F.try_variant_get(number, "$", "double") == whole.cast("double"), whole)


def texts(value: Column) -> Column:
    """Elements of a list of strings; null if it is no list or holds anything else."""
    only = F.forall(array(value), lambda x: F.coalesce(F.schema_of_variant(x) == _TEXT, F.lit(False)))
    return F.when(only, F.try_variant_get(value, "$", "array<string>"))


def contains(value: Column, wanted: Column) -> Column:
    """Python's ``wanted in value``: part of a string, element of a list, key of an object; null, an error there, for the rest."""
    elements = F.exists(array(value), lambda x: F.coalesce(text(x) == wanted, F.lit(False)))
    keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
    return F.when(array(value).isNotNull(), elements).when(keys.isNotNull(), F.array_contains(keys, wanted)).otherwise(F.contains(text(value), wanted))


def is_empty(value: Column) -> Column:
    """Has a list, an object or a string nothing in it? Null, an error to Python's ``len``, for the rest."""
    keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
    return F.when(array(value).isNotNull(), F.size(array(value)) == 0).when(keys.isNotNull(), F.size(keys) == 0).otherwise(F.length(text(value)) == 0)
