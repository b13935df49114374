"""DNS name expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_dot(name: Column) -> Column:
    """Drop one trailing dot (PRJ2)."""
    return F.when(F.endswith(name, F.lit(".")), drop_last(name)).otherwise(name)


def drop_last(text: Column) -> Column:
    """Drop the last character, whatever it is (Q9)."""
    return F.left(text, F.length(text) - 1)


def tld(name: Column) -> Column:
    """Last label of a name (PRJ3)."""
    return F.split_part(name, F.lit("."), F.lit(-1))


def second_level(name: Column) -> Column:
    """Last two labels of a name (PRJ4)."""
    return F.substring_index(name, ".", -2)


def first_label(name: Column) -> Column:
    return F.split_part(name, F.lit("."), F.lit(1))
