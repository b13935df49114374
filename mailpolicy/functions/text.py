"""Text helpers shared by the readers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters a whitespace split or strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column) -> Column:
    """Remove whitespace at both ends."""
    return F.btrim(col, F.lit(WHITESPACE))


def spaced(col: Column) -> Column:
    """Every whitespace character as a space. Lines of printable ASCII, nearly all, pass after one cheap look."""
    unusual = F.rlike(col, F.lit(r"[^\x20-\x7e]"))
    return F.when(unusual, F.translate(col, WHITESPACE, " " * len(WHITESPACE))).otherwise(col)


def tokens(col: Column, without: list[str] | None = None) -> Column:
    """Tokens between runs of whitespace; ``without`` leaves out some words."""
    return F.filter(F.split(spaced(col), " "), lambda t: ~t.isin("", *(without or [])))


def closes(col: Column, bracket: str) -> Column:
    """Does a line end with a bracket? The JSON reader stops at the end of a value, and text after it is an error."""
    return F.endswith(col, F.lit(bracket)) | F.endswith(F.rtrim(col, F.lit(" \t\r\n")), F.lit(bracket))


def select_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters must not evaluate a second time.

    A filter on a projected column is pushed below the projection together with the column's expression, so a parsed
    line would be parsed once to be filtered and again to be selected. A generator is not crossed by such filters.

    A column of the old name is replaced. Given as itself, a constant one is kept from being folded: as a join key it
    would vanish from the join but not from the aggregations beside it, and their partitionings would no longer do for it.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(row)))
