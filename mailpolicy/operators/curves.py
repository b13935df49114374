"""Cumulative curves over counts (WIN1-4, SRT1-2, AGG39).

Rows are first brought to a histogram, one row per distinct value, so a tie run is one row and the running sum never sees
the data itself. The histogram may still be long, so the running sum is taken in blocks of neighbouring values: within a
block, over the blocks of a super-block, and over the super-blocks. Every value has a place, a ``bigint`` that rises with it;
places and the shifts below bound each of these windows at 2^22 rows, however many distinct values there are.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailpolicy.modes import STRICT, is_reference

_BLOCK_BITS = 21
_INTEGRAL = ("tinyint", "smallint", "int", "bigint")
_LONGEST = 2**63 - 1


def histogram(df: DataFrame, value: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """``by…, value, n``; ``weight`` names a column that says how often a row counts.

    Integers become ``bigint`` and floats ``double``, decimals stay as they are. Null and NaN are no values and are left out.
    """
    kind = dict(df.dtypes)[value]
    if kind in _INTEGRAL:
        x, given = F.col(value).cast("bigint"), F.col(value).isNotNull()
    elif kind in ("float", "double"):
        x, given = F.col(value).cast("double"), F.col(value).isNotNull() & ~F.isnan(value)
    elif kind.startswith("decimal"):
        x, given = F.col(value), F.col(value).isNotNull()
    else:
        raise TypeError(f"curves are drawn over numbers: {value!r} is {kind}")
    n = F.count("*") if weight is None else F.sum(weight)
    return df.where(given).groupBy(*(by or []), x.alias("value")).agg(n.alias("n"))


def _place(kind: str) -> Column:
    """A ``bigint`` that rises with ``value``: never lower for a greater one, and equal for two neighbouring doubles at most.

    Integers and decimals of up to 18 digits are their own place. For a double it is exponent and mantissa, each worked out by monotone steps: where
    the logarithm is rounded over a power of two, the mantissa leaves its octave by as little, and the places still rise. Zero is 0,
    infinities come last. Decimals of more digits take the place of the nearest double, so that values alike in their first 15 digits share it.
    """
    if kind == "bigint":
        return F.col("value")
    if kind.startswith("decimal"):
        digits, scale = (int(x) for x in kind[len("decimal(") : -1].split(","))
        if digits <= 18:
            return (F.col("value").cast(f"decimal(38,{scale})") * F.lit(10**scale).cast("decimal(19,0)")).cast("bigint")
    x = F.abs(F.col("value").cast("double"))
    exponent = F.least(F.greatest(F.floor(F.log2(x)), F.lit(-1022)), F.lit(1023))
    # Two steps of scaling: one power of two for the least exponents would not be a normal number's inverse.
    half = F.floor(exponent / 2)
    mantissa = x / F.pow(F.lit(2.0), half) / F.pow(F.lit(2.0), exponent - half)
    place = (exponent + 1023).cast("bigint") * F.lit(2**52) + F.floor(mantissa * 2.0**51).cast("bigint")
    place = F.when(x == 0, F.lit(0).cast("bigint")).when(x == float("inf"), F.lit(_LONGEST)).otherwise(place)
    return F.when(F.col("value") < 0, -place).otherwise(place)


def cdf(
    df: DataFrame, value: str, by: list[str] | None = None, how: str = "freq", weight: str | None = None
) -> DataFrame:
    """``by…, value, cum, total, cdf`` for each distinct value.

    ``how="freq"`` gives the share of rows at or below the value (WIN1), ``how="total"`` the share of the sum of all
    values that these rows hold (WIN2), null if that sum is 0. Sums of doubles are exact up to rounding, those of decimals exact.
    """
    if how not in ("freq", "total"):
        raise ValueError(f"how must be 'freq' or 'total', not {how!r}")
    hist = histogram(df, value, by, weight)
    measure = F.col("n") if how == "freq" else F.col("value") * F.col("n")
    curve = _running_sums(hist.withColumn("cum", measure), by or [], ["cum"])
    return curve.select(
        *(by or []), "value", "cum", F.col("cum_total").alias("total"), F.try_divide("cum", "cum_total").alias("cdf")
    )


def concentration(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """``by…, idx, value, cum, total, share``: values from the largest down, one row per tie run (WIN3).

    ``idx`` is the 0-based place of the run's last row, ``share`` what all rows up to it hold of the sum.
    """
    hist = histogram(df, value, by).withColumn("cum", F.col("value") * F.col("n"))
    curve = _running_sums(hist.withColumnRenamed("n", "rows"), by or [], ["rows", "cum"], descending=True)
    return curve.select(
        *(by or []),
        (F.col("rows") - 1).alias("idx"),
        "value",
        "cum",
        F.col("cum_total").alias("total"),
        F.try_divide("cum", "cum_total").alias("share"),
    )


def _running_sums(hist: DataFrame, by: list[str], measures: list[str], descending: bool = False) -> DataFrame:
    """Replace each measure by its running sum in the order of ``value`` and add ``<measure>_total``."""
    def window(partition: list[str], order: str):
        ordered = F.desc(order) if descending else F.asc(order)
        return Window.partitionBy(*(partition or [F.lit(0)])).orderBy(ordered)

    def before(m: str, w) -> Column:
        return F.coalesce(F.sum(m).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    sums = [F.sum(m).alias(m) for m in measures]
    values = hist.withColumn("_block", _shifted(_place(dict(hist.dtypes)["value"])))
    blocks = values.groupBy(*by, "_block").agg(*sums).withColumn("_super", _shifted(F.col("_block")))
    supers = blocks.groupBy(*by, "_super").agg(*sums)

    # each level only needs what the levels above it held before; the merge joins partition as the windows after them do
    whole = Window.partitionBy(*(by or [F.lit(0)]))
    super_starts = supers.select(
        *by,
        "_super",
        *[before(m, window(by, "_super")).alias(f"{m}_start") for m in measures],
        *[F.sum(m).over(whole).alias(f"{m}_total") for m in measures],
    )
    block_starts = blocks.join(super_starts.hint("merge"), [*by, "_super"]).select(
        *by,
        "_block",
        *[
            (F.col(f"{m}_start") + before(m, window([*by, "_super"], "_block"))).alias(f"{m}_start") for m in measures
        ],
        *[f"{m}_total" for m in measures],
    )
    running = window([*by, "_block"], "value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    others = [c for c in hist.columns if c not in (*by, *measures)]
    return values.join(block_starts.hint("merge"), [*by, "_block"]).select(
        *by,
        *others,
        *[(F.col(f"{m}_start") + F.sum(m).over(running)).alias(m) for m in measures],
        *[f"{m}_total" for m in measures],
    )


def _shifted(place: Column) -> Column:
    """Number of the block a place is in. The join on it would put a not-null filter on a nullable column below the
    histogram, in one of its branches only, and the branches could no longer share one scan."""
    return F.coalesce(F.shiftright(place, _BLOCK_BITS), F.lit(0).cast("bigint"))


def include_totals(counts: DataFrame, mode: str = STRICT) -> DataFrame:
    """``domain, n``, one row per include target (Q16).

    Reference mode keeps the number on a domain's last line, by ``line_no``; strict mode adds its numbers up.
    """
    n = F.max_by("n", "line_no") if is_reference(mode) else F.sum("n")
    return counts.groupBy("domain").agg(n.alias("n"))
