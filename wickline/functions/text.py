"""Numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = 1 << 52


def two_decimals(value: Column) -> Column:
    """``value`` with two decimals, rounded from its exact binary value as printf
    does: 312.435 is stored a little above or below the tie, and that decides.
    Real ties go to the even digit. The fraction is scaled to an integer, so the
    comparison is exact.
    """
    exact = F.abs(value) < F.lit(float(1 << 53))  # what is larger has no fraction
    size = F.when(exact, F.abs(value)).otherwise(0.0)
    whole = F.floor(size)
    units = (size - whole) * F.lit(float(TWO_52))
    below = (units - F.floor(units)) * 100  # bits under 2^-52, only present in values below one
    scaled = F.floor(units) * 100 + F.floor(below)
    cents = F.floor(F.shiftright(scaled, 52))
    rest = scaled - F.shiftleft(cents, 52)
    half = F.lit(TWO_52 // 2)
    above_tie = (below > F.floor(below)) | (cents % 2 == 1)
    up = (rest > half) | ((rest == half) & above_tie)
    added = (cents + F.when(up, 1).otherwise(0)).cast("bigint")
    carried = F.when(added >= 100, 1).otherwise(0)  # from 99.5 hundredths on
    large = F.abs(value).try_cast("decimal(38,0)").cast("string")
    units_text = F.when(exact, (whole + carried).cast("string")).otherwise(large)
    sign = F.when((value < 0) | (value.cast("string") == "-0.0"), "-").otherwise("")
    return F.concat(sign, units_text, F.lit("."), F.lpad((added - 100 * carried).cast("string"), 2, "0"))


def thousands(value: Column) -> Column:
    """``value`` with two decimals and a comma before every three digits."""
    text = two_decimals(value)
    return F.regexp_replace(text, r"(\d)(?=(\d{3})+\.)", "$1,")


def percent(value: Column) -> Column:
    return F.concat(two_decimals(value * 100), F.lit("%"))


def or_dash(value: Column) -> Column:
    return F.coalesce(value, F.lit("-"))


def minute(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")
