"""Rounding, percentages and money helpers.

Rounding that is part of an output contract is done in integer arithmetic so
the result does not depend on binary floating point or the engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_ratio_half_up(num: Column, den: Column, scale: int) -> Column:
    """round(num / den, scale), ties away from zero, for integral ``num`` and positive integral ``den``.

    Exact: ``q = (|num| * 10^scale * 2 + den) div (2 * den)``; NULL when den is 0.
    """
    f = 10 ** scale
    a = F.abs(num.cast("long")) * (2 * f)
    d = den.cast("long")
    s = a + d
    q = F.when(d > 0, ((s - F.pmod(s, d * 2)) / (d * 2)).cast("long"))
    return F.signum(num) * q / f


def percent_change(old: Column, new: Column) -> Column:
    """Percentage difference: 0 when ``old`` is 0, else 100 * (new - old) / |old|, truncated to 1 decimal."""
    raw = F.when(old == 0, F.lit(0.0)).otherwise(F.lit(100.0) * (new - old) / F.abs(old))
    return truncate(raw, 1)


def truncate(x: Column, scale: int) -> Column:
    f = 10 ** scale
    return (x * f).cast("long") / f


def minor_to_major(x: Column) -> Column:
    return x / 100


def money_split(amount: Column) -> Column:
    """Amount (decimal) -> struct(units, nanos, currency_code=643): units truncated, nanos 9 digits truncated."""
    dec = amount.cast("decimal(38,12)")
    units = dec.cast("long")
    nanos = ((dec - units) * 1000000000).cast("int")
    return F.struct(units.alias("units"), nanos.alias("nanos"), F.lit(643).alias("currency_code"))


def to_minor(decimal_string: Column) -> Column:
    """Decimal string -> minor units, truncating; empty string -> NULL."""
    return F.when(decimal_string != "", (decimal_string.cast("decimal(20,6)") * 100).cast("long"))


def product_url(product_id: Column, base: str) -> Column:
    """Product page link for a report row (``base`` is the marketplace's product URL prefix)."""
    return F.concat(F.lit(base.rstrip("/") + "/"), product_id.cast("string"))
