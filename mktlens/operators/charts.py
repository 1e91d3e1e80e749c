"""Ordered arrays, calendar fill and carry-forward.

Arrays are ordered *inside* the aggregate (sort of (date, value) structs), so
their order does not depend on any shuffle. Calendars come from ``sequence``
per key: bounded by the requested range, never by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_array(value: Column | str, order: str = "date") -> Column:
    """``groupArray(value)`` in ``order``: collect (order, value) pairs and sort them."""
    value = F.col(value) if isinstance(value, str) else value
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), value.alias("v")))),
                       lambda s: s["v"])


def calendar(keys: DataFrame, start: Column, stop: Column, out: str = "date") -> DataFrame:
    """One row per key and day in [start, stop] (both inclusive; empty when stop < start)."""
    days = F.when(stop >= start, F.sequence(start, stop)).otherwise(F.array().cast("array<date>"))
    return keys.select("*", F.explode(days).alias(out))


def calendar_fill(df: DataFrame, key_cols: list[str], date_from: str, date_to: str,
                  defaults: dict[str, object], out_date: str = "date") -> DataFrame:
    """``ORDER BY date WITH FILL FROM a TO b``: every day of [a, b) per key; missing days get defaults.

    Observed rows outside [a, b) (e.g. a row on ``b`` itself) are kept as observed.
    """
    keys = df.select(*key_cols).distinct()
    cal = calendar(keys, F.lit(date_from).cast("date"), F.date_sub(F.lit(date_to).cast("date"), 1), out_date)
    filled = cal.join(df, [*key_cols, out_date], "full_outer")
    for c, v in defaults.items():
        filled = filled.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return filled


def carry_forward(df: DataFrame, key_cols: list[str], cols: list[str], order: str = "date") -> DataFrame:
    """``INTERPOLATE``: each NULL takes the last non-NULL value before it (per key, by ``order``)."""
    w = Window.partitionBy(*key_cols).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for c in cols:
        df = df.withColumn(c, F.last(c, ignorenulls=True).over(w))
    return df


def array_total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0).cast("long"), lambda acc, x: acc + x)


def days_positive(arr: Column) -> Column:
    return F.size(F.filter(arr, lambda x: x > 0))
