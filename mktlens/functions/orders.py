"""Column functions for the cumulative order counter.

The crawled order counter only grows, but crawls miss days and counters get
reset. Per (product, day) the daily state keeps ``mn``/``mx`` of the counter;
``pv`` is the previous *observed* day's ``mx`` (0 on the first day of the
requested range). The corrected day count is

    final = max(0, mx - (pv if pv > 0 else mn))

which is the closed form of the four-branch rule (previous max below / above
the day's range, gap days folded into the next observed day, reset -> 0).
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def gap_corrected_orders(mn: Column | str, mx: Column | str, pv: Column | str) -> Column:
    mn, mx, pv = (F.col(c) if isinstance(c, str) else c for c in (mn, mx, pv))
    return F.greatest(F.lit(0).cast("long"), mx - F.when(pv > 0, pv).otherwise(mn))


def previous_observed(col: str, partition: list[str], order: str = "date", default=0) -> Column:
    """``lagInFrame(col)`` over the product's observed days, default 0."""
    return F.lag(col, 1, default).over(Window.partitionBy(*partition).orderBy(order))


def stock_delta_orders(amax: Column, amin: Column, prev_last: Column, counter_delta: Column) -> Column:
    """Orders of one SKU-day derived from stock movement (SKU history).

    ``diff = 0`` if the day's max stock exceeds the previous day's last stock
    (restock), else ``amax - amin``; a positive diff without any counter move is
    not a sale.
    """
    diff = F.when(amax > prev_last, F.lit(0)).otherwise(amax - amin)
    return F.when((diff < 0) | ((diff > 0) & (counter_delta == 0)), F.lit(0)).otherwise(diff)
