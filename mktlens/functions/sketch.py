"""Per-row functions over mergeable states (price histograms).

A histogram is ``array<struct<price: long, n: long>>``. Within one row it is
bounded by the number of distinct prices, so array functions are fine; merges
across rows go through ``explode`` + ``percentile(price, 0.5, n)`` instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hist_count(hist: Column) -> Column:
    return F.aggregate(hist, F.lit(0).cast("long"), lambda a, x: a + x["n"])


def hist_median(hist: Column) -> Column:
    """Exact interpolated median of one histogram (equal to ``percentile(values, 0.5)``); NULL when empty."""
    h = F.array_sort(hist)
    n = hist_count(h)
    # cumulative counts, entry i = n_1 + ... + n_i
    cum = F.transform(h, lambda x, i: F.aggregate(F.slice(h, 1, i + 1), F.lit(0).cast("long"),
                                                   lambda a, y: a + y["n"]))
    pairs = F.arrays_zip(h.alias("h"), cum.alias("c"))

    def value_at(k: Column) -> Column:
        return F.element_at(F.filter(pairs, lambda e: e["c"] > k), 1)["h"]["price"]

    lo = F.floor((n - 1) / 2).cast("long")
    hi = F.floor(n / 2).cast("long")
    return F.when(n > 0, (value_at(lo) + value_at(hi)) / 2.0)
