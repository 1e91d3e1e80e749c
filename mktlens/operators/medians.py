"""Exact medians of groups of any size by two-pass selection.

``percentile`` keeps all distinct values of a group in one task. Here a group's values are first
counted (map-side combined), then summed by value range: 256 ranges for each doubling of
the value, so a group has a few thousand at most whatever its size. The running sum over
those ranges tells which range holds the middle; only that range's values are
ordered and the middle read off. Hot groups are spread over their values until then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256


def value_range(v: Column) -> Column:
    """A number that grows with the value: ``RANGES`` steps for each doubling of |v| + 1."""
    return (F.signum(v) * F.floor(F.log2(F.abs(v) + 1) * RANGES)).cast("long")


def group_medians(rows: DataFrame, keys: list[str], value: Column, weight: Column | None = None) -> DataFrame:
    """(keys..., median): the mean of the two middle values of each group, as ``percentile(value, 0.5)`` gives it.

    Null values and weights of null or 0 don't count; groups without values have no row; null keys
    are keys of their own.
    """
    w = F.lit(1) if weight is None else weight
    counts = (rows.select(F.struct(*keys).alias("_k"), value.cast("double").alias("_v"), w.cast("long").alias("_w"))
              .filter(F.col("_v").isNotNull() & (F.col("_w") > 0))
              .groupBy("_k", "_v").agg(F.sum("_w").alias("_n")).withColumn("_r", value_range(F.col("_v"))))
    upto = Window.partitionBy("_k").orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = (counts.groupBy("_k", "_r").agg(F.sum("_n").alias("_m"))
              .withColumn("_end", F.sum("_m").over(upto)).withColumn("_total", F.sum("_m").over(Window.partitionBy("_k")))
              .select("_k", "_r", "_end", (F.col("_end") - F.col("_m")).alias("_start"),
                      F.floor((F.col("_total") - 1) / 2).alias("_lo"), F.floor(F.col("_total") / 2).alias("_hi")))
    middle = ranges.filter((F.col("_start") <= F.col("_hi")) & (F.col("_end") > F.col("_lo"))).drop("_end")
    inside = Window.partitionBy("_k", "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = (counts.join(middle, ["_k", "_r"])
          .withColumn("_to", F.col("_start") + F.sum("_n").over(inside)).withColumn("_from", F.col("_to") - F.col("_n")))

    def holds(place: str) -> Column:
        return ((F.col("_from") <= F.col(place)) & (F.col("_to") > F.col(place))).cast("int")

    return (at.groupBy("_k").agg((F.sum(F.col("_v") * (holds("_lo") + holds("_hi"))) / 2).alias("median"))
            .select(*[F.col(f"_k.{k}").alias(k) for k in keys], "median"))
