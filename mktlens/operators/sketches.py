"""Mergeable approximate states for very large groups (A7, A9, A12 at scale).

``uniq`` / ``quantile`` states of the reference become DataSketches states in
Spark: an HLL sketch per (category, day) for distinct sellers / products and a
KLL sketch for prices. States are small fixed-size binaries, so a root
category of any size merges them without holding its values in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_states(daily: DataFrame, col: str, keys: list[str], lg_k: int = 12) -> DataFrame:
    return daily.groupBy(*keys).agg(F.hll_sketch_agg(col, lg_k).alias(f"{col}_hll"))


def price_states(daily: DataFrame, keys: list[str]) -> DataFrame:
    """KLL state of the SKU-day prices (one value per histogram entry, repeated n times is not needed:
    the sketch is fed the exploded histogram's prices weighted by repetition via ``explode(array_repeat)``)."""
    e = daily.select(*keys, F.explode("price_hist").alias("h"))
    e = e.select(*keys, F.explode(F.array_repeat(F.col("h.price"), F.col("h.n").cast("int"))).alias("price"))
    return e.groupBy(*keys).agg(F.kll_sketch_agg_bigint("price").alias("price_kll"))


def approx_by_scope(daily: DataFrame, scope: DataFrame, date_from: str, date_to: str) -> DataFrame:
    """Approximate distinct sellers / products and median price per scope and day, from merged states."""
    d = daily.filter(F.col("date").between(F.lit(date_from).cast("date"), F.lit(date_to).cast("date")))
    keys = ["category_id", "date"]
    st = (distinct_states(d, "seller_id", keys).join(distinct_states(d, "product_id", keys), keys)
          .join(price_states(d, keys), keys, "left"))  # a day without prices has no price state
    merged = (st.join(scope, "category_id").groupBy("scope_id", "date")
              .agg(F.hll_union_agg("seller_id_hll").alias("s"), F.hll_union_agg("product_id_hll").alias("p"),
                   F.kll_merge_agg_bigint("price_kll").alias("k")))
    return merged.select(F.col("scope_id").alias("category_id"), "date",
                         F.hll_sketch_estimate("s").alias("approx_seller_count"),
                         F.hll_sketch_estimate("p").alias("approx_product_count"),
                         F.kll_sketch_get_quantile_bigint("k", F.lit(0.5)).alias("approx_median_price"))


def approx_within(approx: DataFrame, exact: DataFrame, bound: float = 0.1) -> DataFrame:
    """Exact counts of each (category, day) and whether the sketches' estimates lie within ``bound`` of them (or one off)."""
    def near(e: str, x: str) -> Column:
        return F.abs(F.col(e) - F.col(x)) <= F.greatest(F.lit(1.0), F.col(x) * bound)
    return (exact.join(approx, ["category_id", "date"])
            .select("category_id", "date", "seller_count", "product_count", near("approx_seller_count", "seller_count").alias("sellers_within"),
                    near("approx_product_count", "product_count").alias("products_within")))


def median_within(approx: DataFrame, daily: DataFrame, scope: DataFrame, bound: float = 0.05) -> DataFrame:
    """Number of prices of each (category, day) that has any, and whether the sketch's median has a rank within ``bound`` of a half.

    The exact rank is summed from the price histograms: the prices below the sketch's median and those up to it.
    """
    m = approx.select(F.col("category_id").alias("scope_id"), "date", F.col("approx_median_price").alias("m"))
    prices = daily.select("category_id", "date", F.explode("price_hist").alias("h")).join(scope, "category_id").join(m, ["scope_id", "date"])
    n = F.col("h.n")
    ranks = prices.groupBy(F.col("scope_id").alias("category_id"), "date").agg(
        F.sum(n).alias("prices"), F.sum(F.when(F.col("h.price") < F.col("m"), n).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("h.price") <= F.col("m"), n).otherwise(0)).alias("up_to"))
    near = (F.col("below") <= (0.5 + bound) * F.col("prices")) & (F.col("up_to") >= (0.5 - bound) * F.col("prices"))
    return ranks.select("category_id", "date", "prices", near.alias("median_within"))
