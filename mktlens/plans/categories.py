"""Category analytics (Q4, Q10, Q11, Q12, Q13, Q16, Q17) and node info.

Every function answers for *all* scopes at once when handed a scope table
(``hierarchy.scope_table``), or for one category when handed
``hierarchy.scope_of(...)``: the per-child fan-out of the service becomes one
join and one aggregation keyed by ``scope_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.daily import date_between, product_days, with_orders
from ..operators.distincts import count_states, distinct_states, entity_states
from ..operators.medians import group_medians


def _scoped(daily: DataFrame, scope: DataFrame, date_from: str, date_to: str) -> DataFrame:
    """Date filter and scope join *before* the C-block window (the window must not see other days)."""
    return date_between(daily, date_from, date_to).join(scope, "category_id")


def category_daily(daily: DataFrame, scope: DataFrame, date_from: str, date_to: str) -> DataFrame:
    """Q12: per scope and day -- orders, revenue (major units), average bill, stock."""
    days = with_orders(product_days(_scoped(daily, scope, date_from, date_to), ["scope_id"]), ["scope_id"])
    agg = (days.groupBy("scope_id", "date")
           .agg(F.sum("orders").alias("order_amount"),
                F.sum("revenue_minor").alias("_rev"),
                F.sum("stock").alias("available_amount")))
    revenue = F.when(F.col("_rev") <= 0, F.lit(0.0)).otherwise(F.col("_rev")) / 100
    return (agg.withColumn("revenue", revenue)
            .select(F.col("scope_id").alias("category_id"), "date", "order_amount", "revenue",
                    F.when(F.col("order_amount") <= 0, F.lit(0.0))
                    .otherwise(F.col("revenue") / F.col("order_amount")).alias("average_bill"),
                    "available_amount"))


def category_adhoc(daily: DataFrame, scope: DataFrame, date_from: str, date_to: str, states: DataFrame | None = None) -> DataFrame:
    """Q11: category metrics for any range straight from daily states (money in minor units).

    ``states``: stored distinct-count states of the daily table (built on the fly without). The
    median over all product-days of a scope is exact, by two-pass selection.
    """
    days = with_orders(product_days(_scoped(daily, scope, date_from, date_to), ["scope_id"]), ["scope_id"])
    agg = (days.groupBy("scope_id")
           .agg(F.sum("orders").alias("order_amount"),
                F.sum("stock").alias("available_amount"),
                F.sum("revenue_minor").alias("revenue")))
    states = entity_states(date_between(daily, date_from, date_to)) if states is None else states
    dist = count_states(_scoped(states, scope, date_from, date_to), ["scope_id"],
                        {"seller_id": "seller_count", "product_id": "product_count"})
    o, r = F.col("order_amount"), F.col("revenue")
    return (agg.join(group_medians(days, ["scope_id"], F.col("med")), "scope_id", "left").join(dist, "scope_id")
            .select(F.col("scope_id").alias("category_id"), "order_amount", "available_amount", "revenue",
                    F.when(o > 0, F.col("median")).otherwise(F.lit(0.0)).alias("median_price"),
                    F.when(o > 0, r / o).otherwise(F.lit(0.0)).alias("avg_bill"),
                    "seller_count", "product_count",
                    F.try_divide(o.cast("double"), F.col("product_count")).alias("order_per_product"),
                    F.try_divide(o.cast("double"), F.col("seller_count")).alias("order_per_seller"),
                    F.when(o > 0, r / F.col("product_count")).otherwise(F.lit(0.0)).alias("revenue_per_product")))


def category_overall(snap: DataFrame, scope: DataFrame, ts_from: str, ts_to: str) -> DataFrame:
    """Q4: category overview over raw snapshots (no gap correction: order = max - min over the range).

    The per-product aggregate is computed once and feeds the product, the seller and the
    scope level; distinct sellers come from one bitmap state a category, merged by scope, so
    snapshots are copied to their scopes once only.
    """
    from ..functions.numeric import round_ratio_half_up
    from ..operators.daily import ts_between

    ranged = ts_between(snap, ts_from, ts_to)
    per_product = (ranged.join(scope, "category_id").groupBy("scope_id", "product_id")
                   .agg((F.max("total_orders_amount") - F.min("total_orders_amount")).alias("o"),
                        F.percentile("purchase_price", 0.5).alias("p"),
                        F.max("seller_id").alias("s")))
    sold = F.col("o") > 0
    per_seller = (per_product.groupBy("scope_id", "s")
                  .agg(F.sum("o").alias("so"), F.sum(F.when(sold, F.col("p") * 2)).cast("long").alias("p2"),
                       F.count_if(sold).alias("n"), F.sum(F.when(sold, F.col("o") * F.col("p"))).alias("r"),
                       F.sum(F.when(sold, F.col("o"))).alias("oc"), F.count_if(~sold).alias("zero"),
                       F.count("product_id").alias("products")))
    sums = (per_seller.groupBy("scope_id")
            .agg(F.sum("p2").alias("_p2"), F.sum("n").alias("_n"), (F.sum("r") / 100).alias("revenue"),
                 F.sum("oc").alias("order_count"), F.sum("zero").alias("product_zero_sales_count"),
                 F.count_if(F.col("so") <= 0).alias("seller_with_zero_sales_count"), F.sum("products").alias("product_counts")))
    states = distinct_states(ranged, "seller_id", ["category_id"]).join(scope, "category_id")
    return (sums.join(count_states(states, ["scope_id"], {"seller_id": "seller_counts"}), "scope_id")
            .select(F.col("scope_id").alias("category_id"),
                    round_ratio_half_up(F.col("_p2"), F.col("_n") * 200, 2).alias("avg_price"),
                    "revenue", "order_count", "seller_counts", "product_counts",
                    round_ratio_half_up(F.col("order_count"), F.col("seller_counts"), 3).alias("sales_per_seller"),
                    "seller_with_zero_sales_count", "product_zero_sales_count"))


def category_sales_report(daily: DataFrame, scope: DataFrame, categories: DataFrame, date_from: str, date_to: str,
                          limit: int | None = None, offset: int = 0) -> DataFrame:
    """Q8: report rows for every category scope, all products or a page of them."""
    from .sellers import sales_report_rows

    days = with_orders(product_days(_scoped(daily, scope, date_from, date_to), ["scope_id"]), ["scope_id"])
    return sales_report_rows(days, "scope_id", categories, limit, offset).withColumnRenamed("scope_id", "category_id")
