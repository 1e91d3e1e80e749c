"""Product analytics (Q1, Q2, Q3, Q9, Q14).

All functions answer for every product in the input; pass a filtered input
(``df.filter(product_id == x)`` or a semi join with an id list) for the
single-product API. Filters reach the parquet scan, windows partition by the
product (after per-day aggregation, so one partition = one product's days).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.orders import stock_delta_orders
from ..operators.charts import calendar, calendar_fill, carry_forward, ordered_array
from ..operators.daily import date_between, product_days, product_days_raw, ts_between, with_orders


def _first(col: str, order: str = "ts") -> F.Column:
    """``any(col)``: the first value met, made deterministic as the value at the earliest ``order``."""
    return F.min_by(col, order)


def first_discovered(snap: DataFrame) -> DataFrame:
    """Q1: earliest snapshot per (product, sku)."""
    return snap.groupBy("product_id", "sku_id").agg(F.min("ts").alias("first_discovered"))


def sku_history(snap: DataFrame, ts_from: str, ts_to: str) -> DataFrame:
    """Q2: per SKU-day history with orders derived from stock movements."""
    s = ts_between(snap, ts_from, ts_to)
    if "date" not in s.columns:
        s = s.withColumn("date", F.to_date("ts"))
    day = (s.groupBy("product_id", "sku_id", "date")
           .agg(_first("title").alias("title"),
                F.min("available_amount").alias("amin"),
                F.max("available_amount").alias("amax"),
                F.max_by("available_amount", "ts").alias("alast"),
                (F.max("total_orders_amount") - F.min("total_orders_amount")).alias("toa_diff"),
                F.max("total_available_amount").alias("total_available_amount"),
                (F.max("reviews_amount") - F.min("reviews_amount")).alias("review_amount"),
                F.percentile("purchase_price", 0.5).alias("med"),
                F.min(F.when(F.col("full_price").isNotNull(), F.struct("ts", "full_price")))["full_price"]
                .alias("full_price_any"),
                _first("photo_key").alias("photo_key")))
    w = Window.partitionBy("product_id", "sku_id").orderBy("date")
    day = day.withColumn("prev_last", F.lag("alast", 1, 0).over(w))
    orders = stock_delta_orders(F.col("amax"), F.col("amin"), F.col("prev_last"), F.col("toa_diff"))
    return day.select(
        "date", "product_id", "sku_id", "title",
        orders.alias("order_amount"), "review_amount",
        (F.col("full_price_any") / 100).alias("full_price"),
        (F.col("med") / 100).alias("purchase_price"),
        "photo_key",
        (orders * (F.col("med") / 100)).alias("sales_amount"),
        F.col("alast").alias("available_amount"),
        "total_available_amount")


def products_sales(snap: DataFrame, ts_from: str, ts_to: str, date_from: str, date_to: str) -> DataFrame:
    """Q3: gap-corrected orders and revenue per product over a range, from raw snapshots."""
    days = with_orders(product_days_raw(ts_between(snap, ts_from, ts_to)))
    n_days = F.datediff(F.lit(date_to).cast("date"), F.lit(date_from).cast("date"))
    return (days.groupBy("product_id")
            .agg(F.min_by(F.col("last.title"), "date").alias("title"),
                 F.sum("orders").alias("order_amount"),
                 (F.sum("revenue_minor") / 100).alias("sales_amount"),
                 F.min_by("seller_title", "date").alias("seller_title"),
                 F.min_by("seller_link", "date").alias("seller_link"),
                 F.min_by("seller_account_id", "date").alias("seller_account_id"))
            .withColumn("daily_order_amount", F.try_divide(F.col("order_amount"), n_days)))


def products_order_chart(daily: DataFrame, date_from: str, date_to: str) -> DataFrame:
    """Q14: per product, ``max - min`` of the counter per observed day, in date order."""
    d = date_between(daily, date_from, date_to)
    days = (d.groupBy("product_id", "date")
            .agg((F.max("max_total_order_amount") - F.min("min_total_order_amount")).alias("order_amount")))
    return days.groupBy("product_id").agg(ordered_array("order_amount").alias("order_amount_chart"))


def product_daily_card(daily: DataFrame, categories: DataFrame, date_from: str, date_to: str) -> DataFrame:
    """Q9: product card with charts on a gap-filled calendar.

    Calendar = [first observed day in range, ``date_to``) plus ``date_to`` when
    observed; filled days contribute 0 to the price / revenue / order charts.
    The stock chart lists observed days only (sum over SKUs of the day's
    minimum stock). Scalars are the last observed day's values.
    """
    first_seen = daily.groupBy("product_id").agg(F.min("date").alias("first_discovered"))
    days = with_orders(product_days(date_between(daily, date_from, date_to), with_full_price=True))
    hi = F.lit(date_to).cast("date")
    bounds = days.groupBy("product_id").agg(F.min("date").alias("lo"), F.max("date").alias("last_obs"))
    cal = calendar(bounds, F.col("lo"), F.when(F.col("last_obs") >= hi, hi).otherwise(F.date_sub(hi, 1)))
    filled = cal.select("product_id", "date").join(days, ["product_id", "date"], "left")
    charts = (filled.groupBy("product_id")
              .agg(ordered_array(F.coalesce(F.col("med") / 100, F.lit(0.0))).alias("price_chart"),
                   ordered_array(F.coalesce(F.col("revenue_minor") / 100, F.lit(0.0))).alias("revenue_chart"),
                   ordered_array(F.coalesce(F.col("orders"), F.lit(0).cast("long"))).alias("order_chart")))
    last = F.max_by(F.struct(
        F.col("last.title").alias("title"), F.col("last.category_id").alias("category_id"),
        "seller_link", "seller_title", (F.col("med") / 100).alias("price"),
        (F.col("full_med") / 100).alias("full_price"), F.col("last.reviews_amount").alias("review_amount"),
        F.col("last.photo_key").alias("photo_key"), "rating"), "date")
    scal = (days.groupBy("product_id")
            .agg(last.alias("l"), (F.sum("revenue_minor") / 100).alias("revenue_sum"),
                 ordered_array("stock_sum").alias("available_chart"))
            .select("product_id", "l.*", "revenue_sum", "available_chart"))
    titles = categories.select("category_id", F.col("title").alias("category_name"))
    return (scal.join(charts, "product_id").join(first_seen, "product_id")
            .join(titles, "category_id", "left")
            .withColumn("category_name", F.coalesce("category_name", F.lit("unknown"))))


def product_price_filled(daily: DataFrame, date_from: str, date_to: str) -> DataFrame:
    """Price and stock of each product on every day of the range; a day without snapshots takes the values of the
    last day before it that has any, the days before a product's first snapshot stay null."""
    days = product_days(date_between(daily, date_from, date_to)).select(
        "product_id", "date", (F.col("med") / 100).alias("price"), "stock")
    return carry_forward(calendar_fill(days, ["product_id"], date_from, date_to, {}), ["product_id"], ["price", "stock"])
