"""Seller analytics (Q5, Q6, Q7, Q18, Q19) and the shared sales-report rows (Q7/Q8).

Keyed by ``seller_link`` for every seller at once; the C-block window
partitions by (seller_link, product_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.charts import ordered_array
from ..operators.daily import date_between, product_days, with_orders


def _seller_days(daily: DataFrame, date_from: str, date_to: str) -> DataFrame:
    d = date_between(daily, date_from, date_to)
    return with_orders(product_days(d, ["seller_link"]), ["seller_link"])


def seller_overall(daily: DataFrame, date_from: str, date_to: str) -> DataFrame:
    """Q5: orders, revenue, product counts and average price per seller."""
    per_product = (_seller_days(daily, date_from, date_to)
                   .groupBy("seller_link", "product_id")
                   .agg(F.sum("orders").alias("o"), F.sum("revenue_minor").alias("r"),
                        F.avg(F.col("med") / 100).alias("p")))
    return (per_product.groupBy("seller_link")
            .agg(F.sum("o").alias("order_amount"),
                 (F.sum("r") / 100).alias("revenue"),
                 F.count(F.lit(1)).alias("product_count"),
                 F.count_if(F.col("o") > 0).alias("product_with_sales"),
                 F.count_if(F.col("o") <= 0).alias("product_without_sales"),
                 F.sum("p").alias("_p"))
            .withColumn("avg_price", F.round(F.try_divide(F.col("_p"), F.col("product_with_sales").cast("double"))))
            .drop("_p"))


def seller_order_dynamic(daily: DataFrame, date_from: str, date_to: str) -> DataFrame:
    """Q6: orders per seller and observed day."""
    return (_seller_days(daily, date_from, date_to)
            .groupBy("seller_link", "date").agg(F.sum("orders").alias("order_amount")))


def sales_report_rows(days: DataFrame, key: str, categories: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Per (key, product) report rows: charts in date order, last-day values, revenue, total, one page per key.

    ``total`` is the number of products of the key before paging (a count over
    the key's partition, never an unpartitioned window); pages are ordered by
    product_id.
    """
    last = F.max_by(F.struct(
        F.col("seller_title"), F.col("seller_id"), F.col("last.category_id").alias("latest_category_id"),
        F.col("stock").alias("available_amounts"), (F.col("med") / 100).alias("purchase_price"),
        F.col("last.title").alias("name")), "date")
    rows = (days.groupBy(key, "product_id")
            .agg(last.alias("l"),
                 ordered_array("orders").alias("order_graph"),
                 ordered_array("stock").alias("available_amount_graph"),
                 ordered_array(F.col("med") / 100).alias("price_graph"),
                 (F.sum("revenue_minor") / 100).alias("sales"))
            .select(key, "product_id", "l.*", "order_graph", "available_amount_graph", "price_graph", "sales"))
    titles = categories.select(F.col("category_id").alias("latest_category_id"), F.col("title").alias("category_name"))
    rows = rows.join(titles, "latest_category_id", "left")
    # the total counts (key, product) pairs without the arrays, map-side, so no task holds a key's rows
    pairs = days.select(key, "product_id").distinct()
    rows = rows.join(pairs.groupBy(key).agg(F.count(F.lit(1)).alias("total")), key)
    if limit is None:  # a report holds every product
        return rows
    w = Window.partitionBy(key).orderBy("product_id")
    return (rows.withColumn("_rn", F.row_number().over(w))
            .filter((F.col("_rn") > offset) & (F.col("_rn") <= offset + limit)).drop("_rn"))


def seller_sales_report(daily: DataFrame, categories: DataFrame, date_from: str, date_to: str,
                        limit: int | None = None, offset: int = 0) -> DataFrame:
    """Q7: all products of each seller, or a page of them."""
    return sales_report_rows(_seller_days(daily, date_from, date_to), "seller_link", categories, limit, offset)


def seller_card(daily: DataFrame, date_from: str, date_to: str) -> DataFrame:
    """Q18: seller overview plus its orders-per-day series."""
    dyn = (seller_order_dynamic(daily, date_from, date_to)
           .groupBy("seller_link")
           .agg(F.array_sort(F.collect_list(F.struct("date", "order_amount"))).alias("sales_dynamic")))
    return seller_overall(daily, date_from, date_to).join(dyn, "seller_link", "left")


def seller_shops(sellers: DataFrame, links: DataFrame) -> DataFrame:
    """Q19: for every requested link (a request log, de-duplicated), all shops of the account(s) owning it.

    The output is one row per (requested link, shop of its account): linear in
    the requests, never all shop pairs of an account.
    """
    owners = (links.select(F.col("link").alias("request_link")).distinct()
              .join(sellers.select(F.col("link").alias("request_link"), "account_id"), "request_link"))
    return (owners.join(sellers.select("account_id", "title", F.col("link").alias("shop_link")), "account_id")
            .select("request_link", "title", "shop_link", "account_id"))
