"""Sales reports: ABC classes, the 11-column report rows, quotas, report batches and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.charts import array_total, days_positive
from ..operators.daily import product_days, with_orders

# ABC thresholds on the cumulative share, in percent.
ABC_A_BELOW, ABC_B_BELOW = 81, 96


def _half_up_cents(sales: Column) -> Column:
    """Sales (major units, a multiple of 0.005) rounded to cents HALF_UP, as an exact integer of cents."""
    twice = F.round(sales * 200).cast("long")  # 2 x minor units, exact
    return F.signum(twice).cast("long") * F.floor((F.abs(twice) + 1) / 2).cast("long")


def abc_table(df: DataFrame, value: str, keys: list[str], out: str) -> DataFrame:
    """The ABC class of every distinct ``value`` of each ``keys`` group.

    share(x) = (sum of the group's values strictly greater than x, + x) / sum of
    all values; A below 0.81, B below 0.96, else C; NULL when the sum is 0.
    Values are counted map-side, the running sum over the distinct values
    (descending) has two levels: over buckets of about the square root of the
    values' range, then inside a bucket, so no task holds a report's values.
    Comparisons are exact integer arithmetic.
    """
    mass = F.col(value) * F.col("_n")
    bucket = -F.signum(value) * F.floor(F.sqrt(F.abs(value)))  # rises as the value falls
    per_value = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", bucket.cast("long"))
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (per_value.groupBy(*keys, "_b").agg(F.sum(mass).alias("_m"))
               .select(*keys, "_b", F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_before"),
                       F.sum("_m").over(whole).alias("_tot")))
    inner = Window.partitionBy(*keys, "_b").orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, -1)
    share = F.col("_before") + F.coalesce(F.col("_in"), F.lit(0)) + F.col(value)
    cls = (F.when(F.col("_tot") == 0, F.lit(None).cast("string"))
           .when(share * 100 < F.col("_tot") * ABC_A_BELOW, "A")
           .when(share * 100 < F.col("_tot") * ABC_B_BELOW, "B")
           .otherwise("C"))
    return per_value.withColumn("_in", F.sum(mass).over(inner)).join(buckets, [*keys, "_b"]).select(*keys, value, cls.alias(out))


def abc_class(df: DataFrame, value: str, keys: list[str], out: str) -> DataFrame:
    """Each row's ABC class for ``value`` within its ``keys`` group, joined back on (keys, value)."""
    return df.join(abc_table(df, value, keys, out), [*keys, value])


def report_base(sales_rows: DataFrame, key: str) -> DataFrame:
    """The report columns but the classes; revenue in cents."""
    return sales_rows.select(
        key, "seller_title", "product_id", "name", "category_name", "available_amounts",
        days_positive(F.col("available_amount_graph")).alias("days_in_stock"),
        "purchase_price",
        array_total(F.col("order_graph")).alias("orders"),
        _half_up_cents(F.col("sales")).alias("revenue_cents"))


def with_classes(rows: DataFrame, key: str) -> DataFrame:
    """R1 on orders and on revenue, both from the same rows (not one on top of the other)."""
    orders, revenue = (abc_table(rows, v, [key], out) for v, out in (("orders", "abc_orders"), ("revenue_cents", "abc_revenue")))
    return (rows.join(orders, [key, "orders"]).join(revenue, [key, "revenue_cents"])
            .withColumn("revenue", F.col("revenue_cents") / 100).drop("revenue_cents"))


def report_rows(sales_rows: DataFrame, key: str) -> DataFrame:
    """R2-R4 + R1: the 11 report columns per product row of a seller / category report."""
    return with_classes(report_base(sales_rows, key), key)


def reports_per_user_day(requests: DataFrame) -> DataFrame:
    """Number of report requests per user, type and day."""
    return (requests.groupBy("user_id", "report_type", F.to_date("created_at").alias("date"))
            .agg(F.count(F.lit(1)).alias("report_count")))


def expire_reports(reports: DataFrame, now: str, hours: int = 18) -> DataFrame:
    """Reports created more than ``hours`` before ``now`` lose their content and become 'deleted'."""
    cutoff = F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS")
    old = F.col("created_at") < cutoff
    out = reports.withColumn("status", F.when(old, F.lit("deleted")).otherwise(F.col("status")))
    if "content" in reports.columns:
        out = out.withColumn("content", F.when(old, F.lit(None)).otherwise(F.col("content")))
    return out


REPORT_KEY = ["report_type", "key", "interval_days"]


def report_key() -> Column:
    """Name of a report: what equal requests share; null without a key."""
    return F.concat("report_type", F.lit(":"), "key", F.lit(":"), F.col("interval_days").cast("string"))


def requested_rows(requests: DataFrame, daily: DataFrame, scope: DataFrame, as_of: str) -> DataFrame:
    """Daily rows of every distinct requested (type, key, interval) whose day lies in the interval up to ``as_of``."""
    a = F.lit(as_of).cast("date")
    wanted = requests.select(*REPORT_KEY).distinct()
    seller_rows = (daily.select("*", F.col("seller_link").alias("key"), F.lit("seller").alias("report_type")))
    cat_rows = (daily.join(scope, "category_id")
                .select("*", F.col("scope_id").cast("string").alias("key"), F.lit("category").alias("report_type"))
                .drop("scope_id"))
    # equi-join on (type, key) with the requested keys; the interval is a filter on the day
    return (seller_rows.unionByName(cat_rows).join(wanted, ["report_type", "key"])
            .filter(F.col("date").between(F.date_sub(a, F.col("interval_days").cast("int")), a)))


def report_batch(requests: DataFrame, daily: DataFrame, scope: DataFrame, as_of: str) -> DataFrame:
    """One batch run over pending report requests.

    A request asks for the seller (``key`` = seller link) or category (``key`` =
    category id as text) report over the ``interval_days`` up to ``as_of``.
    Requests sharing (type, key, interval) share one computation: daily rows
    are joined to the distinct requested (type, key, interval) combinations --
    a few intervals per key -- and kept when their day lies in the interval;
    the C-block runs per (type, key, interval, product), and each request gets
    its report's summary; a report without rows marks the request failed.
    """
    k = REPORT_KEY
    days = with_orders(product_days(requested_rows(requests, daily, scope, as_of), k), k)
    per_product = days.groupBy(*k, "product_id").agg(F.sum("orders").alias("o"), F.sum("revenue_minor").alias("r"))
    summary = (per_product.groupBy(*k)
               .agg(F.count(F.lit(1)).alias("product_rows"), F.sum("o").alias("total_orders"),
                    (F.sum("r") / 100).alias("total_revenue")))
    return (requests.join(summary, k, "left")
            .select("report_id", "report_type", "key", "interval_days",
                    F.when(F.col("product_rows") > 0, "completed").otherwise("failed").alias("status"),
                    F.coalesce("product_rows", F.lit(0).cast("long")).alias("product_rows"),
                    F.coalesce("total_orders", F.lit(0).cast("long")).alias("total_orders"),
                    F.coalesce("total_revenue", F.lit(0.0)).alias("total_revenue")))
