"""Daily state (J1) and the per-product-day block every analytic query starts from.

Daily state = one row per (product, sku, date) holding *mergeable* values:
min/max of counters, ``max`` of the seller attributes, a "last seen" struct
ordered by (ts, sku_id) whose merge is ``max``, and exact price histograms
``array<struct<price, n>>`` whose merge is a concatenation. The median of a
merged histogram is ``percentile(price, 0.5, n)`` -- exact, and equal to the
median of the raw prices.

Both the batch job and the streaming job (``streaming.ingest``) build the
state with ``daily_state``; its first level groups on the price as well, so a
histogram never holds more entries than there are distinct prices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.orders import gap_corrected_orders

KEY = ["product_id", "sku_id", "date"]
# Columns of J1 that only snapshots from product events carry; a state has those its rows have.
EVENT_ONLY = ["seller_registration_date", "is_eco", "is_adult"]


def _event_only(df: DataFrame) -> list[Column]:
    return [F.max(c).alias(c) for c in EVENT_ONLY if c in df.columns]


def last_struct(*extra: str) -> Column:
    cols = ["ts", "sku_id", "title", "photo_key", "reviews_amount", "available_amount", "category_id", *extra]
    return F.struct(*[F.col(c) for c in cols])


def daily_state(snap: DataFrame) -> DataFrame:
    """Snapshots -> daily states, per (product, sku, date); with the registration date and flags if the snapshots have them."""
    if "date" not in snap.columns:
        snap = snap.withColumn("date", F.to_date("ts"))
    lvl1 = (snap.groupBy(*KEY, "purchase_price", "full_price")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.max("category_id").alias("category_id"),
                 F.min("total_orders_amount").alias("min_total_order_amount"),
                 F.max("total_orders_amount").alias("max_total_order_amount"),
                 F.min("available_amount").alias("min_available_amount"),
                 F.max("available_amount").alias("max_available_amount"),
                 F.max("seller_id").alias("seller_id"),
                 F.max("seller_account_id").alias("seller_account_id"),
                 F.max("seller_title").alias("seller_title"),
                 F.max("seller_link").alias("seller_link"),
                 F.max("rating").alias("rating"),
                 F.max(last_struct()).alias("last"), *_event_only(snap)))
    return merge_daily(lvl1.select(
        *KEY, "category_id", "min_total_order_amount", "max_total_order_amount",
        "min_available_amount", "max_available_amount",
        F.when(F.col("purchase_price").isNotNull(),
               F.array(F.struct(F.col("purchase_price").alias("price"), "n"))).otherwise(F.array())
        .alias("price_hist"),
        F.when(F.col("full_price").isNotNull(),
               F.array(F.struct(F.col("full_price").alias("price"), "n"))).otherwise(F.array())
        .alias("full_price_hist"),
        "seller_id", "seller_account_id", "seller_title", "seller_link", "rating", "last",
        *[c for c in EVENT_ONLY if c in snap.columns]))


def compact_hist(hist: Column) -> Column:
    """Canonical histogram: sorted by price, equal prices merged (one entry per distinct price)."""
    empty = F.array().cast("array<struct<price:bigint,n:bigint>>")

    def step(acc, x):
        last = F.element_at(acc, -1)
        merged = F.concat(F.slice(acc, 1, F.size(acc) - 1),
                          F.array(F.struct(x["price"].alias("price"), (last["n"] + x["n"]).alias("n"))))
        return F.when((F.size(acc) > 0) & (last["price"] == x["price"]), merged).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(hist), empty, step)


def finalise_daily(daily: DataFrame) -> DataFrame:
    """Daily states with the mergeable columns finalised (medians, last values) for reading.

    The regrouping is on the key the states are already partitioned by, so it
    adds no shuffle.
    """
    p = daily.select("*", F.posexplode_outer(F.concat(
        F.transform("price_hist", lambda x: F.struct(F.lit(0).alias("t"), x["price"].alias("price"), x["n"].alias("n"))),
        F.transform("full_price_hist", lambda x: F.struct(F.lit(1).alias("t"), x["price"].alias("price"),
                                                          x["n"].alias("n"))))).alias("_pos", "_h"))

    def hist_median(tag: int) -> Column:
        sel = F.col("_h.t") == tag
        return F.percentile(F.when(sel, F.col("_h.price")), F.lit(0.5), F.when(sel, F.col("_h.n")).otherwise(F.lit(0)))

    keep = [c for c in daily.columns if c not in KEY and c not in ("price_hist", "full_price_hist", "last")]
    return (p.groupBy(*KEY).agg(*[F.first(c).alias(c) for c in keep], F.first("last").alias("last"),
                                hist_median(0).alias("median_price"), hist_median(1).alias("median_full_price"))
            .select(*KEY, *keep, "median_price", "median_full_price",
                    F.col("last.title").alias("title"), F.col("last.photo_key").alias("photo_key"),
                    F.col("last.reviews_amount").alias("reviews_amount")))


def merge_daily(states: DataFrame, compact: bool = False) -> DataFrame:
    """Merge daily states with the same (product, sku, date) -- the background merge of J1.

    Histograms are concatenated; a price may then appear in several entries,
    which the weighted median treats exactly like one merged entry.
    ``compact=True`` (used when parts are rewritten) folds them to one entry
    per distinct price.
    """
    hist = compact_hist if compact else (lambda h: h)
    return (states.groupBy(*KEY)
            .agg(F.max("category_id").alias("category_id"),
                 F.min("min_total_order_amount").alias("min_total_order_amount"),
                 F.max("max_total_order_amount").alias("max_total_order_amount"),
                 F.min("min_available_amount").alias("min_available_amount"),
                 F.max("max_available_amount").alias("max_available_amount"),
                 hist(F.flatten(F.collect_list("price_hist"))).alias("price_hist"),
                 hist(F.flatten(F.collect_list("full_price_hist"))).alias("full_price_hist"),
                 F.max("seller_id").alias("seller_id"),
                 F.max("seller_account_id").alias("seller_account_id"),
                 F.max("seller_title").alias("seller_title"),
                 F.max("seller_link").alias("seller_link"),
                 F.max("rating").alias("rating"),
                 F.max("last").alias("last"), *_event_only(states)))


def product_days(daily: DataFrame, keys: list[str] | tuple = (), with_full_price: bool = False) -> DataFrame:
    """Merge daily states to (keys..., product_id, date).

    Output: ``mn, mx`` (counter), ``stock`` (min over SKUs of the day's min
    stock), ``stock_sum`` (sum over SKUs of it), ``med`` (median minor price),
    optionally ``full_med``, ``last`` (latest struct) and max seller attributes.
    One aggregation: the histograms are exploded with their position so the
    per-SKU sum counts each SKU row once.
    """
    keys = list(keys)
    tagged = F.transform("price_hist", lambda x: F.struct(F.lit(0).alias("t"), x["price"].alias("price"),
                                                           x["n"].alias("n")))
    if with_full_price:
        tagged = F.concat(tagged, F.transform("full_price_hist", lambda x: F.struct(
            F.lit(1).alias("t"), x["price"].alias("price"), x["n"].alias("n"))))
    exploded = daily.select("*", F.posexplode_outer(tagged).alias("_pos", "_h"))
    first = F.coalesce(F.col("_pos"), F.lit(0)) == 0

    def hist_median(tag: int) -> Column:
        sel = F.col("_h.t") == tag
        return F.percentile(F.when(sel, F.col("_h.price")), F.lit(0.5),
                            F.when(sel, F.col("_h.n")).otherwise(F.lit(0)))

    aggs = {"mn": F.min("min_total_order_amount"),
            "mx": F.max("max_total_order_amount"),
            "stock": F.min("min_available_amount"),
            "stock_sum": F.sum(F.when(first, F.col("min_available_amount"))),
            "med": hist_median(0),
            "last": F.max("last"),
            "seller_id": F.max("seller_id"),
            "seller_account_id": F.max("seller_account_id"),
            "seller_title": F.max("seller_title"),
            "seller_link": F.max("seller_link"),
            "rating": F.max("rating")}
    if with_full_price:
        aggs["full_med"] = hist_median(1)
    aggs = [e.alias(n) for n, e in aggs.items() if n not in keys]
    return exploded.groupBy(*keys, "product_id", "date").agg(*aggs)


def product_days_raw(snap: DataFrame, keys: list[str] | tuple = ()) -> DataFrame:
    """Same block straight from raw snapshots (used by the rollup and sales queries)."""
    keys = list(keys)
    if "date" not in snap.columns:
        snap = snap.withColumn("date", F.to_date("ts"))
    return (snap.groupBy(*keys, "product_id", "date")
            .agg(F.min("total_orders_amount").alias("mn"),
                 F.max("total_orders_amount").alias("mx"),
                 F.min("total_available_amount").alias("stock"),
                 F.percentile("purchase_price", 0.5).alias("med"),
                 F.max(last_struct("seller_id")).alias("last"),
                 F.max("seller_id").alias("seller_id"),
                 F.max("seller_account_id").alias("seller_account_id"),
                 F.max("seller_title").alias("seller_title"),
                 F.max("seller_link").alias("seller_link"),
                 F.max("rating").alias("rating")))


def with_orders(days: DataFrame, keys: list[str] | tuple = ()) -> DataFrame:
    """C-block: previous observed day's max (default 0) and gap-corrected orders.

    The window partitions by (keys..., product) -- after the per-day
    aggregation, so a partition holds one row per observed day of one product.
    """
    w = Window.partitionBy(*keys, "product_id").orderBy("date")
    return (days.withColumn("pv", F.lag("mx", 1, 0).over(w))
                .withColumn("orders", gap_corrected_orders("mn", "mx", "pv"))
                .withColumn("revenue_minor", F.col("orders") * F.col("med")))


def date_between(df: DataFrame, lo: str, hi: str, col: str = "date") -> DataFrame:
    return df.filter(F.col(col).between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))


def ts_between(df: DataFrame, lo: str, hi: str, col: str = "ts") -> DataFrame:
    return df.filter(F.col(col).between(F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz")))
