"""Period rollups (J2, J3, J4) and the queries reading them (Q10, Q13, Q16, Q17).

One job covers every root category and every period: a snapshot / daily row
is tagged with the period windows containing it by a projection
(``explode(filter(array(windows)))``, no join), partial aggregation runs right
after the tagging in the same stage, so the shuffle carries product-day
aggregates rather than raw rows.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import percent_change, round_ratio_half_up
from ..functions.orders import gap_corrected_orders
from ..functions.sketch import hist_median
from ..operators.charts import ordered_array
from ..operators.daily import compact_hist, last_struct
from ..operators.distincts import count_states
from ..operators.filters import Filter, apply_filters, page, sort_columns, with_total
from ..operators.hierarchy import category_info
from ..operators.medians import group_medians
from ..session import stored

# Period lengths in days.
PERIODS = {"WEEK": 7, "TWO_WEEK": 14, "MONTH": 30, "TWO_MONTH": 60}


def period_bounds(as_of: str, period: str, previous: bool = False) -> tuple[dt.date, dt.date]:
    """(from, to) of a period ending at ``as_of`` (both inclusive), or of the period before it."""
    a = dt.date.fromisoformat(as_of)
    n = PERIODS[period]
    return (a - dt.timedelta(2 * n), a - dt.timedelta(n)) if previous else (a - dt.timedelta(n), a)


def _bounds(as_of: str | dict[str, Column], period: str, previous: bool) -> tuple[Column, Column]:
    """``period_bounds`` as columns, of a fixed date or of a date column for each period."""
    if isinstance(as_of, str):
        lo, hi = period_bounds(as_of, period, previous)
        return F.lit(lo), F.lit(hi)
    n = PERIODS[period]
    end = F.date_sub(as_of[period], n) if previous else as_of[period]
    return F.date_sub(end, n), end


def _windows(as_of: str | dict[str, Column], periods: list[str], with_prev: bool, ts: bool) -> list[tuple[str, str, Column, Column]]:
    """(period, kind, first, last) of every window."""
    of = "timestamp_ntz" if ts else "date"
    bounds = [(p, kind, _bounds(as_of, p, kind == "prev")) for p in periods for kind in (["cur", "prev"] if with_prev else ["cur"])]
    return [(p, kind, lo.cast(of), hi.cast(of)) for p, kind, (lo, hi) in bounds]


def tag_windows(df: DataFrame, col: str, as_of: str | dict[str, Column], periods: list[str], with_prev: bool = True,
                ts: bool = False) -> DataFrame:
    """One output row per (input row, period window containing ``col``); adds ``period`` and ``kind``.

    ``as_of`` is the windows' last day, or a date column (a scalar subquery, say) for each period. The overall range is
    filtered first so the scan prunes row groups / partitions.
    """
    ranges = [(_bounds(as_of, p, with_prev)[0], _bounds(as_of, p, False)[1]) for p in periods]
    if isinstance(as_of, str):  # the ranges end on one day: the longest holds the others
        ranges = [ranges[max(range(len(periods)), key=lambda i: PERIODS[periods[i]])]]
    c = F.col(col)
    of = "timestamp_ntz" if ts else "date"
    inside = reduce(lambda a, b: a | b, [c.between(lo.cast(of), hi.cast(of)) for lo, hi in ranges])
    hit = [F.when(c.between(lo, hi), F.struct(F.lit(p).alias("period"), F.lit(kind).alias("kind")))
           for p, kind, lo, hi in _windows(as_of, periods, with_prev, ts)]
    return (df.filter(inside).select("*", F.explode(F.array(*hit)).alias("_w")).filter("_w IS NOT NULL")
            .select("*", F.col("_w.period").alias("period"), F.col("_w.kind").alias("kind")).drop("_w"))


def root_scope(scope: DataFrame, categories: DataFrame) -> DataFrame:
    """(scope_id = root, category_id) for every root category."""
    roots = categories.filter(F.col("parent_category_id") == 0).select(F.col("category_id").alias("scope_id"))
    return scope.join(roots, "scope_id")


# --------------------------------------------------------------------------- J2

def category_product_rollup(daily: DataFrame, roots: DataFrame, as_of: str, periods: list[str]) -> DataFrame:
    """Per (period, category, product) states over the period's days, for every root at once.

    Stored columns: max / min of the day maxima of the counter, a histogram of
    the SKU-day median prices (truncated to integers), and the last (date,
    sku) values of title, photo, reviews, rating and the product-day stock sum.
    """
    from pyspark.sql import Window

    d = daily.join(roots, "category_id")
    # W3 (sum over the product's SKUs, within the root, of the day's min stock) and the SKU-day median price are
    # computed once per daily row, before the rows are copied into their period windows
    d = (d.withColumn("stock_day", F.sum("min_available_amount").over(Window.partitionBy("scope_id", "product_id", "date")))
         .withColumn("price", hist_median(F.col("price_hist")).cast("long"))
         .drop("price_hist", "full_price_hist"))
    d = tag_windows(d, "date", as_of, periods, with_prev=False)
    last = F.struct("date", "sku_id", F.col("last.title").alias("title"), F.col("last.photo_key").alias("photo_key"),
                    F.col("last.reviews_amount").alias("reviews_amount"), "rating",
                    F.col("stock_day").alias("available_amount"))
    lvl1 = (d.groupBy("period", "category_id", "product_id", "price")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.max("max_total_order_amount").alias("max_total_order_amount"),
                 F.min("max_total_order_amount").alias("min_total_order_amount"),
                 F.max(last).alias("last")))
    return (lvl1.groupBy("period", "category_id", "product_id")
            .agg(F.max("max_total_order_amount").alias("max_total_order_amount"),
                 F.min("min_total_order_amount").alias("min_total_order_amount"),
                 compact_hist(F.collect_list(F.when(F.col("price").isNotNull(),
                                                    F.struct("price", "n")))).alias("price_hist"),
                 F.max("last").alias("last"))
            .withColumn("as_of", F.lit(as_of).cast("date")))


def finalise_product_rollup(r: DataFrame) -> DataFrame:
    return r.select("period", "as_of", "category_id", "product_id", F.col("last.title").alias("title"),
                    "max_total_order_amount", "min_total_order_amount",
                    hist_median(F.col("price_hist")).alias("median_price"),
                    F.col("last.reviews_amount").alias("reviews_amount"), F.col("last.photo_key").alias("photo_key"),
                    F.col("last.rating").alias("rating"), F.col("last.available_amount").alias("available_amount"))


# --------------------------------------------------------------------------- J3

def _ratios(df: DataFrame, p: str = "") -> DataFrame:
    oa, rev = F.col(f"{p}order_amount"), F.col(f"{p}revenue")
    pc, sc = F.col(f"{p}product_count"), F.col(f"{p}seller_count")
    return (df.withColumn(f"{p}avg_bill", F.when(oa > 0, rev / oa).otherwise(F.lit(0.0)))
              .withColumn(f"{p}order_per_product", F.try_divide(oa.cast("double"), pc))
              .withColumn(f"{p}order_per_seller", F.try_divide(oa.cast("double"), sc))
              .withColumn(f"{p}revenue_per_product", F.when(oa > 0, F.try_divide(rev, pc)).otherwise(F.lit(0.0))))


ENTITY_COUNTS = {"seller_id": "seller_count", "product_id": "product_count"}
J3_COLS = ["order_amount", "available_amount", "revenue", "median_price", "avg_bill", "seller_count",
           "product_count", "order_per_product", "order_per_seller", "revenue_per_product"]


def category_rollup(snap: DataFrame, states: DataFrame, roots: DataFrame, as_of: str, periods: list[str],
                    how: str = "inner") -> DataFrame:
    """Per (period, category) metrics for the period and the one before, from raw snapshots.

    ``states``: the distinct-count states of the daily table (``operators.distincts``). The product-days of all windows
    are stored before they are summed and their medians taken, so this runs when it is called.

    Raw windows run from midnight to midnight (both inclusive). The category of
    a product-day is its last one; distinct sellers / products are counted over
    the whole root (quirk kept: they repeat on every category row of the root).
    """
    raw = tag_windows(snap.join(roots, "category_id"), "ts", as_of, periods, ts=True)
    if "date" not in raw.columns:
        raw = raw.withColumn("date", F.to_date("ts"))
    k = ["period", "kind", "scope_id"]
    days = (raw.groupBy(*k, "product_id", "date")
            .agg(F.min("total_orders_amount").alias("mn"), F.max("total_orders_amount").alias("mx"),
                 F.min("total_available_amount").alias("stock"),
                 F.percentile("purchase_price", 0.5).alias("med"),
                 F.max(last_struct()).alias("last")))
    from ..operators.daily import with_orders
    days = with_orders(days, k).select(*k, F.col("last.category_id").alias("category_id"), "orders", "stock", "revenue_minor", "med")
    days = stored(days, "product-days")  # sums and medians of both kinds of windows read it; the snapshots are read once
    per_cat = (days.groupBy(*k, "category_id")
               .agg(F.sum("orders").alias("order_amount"), F.sum("stock").alias("available_amount"),
                    F.sum("revenue_minor").alias("revenue")))
    medians = group_medians(days, [*k, "category_id"], F.col("med"))
    dist = count_states(tag_windows(states.join(roots, "category_id"), "date", as_of, periods), k, ENTITY_COUNTS)
    m = (per_cat.join(medians, [*k, "category_id"], "left").join(dist, k)
         .withColumn("median_price", F.when(F.col("order_amount") > 0, F.col("median")).otherwise(F.lit(0.0))))
    m = stored(_ratios(m), "category-windows")  # a row for each category and window, read by kind
    cur = m.filter(F.col("kind") == "cur").select("period", "scope_id", "category_id", *J3_COLS)
    prev = m.filter(F.col("kind") == "prev").select("period", "scope_id", "category_id",
                                                    *[F.col(c).alias(f"prev_{c}") for c in J3_COLS])
    return (cur.join(prev, ["period", "scope_id", "category_id"], how)
            .withColumn("as_of", F.lit(as_of).cast("date")).drop("scope_id"))


def latest_as_of(rollup: DataFrame) -> DataFrame:
    """The newest ``as_of`` per period."""
    return rollup.groupBy("period").agg(F.max("as_of").alias("as_of"))


def newest_as_of(rollup: DataFrame, period: str) -> Column:
    """S18 as a scalar subquery: the newest stored ``as_of`` of a period, null if nothing is stored."""
    return rollup.filter(F.col("period") == period).agg(F.max("as_of")).scalar()


def rollup_at(rollup: DataFrame, periods: list[str], as_of: str | None = None) -> DataFrame:
    """The rollup's rows of some periods at ``as_of``, or at each period's newest stored date.

    The newest dates are scalar subqueries in the partition filter: they run first and the scan then lists
    the folders of these dates only.
    """
    if as_of is not None:
        return rollup.filter((F.col("as_of") == F.lit(as_of).cast("date")) & F.col("period").isin(periods))
    newest = [(F.col("period") == p) & (F.col("as_of") == newest_as_of(rollup, p)) for p in periods]
    return rollup.filter(reduce(lambda a, b: a | b, newest))


# --------------------------------------------------------------------------- J4

def category_daily_stats(snap: DataFrame) -> DataFrame:
    """Per (category, day) statistics over the whole snapshot table (unclamped orders, as historically)."""
    from pyspark.sql import Window

    if "date" not in snap.columns:
        snap = snap.withColumn("date", F.to_date("ts"))
    days = (snap.groupBy("product_id", "date")
            .agg(F.min("total_orders_amount").alias("mn"), F.max("total_orders_amount").alias("mx"),
                 F.min("total_available_amount").alias("stock"), F.percentile("purchase_price", 0.5).alias("med"),
                 F.max(last_struct("seller_id")).alias("last")))
    pv = F.lag("mx", 1, 0).over(Window.partitionBy("product_id").orderBy("date"))
    days = days.withColumn("pv", pv).withColumn("o", F.col("mx") - F.when(F.col("pv") > 0, F.col("pv"))
                                                 .otherwise(F.col("mn")))
    sold = F.col("o") > 0
    days = days.select("product_id", "date", F.col("last.category_id").alias("category_id"), "med", "stock", "o",
                       F.col("last.seller_id").alias("seller_id"))
    k = ["category_id", "date"]
    # a product has one row a day, so products are counted as rows; sellers are rows of the first aggregation
    per_seller = (days.groupBy(*k, "seller_id")
                  .agg(F.sum(F.when(sold, F.col("o"))).alias("orders"), F.sum("stock").alias("stock"),
                       F.sum(F.col("med") * F.col("o")).alias("revenue"), F.count("product_id").alias("products"),
                       F.count(F.when(sold, F.col("product_id"))).alias("sold_products"), F.max(sold).alias("sold")))
    totals = (per_seller.groupBy(*k)
              .agg(F.coalesce(F.sum("orders"), F.lit(0).cast("long")).alias("orders"), F.sum("stock").alias("available_amount"),
                   F.sum("revenue").alias("revenue"), F.count("seller_id").alias("seller_count"),
                   F.sum("products").alias("product_count"),
                   F.count(F.when(F.col("sold"), F.col("seller_id"))).alias("seller_with_sales"),
                   F.sum("sold_products").alias("product_with_sales")))
    every = days.select(*k, "med", F.explode(F.when(sold, F.array(F.lit("sold"), F.lit("all"))).otherwise(F.array(F.lit("all")))).alias("of"))
    medians = (group_medians(every, [*k, "of"], F.col("med")).groupBy(*k)
               .agg(F.max(F.when(F.col("of") == "all", F.col("median"))).alias("median_price_all"),
                    F.max(F.when(F.col("of") == "sold", F.col("median"))).alias("median_price_with_sales")))
    same = F.col("t.category_id").eqNullSafe(F.col("m.category_id")) & F.col("t.date").eqNullSafe(F.col("m.date"))
    return totals.alias("t").join(medians.alias("m"), same, "left").select(
        "t.category_id", "t.date", "orders", "available_amount", "median_price_all", "median_price_with_sales", "revenue",
        "seller_count", "product_count", "seller_with_sales", "product_with_sales")


# --------------------------------------------------------------------------- Q10 / Q16

Q10_COLS = ["order_amount", "available_amount", "revenue", "avg_bill", "seller_count", "product_count",
            "order_per_product", "order_per_seller", "revenue_per_product"]


def category_with_prev(rollup: DataFrame, states: DataFrame, scope: DataFrame, as_of: str | None,
                       periods: list[str]) -> DataFrame:
    """Q10: current and previous period metrics for every category scope, from the J3 rows at ``as_of`` (without one: at
    each period's newest stored date).

    Sums come from the rollup; distinct sellers / products from the daily table's states
    (``operators.distincts``), merged over each window within the scope itself. A ratio to a count is null where the states
    of its window are gone (retention) but the rollup still has orders.
    """
    r = rollup_at(rollup, periods, as_of)
    s = (r.join(scope, "category_id").groupBy("period", "scope_id")
         .agg(*[F.sum(c).alias(c) for c in ["order_amount", "available_amount", "prev_order_amount",
                                            "prev_available_amount"]],
              (F.sum("revenue") / 100).alias("revenue"), (F.sum("prev_revenue") / 100).alias("prev_revenue")))
    ends = as_of if as_of is not None else {p: newest_as_of(rollup, p) for p in periods}
    windows = tag_windows(states, "date", ends, periods).join(scope, "category_id")
    windows = windows.withColumn("entity", F.concat("kind", F.lit(":"), "entity"))
    names = {f"{kind}:{e}": pre + n for kind, pre in (("cur", ""), ("prev", "prev_")) for e, n in ENTITY_COUNTS.items()}
    dist = count_states(windows, ["period", "scope_id"], names)
    out = s.join(dist, ["period", "scope_id"], "left")
    for p in ("", "prev_"):
        oa, rev = F.col(f"{p}order_amount"), F.col(f"{p}revenue")
        pc, sc = F.col(f"{p}product_count"), F.col(f"{p}seller_count")
        out = (out.withColumn(f"{p}avg_bill", F.when(oa > 0, rev / oa).otherwise(F.lit(0.0)))
               .withColumn(f"{p}order_per_product", F.when(oa > 0, F.try_divide(oa, pc)).otherwise(F.lit(0.0)))
               .withColumn(f"{p}order_per_seller", F.when(oa > 0, F.try_divide(oa, sc)).otherwise(F.lit(0.0)))
               .withColumn(f"{p}revenue_per_product", F.when(oa > 0, F.try_divide(rev, pc)).otherwise(F.lit(0.0))))
    return out.select("period", F.col("scope_id").alias("category_id"), *Q10_COLS, *[f"prev_{c}" for c in Q10_COLS])


DIFF_METRICS = ["revenue", "revenue_per_product", "order_amount", "product_count", "seller_count", "avg_bill",
                "order_per_seller", "order_per_product"]
CARD_SORT_FIELDS = {"order_amount", "revenue", "average_bill", "seller_count", "product_count", "order_per_product",
                    "order_per_seller", "revenue_per_product"}


def category_cards(q10: DataFrame, categories: DataFrame) -> DataFrame:
    """Q16: Q10 values rounded to 2 decimals (HALF_UP, exact), percentage changes, and node info.

    Money ratios are rounded from their exact integer numerators (twice the
    minor-unit revenue) so the result does not depend on binary rounding.
    """
    out = q10
    for p in ("", "prev_"):
        oa, pc, sc = F.col(f"{p}order_amount"), F.col(f"{p}product_count"), F.col(f"{p}seller_count")
        rev2 = F.round(F.col(f"{p}revenue") * 200).cast("long")  # 2 x revenue in minor units, exact integer
        pos = oa > 0
        out = (out.withColumn(f"{p}revenue_r", round_ratio_half_up(rev2, F.lit(200), 2))
               .withColumn(f"{p}avg_bill_r", F.when(pos, round_ratio_half_up(rev2, oa * 200, 2)).otherwise(0.0))
               .withColumn(f"{p}order_per_product_r", F.when(pos, round_ratio_half_up(oa, pc, 2)).otherwise(0.0))
               .withColumn(f"{p}order_per_seller_r", F.when(pos, round_ratio_half_up(oa, sc, 2)).otherwise(0.0))
               .withColumn(f"{p}revenue_per_product_r",
                           F.when(pos, round_ratio_half_up(rev2, pc * 200, 2)).otherwise(0.0)))
    diffs = [percent_change(F.col(f"prev_{m}").cast("double"), F.col(m).cast("double")).alias(f"{m}_diff")
             for m in DIFF_METRICS]
    cols = []
    for p in ("", "prev_"):
        cols += [F.col(f"{p}order_amount"), F.col(f"{p}revenue_r").alias(f"{p}revenue"),
                 F.col(f"{p}avg_bill_r").alias(f"{p}average_bill"), F.col(f"{p}seller_count"),
                 F.col(f"{p}product_count"), F.col(f"{p}order_per_product_r").alias(f"{p}order_per_product"),
                 F.col(f"{p}order_per_seller_r").alias(f"{p}order_per_seller"),
                 F.col(f"{p}revenue_per_product_r").alias(f"{p}revenue_per_product")]
    return (out.select("period", "category_id", *cols, *diffs)
            .join(category_info(categories), "category_id"))


def sort_cards(cards: DataFrame, sort: list[tuple[str, str]]) -> DataFrame:
    """multi-key sort over the eight card metrics; an unknown field is an error."""
    return cards.orderBy(*sort_columns(sort, CARD_SORT_FIELDS, tie_breaker="category_id"))


# --------------------------------------------------------------------------- Q13 / Q17

PRODUCT_FIELDS = {"product_id", "title", "order_amount", "price", "revenue", "available_amount", "reviews_amount",
                  "photo_key", "rating"}


def category_products(rollup: DataFrame, scope: DataFrame, as_of: str | None, periods: list[str],
                      filters: list[Filter], sort: list[tuple[str, str]], limit: int | None = None,
                      offset: int = 0) -> DataFrame:
    """Q13: products of every scope from the J2 rollup at ``as_of`` (without one: at the newest stored date); user filters;
    with a limit, the page per scope in that order."""
    r = rollup_at(rollup, periods, as_of)
    e = r.join(scope, "category_id").select("*", F.explode_outer("price_hist").alias("_h"))
    agg = (e.groupBy("period", "scope_id", "product_id")
           .agg(F.max("last").alias("l"),
                (F.max("max_total_order_amount") - F.min("min_total_order_amount")).alias("order_amount"),
                F.percentile(F.col("_h.price"), F.lit(0.5), F.coalesce(F.col("_h.n"), F.lit(0))).alias("_med")))
    rows = agg.select("period", F.col("scope_id").alias("category_id"), "product_id",
                      F.col("l.title").alias("title"), "order_amount",
                      (F.col("_med") / 100).alias("price"),
                      (F.col("_med") / 100 * F.col("order_amount")).alias("revenue"),
                      F.col("l.available_amount").alias("available_amount"),
                      F.col("l.reviews_amount").alias("reviews_amount"),
                      F.col("l.photo_key").alias("photo_key"), F.col("l.rating").alias("rating"))
    rows = with_total(apply_filters(rows, filters, PRODUCT_FIELDS), ["period", "category_id"])
    return page(rows, ["period", "category_id"], sort_columns(sort, PRODUCT_FIELDS, tie_breaker="product_id"),
                limit, offset)


def category_products_with_chart(products: DataFrame, daily: DataFrame, as_of: str, periods: list[str]) -> DataFrame:
    """Q17: a Q13 page plus each product's order chart over the period (rating to 1 decimal, HALF_UP)."""
    d = tag_windows(daily.join(products.select("product_id").distinct(), "product_id", "left_semi"),
                    "date", as_of, periods, with_prev=False)
    chart = (d.groupBy("period", "product_id", "date")
             .agg((F.max("max_total_order_amount") - F.min("min_total_order_amount")).alias("o"))
             .groupBy("period", "product_id").agg(ordered_array("o").alias("order_amount_chart")))
    return (products.join(chart, ["period", "product_id"], "left")
            .withColumn("rating", F.round("rating", 1).cast("double")))
