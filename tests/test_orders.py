"""Hand-built cases for the order counter rules (FIXTURES.md section 3)."""

import datetime as dt

from pyspark.sql import functions as F

from mktlens.functions.orders import gap_corrected_orders, stock_delta_orders
from mktlens.operators.daily import daily_state, product_days, with_orders

D = dt.date


def _snap(spark, rows):
    """rows: (product, date, counter, stock, price)."""
    data = []
    for i, (p, d, c, s, price) in enumerate(rows):
        data.append((dt.datetime.combine(d, dt.time(0, 0, i % 60)), p, p * 10, "t", 1, c, s * 3, s, "ph", 1, 1,
                     "shop", "seller-1", None, price))
    schema = ("ts timestamp_ntz, product_id long, sku_id long, title string, category_id long, "
              "total_orders_amount long, total_available_amount long, available_amount long, photo_key string, "
              "seller_id long, seller_account_id long, seller_title string, seller_link string, full_price long, "
              "purchase_price long")
    return (spark.createDataFrame(data, schema)
            .withColumn("rating", F.lit(1).cast("decimal(9,2)")).withColumn("reviews_amount", F.lit(0).cast("long")))


def test_gap_corrected_hand_cases(spark):
    rows = [(1, D(2024, 1, 1), 10, 1, 100), (1, D(2024, 1, 1), 12, 1, 100),
            (1, D(2024, 1, 2), 12, 1, 100), (1, D(2024, 1, 2), 15, 1, 100),
            (1, D(2024, 1, 4), 18, 1, 100), (1, D(2024, 1, 4), 20, 1, 100),
            (1, D(2024, 1, 5), 3, 1, 100), (1, D(2024, 1, 5), 4, 1, 100),
            (1, D(2024, 1, 6), 4, 1, 100), (1, D(2024, 1, 6), 9, 1, 100),
            (2, D(2024, 1, 1), 0, 1, 100),
            (2, D(2024, 1, 2), 2, 1, 100), (2, D(2024, 1, 2), 5, 1, 100)]
    got = {(r.product_id, r.date.day): r.orders
           for r in with_orders(product_days(daily_state(_snap(spark, rows)))).collect()}
    assert got == {(1, 1): 2, (1, 2): 3, (1, 4): 5, (1, 5): 0, (1, 6): 5, (2, 1): 0, (2, 2): 3}


def test_closed_form_equals_four_branch_rule(spark):
    n = 12
    df = spark.range(n ** 3).select((F.col("id") % n).alias("a"), ((F.col("id") / n).cast("long") % n).alias("b"),
                                    (F.col("id") / (n * n)).cast("long").alias("pv"))
    df = df.select(F.least("a", "b").alias("mn"), F.greatest("a", "b").alias("mx"), "pv")
    daily = F.col("mx") - F.col("mn")
    pv, mn, mx = F.col("pv"), F.col("mn"), F.col("mx")
    four = (F.when(mn < pv, daily - (pv - mn)).when(pv - mx >= 0, daily + (pv - mx))
            .when((pv > 0) & (mn > pv), daily + (mn - pv)).otherwise(daily))
    bad = df.filter(F.greatest(four, F.lit(0)) != gap_corrected_orders("mn", "mx", "pv")).count()
    assert bad == 0


def test_monotone_counter_sums_to_range(spark):
    rows = [(7, D(2024, 1, d), c, 1, 100) for d, c in [(1, 3), (1, 5), (2, 9), (5, 11), (5, 20), (9, 21)]]
    total = (with_orders(product_days(daily_state(_snap(spark, rows)))).agg(F.sum("orders")).first()[0])
    assert total == 21 - 3


def test_stock_delta_orders(spark):
    df = spark.createDataFrame([(10, 8, 0, 2), (8, 5, 8, 3), (20, 5, 5, 0), (20, 18, 20, 0)],
                               "amax long, amin long, prev long, dc long")
    got = [r.o for r in df.select(stock_delta_orders(F.col("amax"), F.col("amin"), F.col("prev"), F.col("dc"))
                                  .alias("o")).collect()]
    assert got == [0, 3, 0, 0]


def test_median_from_histogram_equals_raw(spark):
    from mktlens.functions.sketch import hist_median
    rows = [(1, D(2024, 1, 1), 1, 1, p) for p in [1, 1, 1, 5, 5, 10]]
    d = daily_state(_snap(spark, rows))
    assert d.select(hist_median(F.col("price_hist"))).first()[0] == 3.0
    assert product_days(d).first().med == 3.0
