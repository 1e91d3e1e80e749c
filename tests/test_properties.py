"""Property checks: rule vs plain-Python reference, mergeability, closure, ABC."""

import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mktlens.operators.daily import daily_state, finalise_daily, merge_daily, product_days, with_orders
from mktlens.operators.hierarchy import category_closure
from mktlens.plans.reports import abc_class
from mktlens.sources import fixtures as X

SF = "/root/testdata/sf0.001"


def four_branch(days):
    """Reference: per observed day (mn, mx), the four-branch rule with the clamp, in plain Python."""
    out, pv = [], 0
    for mn, mx in days:
        d = mx - mn
        if mn < pv:
            r = d - (pv - mn)
        elif pv - mx >= 0:
            r = d + (pv - mx)
        elif pv > 0 and mn > pv:
            r = d + (mn - pv)
        else:
            r = d
        out.append(max(r, 0))
        pv = mx
    return out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), min_size=1, max_size=4), min_size=1, max_size=8))
def test_orders_match_reference_on_random_counters(spark, day_counters):
    rows = []
    for i, counters in enumerate(day_counters):
        for j, c in enumerate(counters):
            rows.append((dt.datetime(2024, 1, 1 + 2 * i, 0, j), 1, c))
    df = spark.createDataFrame(rows, "ts timestamp_ntz, product_id long, total_orders_amount long")
    for col, val in [("sku_id", 10), ("category_id", 1), ("available_amount", 1), ("total_available_amount", 1),
                     ("seller_id", 1), ("seller_account_id", 1), ("reviews_amount", 0), ("purchase_price", 100)]:
        df = df.withColumn(col, F.lit(val).cast("long"))
    for col in ("title", "photo_key", "seller_title", "seller_link"):
        df = df.withColumn(col, F.lit("x"))
    df = df.withColumn("full_price", F.lit(None).cast("long")).withColumn("rating", F.lit(1).cast("decimal(9,2)"))
    got = [r.orders for r in with_orders(product_days(daily_state(df))).orderBy("date").collect()]
    assert got == four_branch([(min(c), max(c)) for c in day_counters])


def test_daily_state_of_union_is_merge_of_states(spark):
    snap = X.snap_events(spark, SF)
    a, b = snap.filter(F.col("ts") < "2024-01-15 12:00:00"), snap.filter(F.col("ts") >= "2024-01-15 12:00:00")
    whole = finalise_daily(daily_state(snap))
    merged = finalise_daily(merge_daily(daily_state(a).unionByName(daily_state(b))))
    assert whole.exceptAll(merged).count() == 0 and merged.exceptAll(whole).count() == 0


def test_closure_is_transitive(spark):
    clo = category_closure(X.categories_deep(spark, SF))
    a, b = clo.alias("a"), clo.alias("b")
    implied = (a.join(b, F.col("a.descendant") == F.col("b.ancestor"))
               .select(F.col("a.ancestor").alias("ancestor"), F.col("b.descendant").alias("descendant")))
    assert implied.exceptAll(clo.select("ancestor", "descendant")).count() == 0


def test_abc_is_monotone_in_value(spark):
    rnd = random.Random(7)
    df = spark.createDataFrame([(1, i, rnd.randint(0, 50)) for i in range(200)], "k long, id long, v long")
    rows = sorted(abc_class(df, "v", ["k"], "c").collect(), key=lambda r: -r.v)
    classes = [r.c for r in rows]
    assert classes == sorted(classes)
