"""Storage helpers, the closure depth guard and the routed ingest stream."""

import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from mktlens.operators.hierarchy import category_closure
from mktlens.sources.events import PRODUCT_EVENT, POSITION_EVENT
from mktlens.sources.io import apply_retention, upsert
from mktlens.streaming.ingest import ingest_stream, subscription_stream


def test_closure_depth_guard(spark):
    chain = spark.createDataFrame([(i, i - 1 if i > 1 else 0, f"c{i}") for i in range(1, 12)],
                                  "category_id long, parent_category_id long, title string")
    assert category_closure(chain, max_depth=None).count() == 55
    assert category_closure(chain, max_depth=10).count() == 55
    with pytest.raises(Exception, match="deeper than 4"):
        category_closure(chain, max_depth=4).collect()


def test_upsert_latest_wins(spark):
    old = spark.createDataFrame([(1, 1, "a", "A"), (2, 1, "b", "B")], "seller_id long, account_id long, link string, title string")
    new = spark.createDataFrame([(2, 1, "b", "B1", 1), (2, 1, "b", "B2", 2), (3, 2, "c", "C", 0)],
                                "seller_id long, account_id long, link string, title string, update_seq long")
    got = {(r.seller_id, r.account_id): r.title for r in upsert(old, new, ["seller_id", "account_id"]).collect()}
    assert got == {(1, 1): "A", (2, 1): "B2", (3, 2): "C"}


def test_retention(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 3, 2),)], "ts timestamp_ntz")
    assert apply_retention(df, "ts", "2024-06-30", months=4).count() == 1
    assert apply_retention(df, "ts", "2024-03-03", days=3).count() == 1
    assert apply_retention(df, "ts", "2024-03-03", days=1).count() == 0


def test_ingest_stream_routes_and_flattens(spark):
    root = tempfile.mkdtemp(prefix="mktlens-ingest-")
    src = os.path.join(root, "src")
    os.makedirs(src)
    product = {"product_id": 7, "time": 1704067200, "title": "p", "total_available_amount": 5, "orders": 3,
               "attributes": [], "tags": [], "reviews_amount": 1, "rating": "4.5",
               "sku_list": [{"sku_id": 70, "photo_key": "x", "characteristics": [
                   {"type": "c", "title": "C1", "value": "1"}, {"type": "c", "title": "C2", "value": "2"}],
                   "purchase_price": "12.349", "full_price": "", "available_amount": 2}],
               "seller": {"id": 1, "account_id": 9, "seller_link": "s", "seller_title": "S", "reviews": 0,
                          "orders": 0, "rating": "5", "registration_date": 1600000000, "contacts": []},
               "category": {"id": 2000, "title": "t", "product_amount": 1}, "is_eco": False, "is_adult": False}
    position = {"position": 3, "product_id": 7, "sku_id": 70, "category_id": 2000, "time": 1704067200}
    for i, ev in enumerate([{"product": product}, {"position": position}, {"other": 1}]):
        with open(os.path.join(src, f"e{i}.json"), "w") as fh:
            fh.write(json.dumps(ev) + "\n")
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("product", PRODUCT_EVENT), T.StructField("position", POSITION_EVENT)])
    sinks = {k: os.path.join(root, k) for k in ("product", "position", "seller")}
    q = ingest_stream(spark, src, schema, sinks, os.path.join(root, "ckpt"), max_files_per_trigger=1)
    q.awaitTermination()
    p = spark.read.parquet(sinks["product"]).first()
    assert (p.purchase_price, p.full_price, p.characteristics, p.ts) == (1234, None, {"c": "C2"},
                                                                          dt.datetime(2024, 1, 1))
    assert spark.read.parquet(sinks["position"]).first().position == 3
    assert spark.read.parquet(sinks["seller"]).first().account_id == 9


def test_payment_stream_applies_events(spark):
    from mktlens.streaming.ingest import latest_payments, payment_stream
    root = tempfile.mkdtemp(prefix="mktlens-pay-")
    created = spark.createDataFrame(
        [(1, 10, dt.datetime(2024, 1, 1), 1500, 2, 1), (2, 11, dt.datetime(2024, 1, 2), 990, 3, 2)],
        "payment_id long, user_id long, created_at timestamp_ntz, amount_minor long, plan_code int, multiply int")
    src = os.path.join(root, "created")
    created.write.parquet(src)
    status = spark.createDataFrame([(1, "success", dt.datetime(2024, 1, 3), 1), (2, "weird", dt.datetime(2024, 1, 3), 1)],
                                   "payment_id long, status string, event_ts timestamp_ntz, event_seq long")
    q = payment_stream(spark, src, created.schema, status, os.path.join(root, "table"), os.path.join(root, "ckpt"))
    q.awaitTermination()
    got = {r.payment_id: (r.status, r.paid, r.amount, r.subscription_type)
           for r in latest_payments(spark, os.path.join(root, "table")).collect()}
    assert got == {1: ("success", True, 15.0, "advanced"), 2: ("pending", False, 9.9, "pro")}


def test_layouts_positions_reports_rollups(spark):
    from mktlens.plans.rollups import category_product_rollup, root_scope
    from mktlens.operators.daily import daily_state
    from mktlens.operators.hierarchy import scope_table
    from mktlens.sources import fixtures as X
    from mktlens.sources.io import (append_positions, read_positions, read_rollup, write_layout, write_report,
                                    write_rollup)
    root = tempfile.mkdtemp(prefix="mktlens-io-")
    sf = "/root/testdata/sf0.001"
    pos = X.positions(spark, sf)
    append_positions(pos, os.path.join(root, "pos"))
    back = read_positions(spark, os.path.join(root, "pos"))
    assert back.count() == pos.count() and back.select("yyyymm").distinct().collect()[0].yyyymm == 202401
    daily = daily_state(X.snap_events(spark, sf))
    write_layout(daily.select("category_id", "date", "product_id"), os.path.join(root, "by_cat"), ["category_id", "date"])
    assert spark.read.parquet(os.path.join(root, "by_cat")).count() == daily.count()
    write_report(pos.limit(5), os.path.join(root, "report"))
    assert spark.read.option("header", True).csv(os.path.join(root, "report")).count() == 5
    cats = X.categories(spark, sf)
    r = category_product_rollup(daily, root_scope(scope_table(cats), cats), "2024-01-31", ["WEEK", "MONTH"])
    write_rollup(r, os.path.join(root, "rollup"))
    assert read_rollup(spark, os.path.join(root, "rollup"), "WEEK", "2024-01-31").count() == \
        r.filter("period = 'WEEK'").count()


def test_ledger_stream_takes_all_files_at_once(spark):
    root = tempfile.mkdtemp(prefix="mktlens-ledger-")
    schema = "user_id long, payment_id long, created_at timestamp, status string, multiply int"
    for n, day in ((2, 20), (1, 1), (3, 25)):  # files that are not in time order
        row = (7, n, dt.datetime(2024, 1, day), "success", 1)
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{root}/source")
    q = subscription_stream(spark, f"{root}/source", spark.createDataFrame([], schema).schema, f"{root}/ledger", f"{root}/checkpoint")
    q.awaitTermination()
    got = {r.payment_id: r.subscription_end for r in spark.read.parquet(f"{root}/ledger").collect()}
    assert got == {1: dt.date(2024, 1, 31), 2: dt.date(2024, 3, 1), 3: dt.date(2024, 3, 31)}
