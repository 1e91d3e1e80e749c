"""Operators: ABC, calendar fill, carry-forward, scope, percentages, money, maps, ledger, access, keys."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mktlens.functions.numeric import money_split, percent_change, round_ratio_half_up, to_minor
from mktlens.operators.charts import calendar_fill, carry_forward
from mktlens.operators.filters import Filter, apply_filters, page, sort_columns, with_total
from mktlens.operators.hierarchy import category_closure, category_info, scope_of, scope_table
from mktlens.plans.accounts import access_check, plans, shared_keys, subscription_ledger
from mktlens.plans.reports import abc_class


def test_abc_classes_and_ties(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([50, 30, 10, 10, 0])] + [(2, 0, 0), (2, 1, 0)],
                               "k long, id long, v long")
    got = {(r.k, r.id): r.c for r in abc_class(df, "v", ["k"], "c").collect()}
    assert [got[(1, i)] for i in range(5)] == ["A", "A", "B", "B", "C"]
    assert got[(2, 0)] is None and got[(2, 1)] is None


def test_calendar_fill_and_carry_forward(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 2), 5), (1, dt.date(2024, 1, 4), 7)], "k long, date date, v long")
    filled = calendar_fill(df, ["k"], "2024-01-01", "2024-01-05", {"v": 0}).orderBy("date").collect()
    assert [(r.date.day, r.v) for r in filled] == [(1, 0), (2, 5), (3, 0), (4, 7)]
    raw = calendar_fill(df, ["k"], "2024-01-01", "2024-01-05", {})
    cf = carry_forward(raw, ["k"], ["v"]).orderBy("date").collect()
    assert [r.v for r in cf] == [None, 5, 5, 7]


def test_scope_rules(spark):
    cats = spark.createDataFrame([(1, 0, "a"), (2, 1, "b"), (3, 1, "c"), (4, 2, "d")],
                                 "category_id long, parent_category_id long, title string")
    clo = category_closure(cats)
    sc = scope_table(cats, clo)
    got = {}
    for r in sc.collect():
        got.setdefault(r.scope_id, set()).add(r.category_id)
    assert got == {1: {2, 3, 4}, 2: {4}, 3: {3}, 4: {4}}
    assert {(r.scope_id, r.category_id) for r in scope_of(cats, 9, clo).collect()} == {(9, 9)}
    assert {r.category_id for r in scope_of(cats, 1, clo).collect()} == {2, 3, 4}
    assert {r.category_id for r in scope_of(cats, 3, clo).collect()} == {3}
    info = {r.category_id: r.children_ids for r in category_info(cats).collect()}
    assert info[1] == [2, 3] and info[4] == []
    depth = {(r.ancestor, r.descendant): r.depth for r in clo.collect()}
    assert depth[(1, 4)] == 2 and (4, 4) not in depth


def test_percentage_and_rounding(spark):
    df = spark.createDataFrame([(0.0, 5.0), (100.0, 150.0), (7.0, 9.0), (4.0, 3.0)], "a double, b double")
    assert [r.p for r in df.select(percent_change(F.col("a"), F.col("b")).alias("p")).collect()] == [0.0, 50.0, 28.5,
                                                                                                     -25.0]
    r = spark.createDataFrame([(5, 2), (-5, 2), (1, 3), (2, 3)], "a long, b long")
    assert [x.v for x in r.select(round_ratio_half_up(F.col("a"), F.col("b"), 0).alias("v")).collect()] == \
        [3.0, -3.0, 0.0, 1.0]


def test_money_and_minor_units(spark):
    row = spark.createDataFrame([("12.345678901234", "12.349", "")], "m string, p string, e string").select(
        money_split(F.col("m").cast("decimal(38,12)")).alias("s"), to_minor(F.col("p")).alias("p"),
        to_minor(F.col("e")).alias("e")).first()
    assert (row.s.units, row.s.nanos, row.s.currency_code) == (12, 345678901, 643)
    assert row.p == 1234 and row.e is None


def test_filters_sort_page(spark):
    df = spark.createDataFrame([(1, i, f"Item_{i}", i * 10) for i in range(10)], "k long, product_id long, title string, v long")
    f = apply_filters(df, [Filter.contains("title", "item_"), Filter.between("v", 20, 80)])
    assert f.count() == 7
    assert apply_filters(df, [Filter.contains("title", "m%")]).count() == 0
    with pytest.raises(ValueError):
        apply_filters(df, [Filter.eq("nope", 1)])
    p = page(with_total(f, ["k"]), ["k"], sort_columns([("v", "desc")], {"v"}, "product_id"), 3, 2).collect()
    assert [r.v for r in p] == [60, 50, 40] and all(r.total_row_count == 7 for r in p)


def test_subscription_ledger_fold(spark):
    pay = spark.createDataFrame(
        [(1, 1, dt.datetime(2024, 1, 10), "success", 1), (2, 1, dt.datetime(2024, 1, 20), "success", 2),
         (3, 1, dt.datetime(2024, 9, 1), "success", 1), (4, 1, dt.datetime(2024, 9, 2), "failed", 1)],
        "payment_id long, user_id long, created_at timestamp_ntz, status string, multiply long")
    got = [(r.payment_id, r.subscription_end) for r in subscription_ledger(pay).orderBy("payment_id").collect()]
    assert got == [(1, dt.date(2024, 2, 9)), (2, dt.date(2024, 4, 9)), (3, dt.date(2024, 10, 1))]


def test_access_rules(spark):
    users = spark.createDataFrame([(1, "default", dt.date(2024, 2, 1)), (2, "default", dt.date(2024, 1, 1))],
                                  "user_id long, subscription_type string, subscription_end_at date")
    req = spark.createDataFrame([(1, 1, 31, dt.date(2023, 12, 31)), (2, 1, 30, dt.date(2024, 1, 1)),
                                 (3, 1, 0, dt.date(2024, 1, 31)), (4, 2, 10, dt.date(2024, 1, 21)),
                                 (5, 2, 0, dt.date(2024, 1, 31))],
                                "request_id long, user_id long, days int, from_date date")
    got = {r.request_id: r.days_access for r in access_check(req, users, plans(spark), "2024-01-31").collect()}
    assert got == {1: "PROHIBIT", 2: "PERMIT", 3: "PERMIT", 4: "PROHIBIT", 5: "PERMIT"}


def test_shared_keys(spark):
    t = dt.datetime(2024, 1, 1, 1)
    rows = ([(1, 0, 0, t), (1, 1, 0, t)] + [(2, ip, 0, t) for ip in range(7)] + [(3, 0, b, t) for b in range(4)])
    df = spark.createDataFrame(rows, "api_key long, ip long, browser long, ts timestamp_ntz")
    got = {r.api_key: r.flagged for r in shared_keys(df).collect()}
    assert got == {1: False, 2: True, 3: True}


def test_map_last_wins_and_strict(spark):
    from mktlens.sources.events import list_to_map_last, list_to_map_strict
    df = spark.createDataFrame([([("a", "A", "1"), ("b", "B", "2"), ("a", "A", "3")],)],
                               "kv array<struct<type:string,title:string,value:string>>")
    assert df.select(list_to_map_last(F.col("kv")).alias("m")).first().m == {"a": "3", "b": "2"}
    with pytest.raises(Exception):
        df.select(list_to_map_strict(F.col("kv"))).collect()


def test_one_row_for_unknown_entity(spark):
    from mktlens.operators.filters import one_row_for
    df = spark.createDataFrame([("s1", 5, 1.5)], "seller_link string, order_amount long, revenue double")
    got = one_row_for(df, "seller_link", "nobody", {"order_amount": 0, "revenue": 0.0}).collect()
    assert [(r.seller_link, r.order_amount, r.revenue) for r in got] == [("nobody", 0, 0.0)]
    assert one_row_for(df, "seller_link", "s1", {"order_amount": 0}).first().order_amount == 5


def test_sort_cards_whitelist(spark):
    from mktlens.plans.rollups import sort_cards
    df = spark.createDataFrame([(1, 10, 2.0), (2, 30, 1.0), (3, 20, 3.0)], "category_id long, order_amount long, revenue double")
    assert [r.category_id for r in sort_cards(df, [("order_amount", "desc")]).collect()] == [2, 3, 1]
    assert [r.category_id for r in sort_cards(df, [("revenue", None)]).collect()] == [2, 1, 3]
    with pytest.raises(ValueError):
        sort_cards(df, [("title", "asc")])


def test_grants(spark):
    from mktlens.plans.accounts import apply_grants
    users = spark.createDataFrame([(1, "default", dt.date(2024, 2, 1)), (2, None, None)],
                                  "user_id long, subscription_type string, subscription_end_at date")
    grants = spark.createDataFrame(
        [(1, "set", "pro", 10, dt.datetime(2024, 1, 10)),      # active until 02-01 -> extended to 02-11
         (1, "demo", None, 5, dt.datetime(2024, 1, 11)),       # rejected: user has a plan
         (2, "demo", None, 7, dt.datetime(2024, 1, 5)),        # first demo wins
         (2, "demo", None, 9, dt.datetime(2024, 1, 6)),
         (3, "set", "advanced", 30, dt.datetime(2024, 1, 1))],  # new user
        "user_id long, kind string, subscription_type string, days int, granted_at timestamp_ntz")
    got = {r.user_id: (r.subscription_type, r.subscription_end_at) for r in apply_grants(users, grants).collect()}
    assert got == {1: ("pro", dt.date(2024, 2, 11)), 2: ("demo", dt.date(2024, 1, 12)),
                   3: ("advanced", dt.date(2024, 1, 31))}
