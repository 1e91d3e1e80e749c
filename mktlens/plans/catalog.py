"""Registered queries: fixture wiring + parameters for each operator of the inventory.

Each entry takes ``(spark, sf_dir)`` and returns a lazily planned DataFrame
over the whole input tables. Category queries answer for every scope of the
forest at once and product / seller queries for every product / seller, so
nothing is cut to an id subset.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import daily as D
from ..operators import distincts as DI
from ..operators import hierarchy as H
from ..sources import fixtures as X
from . import categories as C
from . import positions as P
from . import products as PR
from . import rollups as R
from ..functions.numeric import money_split, product_url
from ..operators.filters import Filter, eq_filter, in_filter, page, range_filter, rows_for, sort_columns, with_total
from ..session import materialize_dimension, stored
from . import sellers as SE
from . import accounts as AC
from . import report_store as RS
from . import reports as RP
from ..operators import sketches as SK
from ..sources import events as EVT
from ..sources import io as IO
from ..sources import versions as V
from ..sources.schema import DAILY
from ..streaming import ingest as ST
from ..streaming import replay as RE

# Query parameters (fixed values of the registered queries).
EV_FROM, EV_TO = "2024-01-02", "2024-01-30"
EV_TS_FROM, EV_TS_TO = "2024-01-02 00:00:00", "2024-01-30 23:59:59.999999"


def _events_daily(spark, sf):
    return D.daily_state(X.snap_events(spark, sf))


def _cats(spark, sf):
    return materialize_dimension(X.categories(spark, sf))


def _scope(spark, sf, cats=None):
    return materialize_dimension(H.scope_table(cats if cats is not None else _cats(spark, sf)))


def q_category_daily(spark: SparkSession, sf: str) -> DataFrame:
    return C.category_daily(_events_daily(spark, sf), _scope(spark, sf), EV_FROM, EV_TO)


def _stored_states(spark, daily):
    """The distinct-count states of a daily table, written and read back."""
    path = ST.scratch_root(spark, "distinct-states")
    # both entities' values are numbered and then set as bits: four reads of these columns, one daily table
    ids = stored(daily.select(*DI.STATE_KEYS, "seller_id", "product_id"), "daily-entities")
    DI.write_states(DI.entity_states(ids), path)
    return DI.read_states(spark, path)


def q_category_adhoc(spark, sf):
    daily = _events_daily(spark, sf)
    return C.category_adhoc(daily, _scope(spark, sf), EV_FROM, EV_TO, _stored_states(spark, daily))


def q_category_overall(spark, sf):
    return C.category_overall(X.snap_events(spark, sf), _scope(spark, sf), EV_TS_FROM, EV_TS_TO)


def q_category_report(spark, sf):
    cats = _cats(spark, sf)
    return C.category_sales_report(_events_daily(spark, sf), _scope(spark, sf, cats), cats,
                                   EV_FROM, EV_TO)


def q_category_closure(spark, sf):
    return H.category_closure(X.categories_deep(spark, sf))


def q_category_info(spark, sf):
    return H.category_info(X.categories(spark, sf))


def q_daily_state(spark, sf):
    return D.finalise_daily(_events_daily(spark, sf))


def q_first_discovered(spark, sf):
    return PR.first_discovered(X.snap_events(spark, sf))


def q_sku_history(spark, sf):
    return PR.sku_history(X.snap_events(spark, sf), EV_TS_FROM, EV_TS_TO)


def q_products_sales(spark, sf):
    return PR.products_sales(X.snap_events(spark, sf), EV_TS_FROM, EV_TS_TO, EV_FROM, EV_TO)


def q_products_order_chart(spark, sf):
    return PR.products_order_chart(_events_daily(spark, sf), EV_FROM, EV_TO)


def q_product_daily_card(spark, sf):
    return PR.product_daily_card(_events_daily(spark, sf), X.categories(spark, sf), EV_FROM, EV_TO)


def q_seller_overall(spark, sf):
    return SE.seller_overall(_events_daily(spark, sf), EV_FROM, EV_TO)


def q_seller_order_dynamic(spark, sf):
    return SE.seller_order_dynamic(_events_daily(spark, sf), EV_FROM, EV_TO)


def q_seller_report(spark, sf):
    return SE.seller_sales_report(_events_daily(spark, sf), X.categories(spark, sf), EV_FROM, EV_TO)


def q_seller_card(spark, sf):
    return SE.seller_card(_events_daily(spark, sf), EV_FROM, EV_TO)


def q_seller_shops(spark, sf):
    requests = X.report_requests(spark, sf).filter(F.col("report_type") == "seller")
    return SE.seller_shops(X.sellers(spark, sf), requests.select(F.col("key").alias("link")))


def q_position_history(spark, sf):
    return P.position_history(X.positions(spark, sf), EV_FROM, EV_TO)


EV_AS_OF, LI_AS_OF = "2024-01-31", "2000-06-30"
EV_PERIODS = ["WEEK", "TWO_WEEK", "MONTH", "TWO_MONTH"]
Q13_PERIODS = LI_PERIODS = EV_PERIODS
Q13_FILTERS = [Filter.between("order_amount", 1, None)]
Q13_SORT = [("revenue", "desc")]


def _deep(spark, sf):
    cats = materialize_dimension(X.categories_deep(spark, sf))
    return cats, materialize_dimension(H.scope_table(cats))


def _j2(spark, sf, periods):
    cats = _cats(spark, sf)
    return R.category_product_rollup(_events_daily(spark, sf), R.root_scope(_scope(spark, sf, cats), cats),
                                     EV_AS_OF, periods)


def _snapshots(spark, sf):
    """The snapshots with their running totals, stored, and the distinct-count states of their daily table."""
    snap = stored(X.snap_lineitem(spark, sf), "snapshots")
    return snap, _stored_states(spark, D.daily_state(snap))


def _j3(snap, states, cats, scope, as_of=LI_AS_OF):
    return R.category_rollup(snap, states, R.root_scope(scope, cats), as_of, LI_PERIODS)


def q_category_product_rollup(spark, sf):
    return R.finalise_product_rollup(_j2(spark, sf, EV_PERIODS))


def q_category_rollup_prev(spark, sf):
    return _j3(*_snapshots(spark, sf), *_deep(spark, sf))


def q_category_daily_stats(spark, sf):
    return R.category_daily_stats(X.snap_events(spark, sf))


def _q10(spark, sf):
    cats, scope = _deep(spark, sf)
    snap, states = _snapshots(spark, sf)
    return cats, R.category_with_prev(_j3(snap, states, cats, scope), states, scope, LI_AS_OF, LI_PERIODS)


def q_category_with_prev(spark, sf):
    return _q10(spark, sf)[1]


def q_category_with_prev_newest(spark, sf):
    root = ST.scratch_root(spark, "category-rollups")
    cats, scope = _deep(spark, sf)
    snap, states = _snapshots(spark, sf)
    for as_of in ("2000-05-31", LI_AS_OF):
        IO.write_rollup(_j3(snap, states, cats, scope, as_of), root)
    return R.category_with_prev(IO.read_table(spark, root), states, scope, None, LI_PERIODS)


def q_category_cards(spark, sf):
    cats, q10 = _q10(spark, sf)
    return R.category_cards(q10, cats)


def _q13(spark, sf, daily=None):
    daily = daily if daily is not None else _events_daily(spark, sf)
    cats = _cats(spark, sf)
    scope = _scope(spark, sf, cats)
    rollup = R.category_product_rollup(daily, R.root_scope(scope, cats), EV_AS_OF, Q13_PERIODS)
    return R.category_products(rollup, scope, EV_AS_OF, Q13_PERIODS, Q13_FILTERS, Q13_SORT)


def q_category_products(spark, sf):
    return _q13(spark, sf)


def q_category_products_chart(spark, sf):
    daily = _events_daily(spark, sf)
    return R.category_products_with_chart(_q13(spark, sf, daily), daily, EV_AS_OF, Q13_PERIODS)


# One page of a product list: words in the title, a price range, sorted by two columns.
PAGE_FILTERS = [*Q13_FILTERS, Filter.contains("title", "T 1"), Filter.between("price", 1.0, None)]
PAGE_SORT, PAGE_LIMIT, PAGE_OFFSET = [("order_amount", "desc"), ("price", "asc")], 20, 2


def q_category_products_page(spark, sf):
    root = ST.scratch_root(spark, "rollups")
    cats = _cats(spark, sf)
    scope = _scope(spark, sf, cats)
    daily, roots = _events_daily(spark, sf), R.root_scope(scope, cats)
    for as_of in ("2024-01-24", EV_AS_OF):
        IO.write_rollup(R.category_product_rollup(daily, roots, as_of, Q13_PERIODS), root)
    return R.category_products(spark.read.parquet(root), scope, None, Q13_PERIODS, PAGE_FILTERS, PAGE_SORT, PAGE_LIMIT, PAGE_OFFSET)


def _seller_report_rows(spark, sf):
    return RP.report_rows(q_seller_report(spark, sf), "seller_link")


def q_seller_report_rows(spark, sf):
    return _seller_report_rows(spark, sf)


def q_abc_orders(spark, sf):
    return _seller_report_rows(spark, sf).select("seller_link", "product_id", "orders", "abc_orders")


def q_abc_revenue(spark, sf):
    rows = RP.report_rows(q_category_report(spark, sf), "category_id")
    return rows.select("category_id", "product_id", "revenue", "abc_revenue")


def q_days_in_stock(spark, sf):
    return _seller_report_rows(spark, sf).select("seller_link", "product_id", "days_in_stock", "available_amounts")


def q_reports_per_user_day(spark, sf):
    return RP.reports_per_user_day(X.report_requests(spark, sf))


def q_report_quota(spark, sf):
    return AC.report_quota(X.report_requests(spark, sf), X.users(spark, sf), AC.plans(spark), EV_AS_OF)


def q_access_check(spark, sf):
    return AC.access_check(X.access_requests(spark, sf), X.users(spark, sf), AC.plans(spark), EV_AS_OF)


def q_shared_keys(spark, sf):
    return AC.shared_keys(X.access_log(spark, sf))


def q_subscription_ledger(spark, sf):
    return AC.subscription_ledger(X.payments(spark, sf))


def q_subscription_status(spark, sf):
    return AC.subscription_status(X.users(spark, sf), EV_AS_OF)


def q_payments_applied(spark, sf):
    return AC.apply_payment_events(X.payments(spark, sf), X.payment_created_events(spark, sf),
                                   X.payment_status_events(spark, sf))


def q_payment_extensions(spark, sf):
    return AC.payment_extensions(X.payments(spark, sf), X.payment_created_events(spark, sf), X.payment_status_events(spark, sf))


def q_payments_streamed(spark, sf):
    return ST.streamed_payments(spark, X.payment_created_events(spark, sf), X.payment_status_events(spark, sf))


def q_flatten_products(spark, sf):
    return EVT.flatten_products(X.product_events(spark, sf))


def q_flatten_categories(spark, sf):
    return EVT.flatten_categories(EVT.category_nodes(X.category_events(spark, sf)))


def q_event_routing(spark, sf):
    r = EVT.route_events(X.mixed_events(spark, sf))
    return (r["product"].select(F.lit("product").alias("route"), F.col("product_id").alias("id"))
            .unionByName(r["position"].select(F.lit("position").alias("route"), F.col("product_id").alias("id")))
            .unionByName(r["category"].select(F.lit("category").alias("route"), F.col("id"))))


def q_streaming_daily_state(spark, sf):
    return D.finalise_daily(ST.streaming_daily_state(spark, X.snap_events(spark, sf), compact=True))


def q_retention(spark, sf):
    kept = IO.apply_retention(X.snap_lineitem(spark, sf), "ts", LI_AS_OF, months=4)
    return kept.groupBy("category_id").agg(F.count(F.lit(1)).alias("rows_kept"), F.min("ts").alias("oldest"))


def q_seller_upsert(spark, sf):
    updates = (X.snap_lineitem(spark, sf)
               .select("seller_id", F.col("seller_account_id").alias("account_id"),
                       F.col("seller_link").alias("link"), F.col("seller_title").alias("title")).distinct())
    return IO.upsert(X.sellers(spark, sf), updates, ["seller_id", "account_id"])


def q_approx_by_scope(spark, sf):
    return SK.approx_by_scope(_events_daily(spark, sf), _scope(spark, sf), EV_FROM, EV_TO)


def q_approx_within(spark, sf):
    daily, scope = _events_daily(spark, sf), _scope(spark, sf)
    approx = SK.approx_by_scope(daily, scope, EV_FROM, EV_TO)
    states = D.date_between(_stored_states(spark, daily), EV_FROM, EV_TO).join(scope, "category_id")
    exact = DI.count_states(states, ["scope_id", "date"], R.ENTITY_COUNTS).withColumnRenamed("scope_id", "category_id")
    return SK.approx_within(approx, exact)


def q_position_store(spark, sf):
    root = ST.scratch_root(spark, "positions")
    IO.append_positions(X.positions(spark, sf), root)
    return P.position_history(IO.read_positions(spark, root).drop("yyyymm"), EV_FROM, EV_TO)


def q_payment_money(spark, sf):
    return X.payments(spark, sf).select("payment_id", money_split(F.col("amount")).alias("m")).select("payment_id", "m.*")


def q_product_links(spark, sf):
    return PR.first_discovered(X.snap_events(spark, sf)).withColumn("url", product_url(F.col("product_id"), "https://example.com/product/"))


def q_seller_list(spark, sf):
    return with_total(SE.seller_overall(_events_daily(spark, sf), EV_FROM, EV_TO), [])


def q_requested_sellers_dynamic(spark, sf):
    asked = X.report_requests(spark, sf).filter((F.col("report_type") == "seller") & (F.col("interval_days") == 21))
    return SE.seller_order_dynamic(in_filter(_events_daily(spark, sf), "seller_link", asked.select("key")), EV_FROM, EV_TO)


def q_category_cards_top(spark, sf):
    order = sort_columns([("revenue", "desc")], R.CARD_SORT_FIELDS, tie_breaker="category_id")
    return page(q_category_cards(spark, sf), ["period"], order, limit=10)


def q_approx_median_within(spark, sf):
    daily, scope = _events_daily(spark, sf), _scope(spark, sf)
    return SK.median_within(SK.approx_by_scope(daily, scope, EV_FROM, EV_TO), D.date_between(daily, EV_FROM, EV_TO), scope)


def q_product_price_filled(spark, sf):
    return PR.product_price_filled(_events_daily(spark, sf), EV_FROM, EV_TO)


def q_seller_overall_requested(spark, sf):
    asked = X.sellers(spark, sf).select(F.col("link").alias("seller_link"))
    zeros = {"order_amount": 0, "revenue": 0.0, "product_count": 0, "product_with_sales": 0, "product_without_sales": 0}
    return rows_for(SE.seller_overall(_events_daily(spark, sf), EV_FROM, EV_TO), asked, zeros)


def q_category_descendants(spark, sf):
    asked = X.categories_deep(spark, sf).filter(F.col("category_id") >= 4000).select("category_id")
    return H.descendants(H.category_closure(X.categories_deep(spark, sf)), asked)


def q_category_grandchildren(spark, sf):
    closure = H.category_closure(X.categories_deep(spark, sf))
    return eq_filter(closure, {"depth": 2}).select(F.col("ancestor").alias("category_id"), F.col("descendant").alias("grandchild_id"))


def q_seller_layout(spark, sf):
    root = ST.scratch_root(spark, "by-seller")
    IO.write_layout(_events_daily(spark, sf), root, ["seller_link", "date"])
    back = range_filter(IO.read_table(spark, root, DAILY), "date", F.lit(EV_FROM).cast("date"), F.lit(EV_TO).cast("date"))
    return SE.seller_order_dynamic(back, EV_FROM, EV_TO)


def q_daily_store(spark, sf):
    root = ST.scratch_root(spark, "daily")
    daily = D.daily_state(q_snapshot_rows_stored(spark, sf))
    for part in (daily, D.date_between(daily, "2024-01-10", "2024-01-12")):  # the days built again replace themselves only
        IO.write_daily(part, root)
    return D.finalise_daily(IO.read_daily(spark, root, EV_FROM, EV_TO))


def q_snapshots_retained(spark, sf):
    root = ST.scratch_root(spark, "snapshots-by-month")
    snap = X.snap_lineitem(spark, sf)
    V.replace_parts(snap, root, 0, IO.yyyymm(F.col("ts")))
    V.retain_months(spark, root, 1, "ts", LI_AS_OF, 4, snap.schema)
    back = V.read_parts(spark, root, snap.schema)
    return back.groupBy("category_id").agg(F.count(F.lit(1)).alias("rows_kept"), F.min("ts").alias("oldest"))


def q_sellers_ingested(spark, sf):
    events = X.product_events(spark, sf).select(F.struct("*").alias("product"))
    return RE.ingested_table(spark, "seller_table", events, X.sellers(spark, sf), ["seller_id", "account_id"], ST.SELLER_SCHEMA)


def q_categories_ingested(spark, sf):
    events = X.category_events(spark, sf).select(F.struct("*").alias("category"))
    stale = X.categories_deep(spark, sf).withColumn("title", F.concat(F.lit("old "), "title"))
    return RE.ingested_table(spark, "category_table", events, X.categories(spark, sf).unionByName(stale), ["category_id"], ST.CATEGORY_SCHEMA)


def q_report_batch(spark, sf):
    return RP.report_batch(X.report_requests(spark, sf), _events_daily(spark, sf), _scope(spark, sf), EV_AS_OF)


def q_report_rows_stored(spark, sf):
    root = ST.scratch_root(spark, "reports")
    cats = _cats(spark, sf)
    args = (X.report_requests(spark, sf), _events_daily(spark, sf), _scope(spark, sf, cats), cats, EV_AS_OF)
    RS.run_reports(*args, root, run=0)
    return RS.read_reports(spark, root, RS.build_reports(*args).schema).drop("run")


def q_report_expiry(spark, sf):
    return RP.expire_reports(X.report_requests(spark, sf), "2024-01-20 00:00:00").select(
        "report_id", "status", "content")


def q_snapshot_store(spark, sf):
    root = ST.scratch_root(spark, "snapshots")
    IO.append_snapshots(X.snap_events(spark, sf), root)
    back = IO.read_snapshots(spark, root, "2024-01-10 00:00:00", "2024-01-20 23:59:59")
    return back.groupBy("yyyymm", "category_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("purchase_price").alias("price_sum"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def q_snapshot_rows_stored(spark, sf):
    root = ST.scratch_root(spark, "snapshots")
    IO.append_snapshots(EVT.flatten_products(X.product_events(spark, sf)), root)
    return IO.read_snapshots(spark, root).drop("yyyymm")


def q_daily_state_of_events(spark, sf):
    return D.finalise_daily(D.daily_state(q_snapshot_rows_stored(spark, sf)))


def q_rollup_store(spark, sf):
    root = ST.scratch_root(spark, "rollups")
    cats = _cats(spark, sf)
    roots = R.root_scope(_scope(spark, sf, cats), cats)
    daily = _events_daily(spark, sf)
    older = R.category_product_rollup(daily, roots, "2024-01-24", ["WEEK"])
    newer = R.category_product_rollup(daily, roots, EV_AS_OF, ["WEEK"])
    for part in (older, newer, newer):  # the rerun replaces its own partition
        IO.write_rollup(part, root)
    back = spark.read.parquet(root)
    return R.finalise_product_rollup(back.join(R.latest_as_of(back), ["period", "as_of"]))


def q_streaming_subscription_ledger(spark, sf):
    return ST.streaming_subscription_ledger(spark, X.payments(spark, sf))


def q_subscription_grants(spark, sf):
    return AC.apply_grants(X.users(spark, sf), X.subscription_grants(spark, sf))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "category_daily": q_category_daily,
    "category_adhoc": q_category_adhoc,
    "category_overall": q_category_overall,
    "category_report": q_category_report,
    "category_closure": q_category_closure,
    "category_info": q_category_info,
    "daily_state": q_daily_state,
    "product_first_discovered": q_first_discovered,
    "product_sku_history": q_sku_history,
    "products_sales": q_products_sales,
    "products_order_chart": q_products_order_chart,
    "product_daily_card": q_product_daily_card,
    "seller_overall": q_seller_overall,
    "seller_order_dynamic": q_seller_order_dynamic,
    "seller_report": q_seller_report,
    "seller_card": q_seller_card,
    "seller_shops": q_seller_shops,
    "position_history": q_position_history,
    "category_product_rollup": q_category_product_rollup,
    "category_rollup_prev": q_category_rollup_prev,
    "category_daily_stats": q_category_daily_stats,
    "category_with_prev": q_category_with_prev,
    "category_cards": q_category_cards,
    "category_products": q_category_products,
    "category_products_chart": q_category_products_chart,
    "category_products_page": q_category_products_page,
    "seller_report_rows": q_seller_report_rows,
    "abc_orders": q_abc_orders,
    "abc_revenue": q_abc_revenue,
    "days_in_stock": q_days_in_stock,
    "reports_per_user_day": q_reports_per_user_day,
    "report_quota": q_report_quota,
    "access_check": q_access_check,
    "shared_keys": q_shared_keys,
    "subscription_ledger": q_subscription_ledger,
    "subscription_status": q_subscription_status,
    "payments_applied": q_payments_applied,
    "payment_extensions": q_payment_extensions,
    "payments_streamed": q_payments_streamed,
    "flatten_products": q_flatten_products,
    "flatten_categories": q_flatten_categories,
    "event_routing": q_event_routing,
    "streaming_daily_state": q_streaming_daily_state,
    "retention": q_retention,
    "seller_upsert": q_seller_upsert,
    "approx_by_scope": q_approx_by_scope,
    "report_batch": q_report_batch,
    "report_rows_stored": q_report_rows_stored,
    "report_expiry": q_report_expiry,
    "snapshot_store": q_snapshot_store,
    "snapshot_rows_stored": q_snapshot_rows_stored,
    "daily_state_of_events": q_daily_state_of_events,
    "rollup_store": q_rollup_store,
    "streaming_subscription_ledger": q_streaming_subscription_ledger,
    "subscription_grants": q_subscription_grants,
    "approx_within": q_approx_within,
    "position_store": q_position_store,
    "payment_money": q_payment_money,
    "product_links": q_product_links,
    "seller_list": q_seller_list,
    "requested_sellers_dynamic": q_requested_sellers_dynamic,
    "category_cards_top": q_category_cards_top,
    "category_with_prev_newest": q_category_with_prev_newest,
    "approx_median_within": q_approx_median_within,
    "product_price_filled": q_product_price_filled,
    "seller_overall_requested": q_seller_overall_requested,
    "category_descendants": q_category_descendants,
    "category_grandchildren": q_category_grandchildren,
    "seller_layout": q_seller_layout,
    "daily_store": q_daily_store,
    "snapshots_retained": q_snapshots_retained,
    "sellers_ingested": q_sellers_ingested,
    "categories_ingested": q_categories_ingested,
}
