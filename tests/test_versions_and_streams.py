"""Versioned stored tables, category trees and closures of any depth, payments as one stateful stream, distincts and medians."""

import datetime as dt
import json
import os
import random
import statistics
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mktlens.operators import distincts, medians
from mktlens.operators.daily import daily_state
from mktlens.operators.hierarchy import category_closure, scope_of
from mktlens.plans.accounts import PAYMENT_SCHEMA, apply_payment_events, payment_extensions
from mktlens.sources import fixtures as X
from mktlens.sources.events import POSITION_EVENT, PRODUCT_EVENT, category_nodes, flatten_categories
from mktlens.sources.schema import DAILY
from mktlens.sources.versions import manifest, merge_keyed, read_parts, replace_parts, retain_parts, vacuum_paths
from mktlens.streaming.ingest import (CATEGORY_SCHEMA, SELLER_SCHEMA, compact_daily_parts, daily_state_stream, ingest_stream, latest_payments,
                                      LEDGER_STATE, PAYMENT_STATE, ledger_fold, payment_changes, payment_fold,
                                      payment_stream, read_daily_parts, streamed_payments)

SF = "/root/testdata/sf0.001"


def _files(root):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def _tree(depth, extra=0):
    node = {"id": depth, "title": f"t{depth}"}
    for i in range(depth - 1, 0, -1):
        node = {"id": i, "title": f"t{i}", "children": [node, *({"id": 1000 + i + k, "title": "x"} for k in range(extra))]}
    return node


@pytest.mark.parametrize("depth", [1, 2, 12, 40])
def test_trees_and_closures_of_any_depth(spark, depth):
    events = spark.createDataFrame([(json.dumps(_tree(depth)),), (None,)], "category string")
    flat = flatten_categories(category_nodes(events, "category"))
    assert sorted(map(tuple, flat.collect())) == [(i, i - 1, f"t{i}") for i in range(1, depth + 1)]
    got = {(r.ancestor, r.descendant): r.depth for r in category_closure(flat).collect()}
    assert got == {(a, d): d - a for a in range(1, depth + 1) for d in range(a + 1, depth + 1)}
    assert [r.category_id for r in scope_of(flat, depth).collect()] == [depth]


@pytest.mark.parametrize("parents", [{1: 1}, {1: 2, 2: 1}, {1: 2, 2: 3, 3: 4, 4: 5, 5: 1, 6: 5, 7: 0}])
def test_closure_raises_on_a_cycle(spark, parents):
    rows = [(c, p, "") for c, p in parents.items()]
    with pytest.raises(ValueError, match="cycle"):
        category_closure(spark.createDataFrame(rows, "category_id long, parent_category_id long, title string"))


def test_distinct_states_equal_count_distinct_from_storage(spark, tmp_path):
    daily = daily_state(X.snap_events(spark, SF))
    distincts.write_states(distincts.entity_states(daily), str(tmp_path / "states"))
    states = distincts.read_states(spark, str(tmp_path / "states"))
    names = {"seller_id": "s", "product_id": "p"}
    for keys in (["category_id", "date"], ["category_id"], ["date"]):
        want = daily.groupBy(*keys).agg(F.count_distinct("seller_id").alias("s"), F.count_distinct("product_id").alias("p"))
        got = distincts.count_states(states, keys, names)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    ids = distincts.dense_ids(spark.range(70000).select((F.col("id") * 7919).alias("v"), (F.col("id") % 3).alias("c")), "v", "c")
    r = ids.agg(F.count("dense"), F.count_distinct("dense"), F.min("dense"), F.max("dense")).first()
    assert tuple(r) == (70000, 70000, 0, 69999)


def test_group_medians_against_statistics(spark):
    rnd = random.Random(1)
    rows = [(k, rnd.choice([rnd.randint(-5, 5) * 0.5, rnd.uniform(0, 1e9), 0.0, None]), rnd.randint(0, 3)) for k in (1, 2, 3, None) for _ in range(500)]
    rows += [(4, None, 1), (5, 7.5, 1), (6, 1.0, 0)]
    df = spark.createDataFrame(rows, "k int, v double, w int").repartition(5)
    groups, weighted = {}, {}
    for k, v, w in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
            weighted.setdefault(k, []).extend([v] * w)
    assert {r.k: r["median"] for r in medians.group_medians(df, ["k"], F.col("v")).collect()} == {k: statistics.median(v) for k, v in groups.items()}
    got = {r.k: r["median"] for r in medians.group_medians(df, ["k"], F.col("v"), F.col("w")).collect()}
    assert got == {k: statistics.median(v) for k, v in weighted.items() if v}
    assert medians.group_medians(df.limit(0), ["k"], F.col("v")).collect() == []


def test_keyed_merge_rewrites_touched_buckets_only(spark, tmp_path):
    root = str(tmp_path / "sellers")
    first = spark.createDataFrame([(i, i % 7, f"l{i}", "a") for i in range(200)], SELLER_SCHEMA)
    merge_keyed(first, root, 0, ["seller_id", "account_id"], SELLER_SCHEMA, buckets=16)
    before, at = _files(root + "/data"), manifest(spark, root)[1]
    change = spark.createDataFrame([(5, 5, "l5", "b", 1), (5, 5, "l5", "c", 2), (900, 1, "new", "n", 1)],
                                   "seller_id long, account_id long, link string, title string, update_seq long")
    for _ in range(2):  # a replay of the same version changes nothing
        touched = merge_keyed(change, root, 1, ["seller_id", "account_id"], SELLER_SCHEMA, buckets=16)
        got = {r.seller_id: r.title for r in read_parts(spark, root, SELLER_SCHEMA).collect()}
        assert got == {i: "c" if i == 5 else "a" for i in range(200)} | {900: "n"}
    now, after = manifest(spark, root)[1], _files(root + "/data")
    assert 1 <= len(touched) <= 2 and {p for p in now if now[p] == 1} == set(touched)
    assert all(now[p] == at[p] for p in at if p not in touched) and all(after[f] == t for f, t in before.items())
    assert len(vacuum_paths(spark, root)) == len(set(touched) & set(at))
    assert merge_keyed(change.limit(0), root, 2, ["seller_id", "account_id"], SELLER_SCHEMA) == []


def test_retention_drops_months_from_the_manifest(spark, tmp_path):
    schema = T.StructType([T.StructField("ts", T.TimestampNTZType()), T.StructField("n", T.LongType())])
    rows = [(dt.datetime(2024, m, d), m * 100 + d) for m in range(1, 7) for d in (1, 15)]
    root = str(tmp_path / "snap")
    replace_parts(spark.createDataFrame(rows, schema), root, 0, F.date_format("ts", "yyyyMM"))
    old = read_parts(spark, root, schema)
    cutoff = dt.datetime(2024, 3, 10)
    dropped = retain_parts(spark, root, 1, "202403", "202403", F.col("ts") > F.lit(cutoff), schema)
    assert dropped == ["202401", "202402"]
    assert sorted(r.n for r in read_parts(spark, root, schema).collect()) == sorted(n for t, n in rows if t > cutoff)
    assert old.count() == 12  # a reader that began before still sees all of the old table
    assert retain_parts(spark, root, 2, "209901") == ["202403", "202404", "202405", "202406"]
    assert read_parts(spark, root, schema).count() == 0


def test_compaction_rewrites_touched_dates_only(spark, tmp_path):
    snap = X.snap_events(spark, SF).persist()
    src, sink = str(tmp_path / "src"), str(tmp_path / "sink")

    def deliver(df):
        df.write.mode("append").parquet(src)
        daily_state_stream(spark, src, snap.schema, sink, str(tmp_path / "ckpt"), 10).awaitTermination()

    late = F.to_date("ts").isin([dt.date(2024, 1, 5), dt.date(2024, 1, 9)]) & (F.col("sku_id") % 2 == 0)
    deliver(snap.filter(~late))
    assert len(compact_daily_parts(spark, sink)) > 20 and compact_daily_parts(spark, sink) == []
    before = _files(sink + "/base/data")
    deliver(snap.filter(late))
    assert compact_daily_parts(spark, sink) == ["2024-01-05", "2024-01-09"]
    new = {f for f in _files(sink + "/base/data") if f not in before}
    assert new and all("part=2024-01-05" in f or "part=2024-01-09" in f for f in new)
    names = [n for n in DAILY.names if not n.endswith("_hist")]
    want, got = daily_state(snap).select(names), read_daily_parts(spark, sink).select(names)
    assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()


def test_ingest_merges_sellers_and_category_trees(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()

    def product(time, title):
        return {"product_id": 7, "time": time, "title": "p", "total_available_amount": 5, "orders": 3, "attributes": [], "tags": [],
                "reviews_amount": 1, "rating": "4.5", "sku_list": [], "is_eco": False, "is_adult": False,
                "seller": {"id": 1, "account_id": 9, "seller_link": "s", "seller_title": title, "reviews": 0, "orders": 0, "rating": "5",
                           "registration_date": 1600000000, "contacts": []}, "category": {"id": 2000, "title": "t", "product_amount": 1}}

    moved = _tree(12) | {"title": "renamed"}
    for i, ev in enumerate([{"product": product(100, "old")}, {"category": _tree(12)}, {"product": product(200, "new")}, {"category": moved}]):
        (src / f"e{i}.json").write_text(json.dumps(ev) + "\n")
        os.utime(src / f"e{i}.json", (1000 + i, 1000 + i))
    schema = T.StructType([T.StructField("product", PRODUCT_EVENT), T.StructField("position", POSITION_EVENT), T.StructField("category", T.VariantType())])
    sinks = {k: str(tmp_path / k) for k in ("product", "seller_table", "category_table")}
    ingest_stream(spark, str(src), schema, sinks, str(tmp_path / "ckpt"), max_files_per_trigger=1).awaitTermination()
    assert [tuple(r) for r in read_parts(spark, sinks["seller_table"], SELLER_SCHEMA).collect()] == [(1, 9, "s", "new")]
    got = {r.category_id: (r.parent_category_id, r.title) for r in read_parts(spark, sinks["category_table"], CATEGORY_SCHEMA).collect()}
    assert got == {i: (i - 1, "renamed" if i == 1 else f"t{i}") for i in range(1, 13)}


CREATED = "payment_id long, user_id long, created_at timestamp_ntz, amount_minor long, plan_code int, multiply int, status string"
STATUS = "payment_id long, status string, event_ts timestamp_ntz, event_seq long"


def _payment_events(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    created = [(1, 10, day(1), 1500, 2, 1, "pending"), (2, 11, day(2), 990, 3, 2, "success"), (3, 12, day(3), 10, 9, 1, "success"),
               (4, 13, day(4), 10, 1, 3, "held"), (5, 14, day(5), 700, 1, None, "failed")]
    status = [(1, "success", day(3), 1), (1, "success", day(4), 1), (1, "canceled", day(5), 1), (1, "success", day(6), 1), (2, "success", day(3), 1),
              (2, "weird", day(4), 1), (4, "pending", day(6), 1), (5, "success", day(6), 2), (5, "pending", day(6), 3), (77, "success", day(1), 1)]
    return spark.createDataFrame(created, CREATED), spark.createDataFrame(status + status[:3], STATUS)


PAID = {1: ("success", True, 2), 2: ("success", True, 1), 4: ("pending", False, 0), 5: ("pending", False, 1)}


def test_payments_batch_follows_each_change(spark):
    created, status = _payment_events(spark)
    none = spark.createDataFrame([], PAYMENT_SCHEMA)
    fired = {}
    for r in payment_extensions(none, created, status).collect():
        fired.setdefault(r.payment_id, []).append((r.extension, r.user_id, r.paid_on, r.subscription_type, r.days))
    assert fired == {1: [(1, 10, dt.date(2024, 1, 1), "advanced", 30), (2, 10, dt.date(2024, 1, 1), "advanced", 30)],
                     2: [(1, 11, dt.date(2024, 1, 2), "pro", 60)], 5: [(1, 14, dt.date(2024, 1, 5), "default", 30)]}
    table = apply_payment_events(none, created, status)
    assert {r.payment_id: (r.status, r.paid, len(fired.get(r.payment_id, []))) for r in table.collect()} == PAID
    # stored successes fire nothing again
    assert payment_extensions(table, created, status.filter("payment_id = 2")).collect() == []


def test_payments_stream_equals_batch_out_of_order_and_replayed(spark):
    created, status = _payment_events(spark)
    got = {r.payment_id: (r.status, r.paid, r.extensions) for r in streamed_payments(spark, created, status).collect()}
    assert got == PAID


def test_payment_versions_read_errors_are_errors(spark, tmp_path):
    created, status = _payment_events(spark)
    created.write.parquet(str(tmp_path / "created"))
    root = str(tmp_path / "table")
    payment_stream(spark, str(tmp_path / "created"), created.schema, status, root, str(tmp_path / "c")).awaitTermination()
    assert latest_payments(spark, root).count() == 4 and latest_payments(spark, root, before=0).count() == 0
    part = next(f for f in _files(root))
    with open(part, "wb") as f:
        f.write(b"broken")
    with pytest.raises(Exception):
        latest_payments(spark, root).collect()


def test_payment_state_is_folded_by_batch(spark):
    """Set-based: the state after two batches is that of all events, and each change is given once."""
    t = lambda d: dt.datetime(2024, 1, d)
    events = T.StructType(PAYMENT_STATE.fields[:3])
    first = (t(1), 10, "pending", 15.0, "advanced", 1)
    one = spark.createDataFrame([(1, first, []), (1, None, [(t(4), 1, "success")]), (2, None, [(t(2), 1, "success")])], events)
    two = spark.createDataFrame([(1, None, [(t(3), 1, "canceled")]), (1, None, [(t(2), 1, "success")]), (1, None, [(t(4), 1, "success")])], events)
    state = payment_fold(one, spark.createDataFrame([], PAYMENT_STATE), 0).localCheckpoint()
    rows = lambda df: sorted((r.payment_id, r.kind, r.number, r.status) for r in df.collect())
    assert rows(payment_changes(state, 0)) == [(1, "extension", 1, "success"), (1, "payment", 1, "success")]
    state = payment_fold(two, state, 1).localCheckpoint()
    assert rows(payment_changes(state, 1)) == [(1, "extension", 2, "success"), (1, "payment", 2, "success")]
    got = {r.payment_id: (len(r.statuses), r.given, r.due, r.changes, r.batch) for r in state.collect()}
    assert got == {1: (3, 1, 2, 2, 1), 2: (1, 0, 0, 0, 0)}
    state = payment_fold(two, state, 2)  # sent again: the row once more, no extension
    assert rows(payment_changes(state, 2)) == [(1, "payment", 3, "success")]


def test_ledger_goes_on_from_stored_ends(spark):
    pays = "user_id long, payment_id long, paid_on date, days long"
    day = lambda d: dt.date(2024, 1, d)
    state = spark.createDataFrame([(1, 19740), (3, 1)], LEDGER_STATE)  # 2024-01-18
    new = spark.createDataFrame([(1, 6, day(9), 30), (1, 5, day(9), 30), (2, 7, day(2), 60), (None, 8, day(3), 30), (None, 9, day(1), 30)], pays)
    got = {r.payment_id: r.subscription_end for r in ledger_fold(new, state).collect()}
    assert got == {5: dt.date(2024, 2, 17), 6: dt.date(2024, 3, 18), 7: dt.date(2024, 3, 2), 9: dt.date(2024, 1, 31), 8: dt.date(2024, 3, 1)}
