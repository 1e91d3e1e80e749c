"""Stored daily states, layouts and rollups read back: what is rewritten, what a read opens, and answers at the newest stored date."""

import datetime as dt
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from mktlens.operators import sketches
from mktlens.operators.daily import daily_state
from mktlens.operators.filters import rows_for
from mktlens.operators.hierarchy import category_closure, descendants
from mktlens.plans import rollups as R
from mktlens.sources import fixtures as X
from mktlens.sources import io as IO
from mktlens.sources import versions as V
from mktlens.sources.schema import DAILY_STORED
from mktlens.streaming import replay
from mktlens.streaming.replay import ingested_table
from mktlens.streaming.ingest import CATEGORY_SCHEMA, SELLER_SCHEMA

SF = "/root/testdata/sf0.001"


def _parquet(root):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def daily(spark):
    return daily_state(X.snap_events(spark, SF)).persist()


def test_daily_table_replaces_dates_and_prunes(spark, daily, tmp_path):
    root = str(tmp_path / "daily")
    IO.write_daily(daily, root, slices=4)
    before = {f: os.path.getmtime(f) for f in _parquet(root)}
    IO.write_daily(daily.filter("date = DATE'2024-01-10'").withColumn("rating", F.lit(0).cast("decimal(9,2)")), root, slices=4)
    after = {f: os.path.getmtime(f) for f in _parquet(root)}
    assert {f.split("date=")[1][:10] for f in set(before) ^ set(after)} == {"2024-01-10"}
    back = IO.read_daily(spark, root)
    assert back.columns == DAILY_STORED.names and back.count() == daily.count()
    assert {str(r.date) for r in back.filter("rating = 0").select("date").distinct().collect()} == {"2024-01-10"}
    assert back.filter("is_eco IS NOT NULL OR is_adult IS NOT NULL OR seller_registration_date IS NOT NULL").isEmpty()
    some = IO.read_daily(spark, root, "2024-01-05", "2024-01-06")
    assert "PartitionFilters: [isnotnull(date" in _plan(some) and some.select("date").distinct().count() == 2
    opened = {r.f.split("date=")[1][:10] for r in some.select(F.input_file_name().alias("f")).distinct().collect()}
    assert opened == {"2024-01-05", "2024-01-06"}


def test_layout_lets_a_read_skip_files(spark, daily, tmp_path):
    """A seller's rows lie in few files of the layout, by the files' own statistics; in the table as it came, in all of them."""
    spread, by_seller = str(tmp_path / "spread"), str(tmp_path / "by-seller")
    daily.repartition(8).write.parquet(spread)
    IO.write_layout(daily.repartition(8), by_seller, ["seller_link", "date"])

    def admitting(root, seller):
        found = []
        for f in _parquet(root):
            meta = pq.ParquetFile(f).metadata
            at = meta.schema.to_arrow_schema().get_field_index("seller_link")
            names = [meta.row_group(0).column(i).path_in_schema for i in range(meta.num_columns)]
            stats = [meta.row_group(g).column(names.index("seller_link")).statistics for g in range(meta.num_row_groups)]
            assert at >= 0
            found.append(any(s.min <= seller <= s.max for s in stats))
        return sum(found), len(found)

    sellers = [r[0] for r in daily.select("seller_link").distinct().collect()]
    for s in sellers:
        all_in, all_of = admitting(spread, s)
        few_in, few_of = admitting(by_seller, s)
        assert all_in == all_of and few_in <= max(2, few_of // 2)
        want = daily.filter(F.col("seller_link") == s).count()
        assert spark.read.parquet(by_seller).filter(F.col("seller_link") == s).count() == want


def test_months_are_retained_by_manifest(spark, tmp_path):
    rows = [(dt.datetime(2024, m, d), m * 100 + d) for m in range(1, 7) for d in (1, 10, 11, 28)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, n long")
    root = str(tmp_path / "t")
    V.replace_parts(df.repartition(7), root, 0, IO.yyyymm(F.col("ts")))
    assert len(_parquet(root + "/data")) == 6  # a small part is one file, however many tasks had its rows
    old = V.read_parts(spark, root, df.schema)
    first = {f: os.path.getmtime(f) for f in _parquet(root + "/data")}
    assert V.retain_months(spark, root, 1, "ts", "2024-06-10", 3, df.schema) == ["202401", "202402"]
    cut = dt.datetime(2024, 3, 10)
    assert sorted(r.n for r in V.read_parts(spark, root, df.schema).collect()) == sorted(n for t, n in rows if t > cut)
    assert old.count() == len(rows)  # a reader that began before sees all of the old table
    new = set(_parquet(root + "/data")) - set(first)
    assert len(new) == 1 and "version=1/part=202403" in new.pop()
    assert all(os.path.getmtime(f) == t for f, t in first.items())
    for _ in range(2):  # nothing is left, also when it is run again
        V.retain_months(spark, root, 2, "ts", "2030-01-01", 1, df.schema)
        assert V.read_parts(spark, root, df.schema).isEmpty()


def test_a_large_part_is_split_over_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    try:
        df = spark.range(200000).select("id", F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(-1).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
        V.replace_parts(df.repartition(16), str(tmp_path / "t"), 0, F.col("k"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = _parquet(str(tmp_path / "t/data"))
    assert sum("part=-1/" in f for f in files) > 3
    assert V.read_parts(spark, str(tmp_path / "t"), df.schema).count() == 200000


def test_category_metrics_at_the_newest_stored_date(spark, tmp_path):
    """Each period has its own newest date; sums, and the windows of the distinct counts, follow it."""
    rollup = [(p, c, n, 10, n, 10, 100.0 * n, 50.0, as_of) for p, as_of, n in
              (("WEEK", dt.date(2024, 1, 20), 1), ("WEEK", dt.date(2024, 1, 31), 2), ("MONTH", dt.date(2024, 1, 20), 3)) for c in (10, 11)]
    schema = ("period string, category_id long, order_amount long, available_amount long, prev_order_amount long, prev_available_amount long,"
              " revenue double, prev_revenue double, as_of date")
    root = str(tmp_path / "rollup")
    IO.write_rollup(spark.createDataFrame(rollup, schema), root)
    days = [(c, dt.date(2024, 1, d), s, s + 100 * c) for c in (10, 11) for d, s in ((1, 1), (15, 2), (18, 3), (22, 4), (26, 5), (30, 6))]
    from mktlens.operators.distincts import entity_states
    states = entity_states(spark.createDataFrame(days, "category_id long, date date, seller_id long, product_id long"))
    scope = spark.createDataFrame([(1, 10), (1, 11), (10, 10), (11, 11)], "scope_id long, category_id long")
    got = R.category_with_prev(spark.read.parquet(root), states, scope, None, ["WEEK", "MONTH", "TWO_MONTH"])
    want = [R.category_with_prev(spark.read.parquet(root), states, scope, as_of, [p]).collect()
            for p, as_of in (("WEEK", "2024-01-31"), ("MONTH", "2024-01-20"))]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for rows in want for r in rows)
    one = got.filter("period = 'WEEK' AND category_id = 1").first()
    assert (one.order_amount, one.seller_count, one.product_count, one.prev_seller_count) == (4, 2, 4, 2)
    assert "Subquery" in _plan(got)
    nothing = spark.read.parquet(root).limit(0)
    assert R.category_with_prev(nothing, states, scope, None, ["WEEK"]).collect() == []


def test_rows_for_every_key_asked(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", None, None)], "k string, n long, x double")
    keys = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "k string")
    got = {r.k: (r.n, r.x) for r in rows_for(df, keys, {"n": 0}).collect()}
    assert got == {"a": (1, 2.0), "b": (0, None), "c": (0, None), None: (0, None)}
    assert rows_for(df.limit(0), keys, {"n": 0, "x": 0.0}).count() == 4 and rows_for(df, keys.limit(0), {}).collect() == []


def test_descendants_of_many_equal_those_of_each(spark):
    cats = X.categories_deep(spark, SF)
    closure = category_closure(cats).persist()
    ids = [5000, 4001, 3000, 77]
    asked = spark.createDataFrame([(i,) for i in ids + ids[:1]], "id int")
    for level in (0, 1, 2):
        got = {(r.ancestor, r.category_id) for r in descendants(closure, asked, level).collect()}
        assert got == {(i, r.category_id) for i in ids for r in descendants(closure, i, level).collect()}
    assert descendants(closure, asked).count() == len({(r.ancestor, r.category_id) for r in descendants(closure, asked).collect()})


def test_a_wrong_sketch_median_is_found(spark, daily):
    scope = spark.createDataFrame([(c, c) for c in range(2000, 2025)], "scope_id long, category_id long")
    approx = sketches.approx_by_scope(daily, scope, "2024-01-01", "2024-02-28").persist()
    good = sketches.median_within(approx, daily, scope)
    assert good.filter("NOT median_within").isEmpty() and good.count() > 100
    off = sketches.median_within(approx.withColumn("approx_median_price", F.lit(-1).cast("long")), daily, scope)
    assert off.filter("median_within").isEmpty()


def test_ingest_keeps_what_no_event_names(spark):
    before = spark.createDataFrame([(1, 0, "kept"), (2, 1, "old"), (3, 1, None)], CATEGORY_SCHEMA)
    tree = {"id": 2, "title": "new", "children": [{"id": 9, "title": "child"}]}
    events = spark.createDataFrame([(tree,)], "category struct<id:long,title:string,children:array<struct<id:long,title:string>>>")
    got = ingested_table(spark, "category_table", events, before, ["category_id"], CATEGORY_SCHEMA)
    assert sorted(map(tuple, got.collect())) == [(1, 0, "kept"), (2, 0, "new"), (3, 1, None), (9, 2, "child")]
    none = X.product_events(spark, SF).limit(0).select(F.struct("*").alias("product"))
    sellers = ingested_table(spark, "seller_table", none, X.sellers(spark, SF), ["seller_id", "account_id"], SELLER_SCHEMA)
    assert sellers.count() == X.sellers(spark, SF).count()


def test_events_are_delivered_in_files_of_a_size(spark):
    """More events come in more files, each batch of several; before, three tasks and files held them whatever their number."""
    sizes = []
    stream = replay.ingest_stream

    def counted(session, source, schema, sinks, checkpoint, per_trigger):
        sizes.append((len([f for f in os.listdir(source) if f.endswith(".json")]), per_trigger))
        return stream(session, source, schema, sinks, checkpoint, per_trigger)

    events = X.product_events(spark, SF).select(F.struct("*").alias("product"))
    sizes_of = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize"]
    before = [spark.conf.get(c) for c in sizes_of]
    replay.ingest_stream = counted
    try:
        few = ingested_table(spark, "seller_table", events, X.sellers(spark, SF), ["seller_id", "account_id"], SELLER_SCHEMA).collect()
        for c in sizes_of:
            spark.conf.set(c, "2KB")
        many = ingested_table(spark, "seller_table", events, X.sellers(spark, SF), ["seller_id", "account_id"], SELLER_SCHEMA).collect()
    finally:
        replay.ingest_stream = stream
        for c, size in zip(sizes_of, before):
            spark.conf.set(c, size)
    assert sorted(few) == sorted(many)
    assert sizes[0] == (3, 1) and sizes[1][0] > 3 and sizes[1][1] == -(-sizes[1][0] // 3)


def test_rollup_reads_stored_windows_not_the_snapshots_again(spark):
    from mktlens.plans import catalog

    files = catalog.q_category_rollup_prev(spark, SF).inputFiles()
    assert files and not [f for f in files if "lineitem" in f]
