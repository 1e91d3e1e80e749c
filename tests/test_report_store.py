"""Stored reports, latest stored rollups, clustered snapshot writes, ABC classes over many values."""

import random

import pytest
from pyspark.sql import functions as F

from mktlens.operators.daily import daily_state
from mktlens.operators.filters import Filter
from mktlens.operators.hierarchy import scope_table
from mktlens.plans import report_store as RS
from mktlens.plans import rollups as R
from mktlens.plans.reports import abc_class
from mktlens.sources import fixtures as X
from mktlens.sources import io as IO
from mktlens.sources.events import flatten_products

SF = "/root/testdata/sf0.001"


def abc_by_hand(values):
    total = sum(values)
    out = []
    for x in values:
        share = sum(v for v in values if v > x) + x
        out.append(None if total == 0 else "A" if share * 100 < total * 81 else "B" if share * 100 < total * 96 else "C")
    return out


@pytest.mark.parametrize("values", [[0, 0, 0], [5], [7, 7, 7, 1], [3, 2, 2, 1, 0], list(range(400)),
                                    [random.Random(1).randint(0, 10 ** 9) for _ in range(300)], [10, -3, 4, 4]])
def test_abc_equals_hand(spark, values):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)] + [("other", -1, 3)], "key string, id long, v long")
    got = {r["id"]: r["c"] for r in abc_class(df, "v", ["key"], "c").filter("key = 'k'").collect()}
    assert [got[i] for i in range(len(values))] == abc_by_hand(values)


def test_abc_of_one_large_report(spark):
    """12,000 products under one key, each with its own value: every row gets a class, shares as by hand."""
    n = 12_000
    df = spark.range(n).select(F.lit("k").alias("key"), F.col("id"), (F.col("id") + 1).alias("v"))
    got = {r["c"]: (r["lo"], r["n"]) for r in abc_class(df, "v", ["key"], "c").groupBy("c").agg(F.min("v").alias("lo"), F.count("*").alias("n")).collect()}
    assert sum(c[1] for c in got.values()) == n
    total, above = n * (n + 1) // 2, 0
    want = {}
    for x in range(n, 0, -1):
        c = "A" if (above + x) * 100 < total * 81 else "B" if (above + x) * 100 < total * 96 else "C"
        want[c] = x
        above += x
    assert {c: lo for c, (lo, _) in got.items()} == want


@pytest.fixture(scope="module")
def report_inputs(spark):
    cats = X.categories(spark, SF)
    return daily_state(X.snap_events(spark, SF)).checkpoint(), scope_table(cats).checkpoint(), cats


def test_reports_share_work_and_commit_by_run(spark, tmp_path, report_inputs):
    root = str(tmp_path)
    some = spark.createDataFrame(
        [(1, "seller", "seller-1", 28), (2, "seller", "seller-1", 28), (3, "category", "1001", 14),
         (4, "seller", "nobody", 28), (5, "seller", None, 28)],
        "report_id long, report_type string, key string, interval_days int")
    schema = RS.build_reports(some, *report_inputs, "2024-01-31").schema
    first = {r["report_id"]: r for r in RS.run_reports(some, *report_inputs, "2024-01-31", root, run=0).collect()}
    assert {i: r["status"] for i, r in first.items()} == {1: "completed", 2: "completed", 3: "completed", 4: "failed", 5: "failed"}
    assert first[1]["row_count"] == first[2]["row_count"] > 0 and first[5]["report"] is None
    stored = RS.read_reports(spark, root, schema).collect()
    assert {(r["report"], r["requests"]) for r in stored} == {("seller:seller-1:28", 2), ("category:1001:14", 1)}
    want = RS.build_reports(some, *report_inputs, "2024-01-31").filter("report = 'seller:seller-1:28'")
    one = RS.read_report(spark, root, schema, 2)
    assert sorted(one.select(*want.columns).collect()) == sorted(want.collect())
    # pages in product order
    ids = [r["product_id"] for r in one.orderBy("product_id").collect()]
    assert sorted(r["product_id"] for r in RS.read_report(spark, root, schema, 2, limit=1, offset=1).collect()) == ids[1:2]
    assert RS.read_report(spark, root, schema, 4).count() == 0 and RS.read_report(spark, root, schema, 99).count() == 0

    # the next run answers new requests only; rows without a status are not seen
    more = some.unionByName(spark.createDataFrame([(6, "category", "1002", 7)], some.schema))
    RS.run_reports(more, *report_inputs, "2024-01-31", root, run=1)
    assert {r["report_id"]: r["run"] for r in RS.read_status(spark, root).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 1}
    spark.createDataFrame([("x", 1)], "seller_title string, product_id long").write.parquet(f"{root}/rows/run=7/report=half")
    assert "half" not in {r["report"] for r in RS.read_reports(spark, root, schema).select("report").distinct().collect()}
    # replay of a run changes nothing
    before = sorted(map(str, RS.read_reports(spark, root, schema).collect()))
    RS.run_reports(more, *report_inputs, "2024-01-31", root, run=1)
    assert sorted(map(str, RS.read_reports(spark, root, schema).collect())) == before

    RS.export_report(spark, root, schema, 1, f"{root}/csv")
    csv = spark.read.option("header", True).csv(f"{root}/csv")
    assert csv.count() == len(ids) and len(csv.columns) == 11


def test_reports_without_requests(spark, tmp_path, report_inputs):
    none = spark.createDataFrame([], "report_id long, report_type string, key string, interval_days int")
    schema = RS.build_reports(none, *report_inputs, "2024-01-31").schema
    assert RS.run_reports(none, *report_inputs, "2024-01-31", str(tmp_path), run=0).count() == 0
    assert RS.read_reports(spark, str(tmp_path), schema).count() == 0


def test_latest_rollup_prunes_and_pages_map_side(spark, tmp_path, report_inputs):
    daily, scope, cats = report_inputs
    roots = R.root_scope(scope, cats)
    for as_of in ("2024-01-24", "2024-01-31"):
        IO.write_rollup(R.category_product_rollup(daily, roots, as_of, ["WEEK", "MONTH"]), str(tmp_path))
    # the newest date of MONTH is older than that of WEEK
    IO.write_rollup(R.category_product_rollup(daily, roots, "2024-02-03", ["WEEK"]), str(tmp_path))
    stored = spark.read.parquet(str(tmp_path))
    latest = R.rollup_at(stored, ["WEEK", "MONTH"])
    assert {(r[0], str(r[1])) for r in latest.select("period", "as_of").distinct().collect()} <= {("WEEK", "2024-02-03"), ("MONTH", "2024-01-31")}
    assert latest.filter("period = 'MONTH'").count() == stored.filter("period = 'MONTH' AND as_of = DATE'2024-01-31'").count() > 0
    plan = latest._jdf.queryExecution().executedPlan().toString()
    partition_filters = plan[plan.index("PartitionFilters"):].split("PushedFilters")[0]
    assert "ubquery" in partition_filters  # scalar subqueries prune folders

    sort = [("order_amount", "desc"), ("price", "asc")]
    every = R.category_products(stored, scope, None, ["WEEK", "MONTH"], [Filter.contains("title", "PROD")], sort)
    paged = R.category_products(stored, scope, None, ["WEEK", "MONTH"], [Filter.contains("title", "PROD")], sort, limit=2, offset=1)
    assert "WindowGroupLimit" in paged._jdf.queryExecution().executedPlan().toString()  # a task keeps offset + limit rows of a key
    groups = {}
    for r in every.collect():
        groups.setdefault((r["period"], r["category_id"]), []).append(r)
    want = set()
    for rows in groups.values():
        rows.sort(key=lambda r: (-r["order_amount"], (r["price"] is not None, r["price"]), r["product_id"]))
        want |= {(r["period"], r["category_id"], r["product_id"], len(rows)) for r in rows[1:3]}
    assert {(r["period"], r["category_id"], r["product_id"], r["total_row_count"]) for r in paged.collect()} == want


def test_snapshots_keep_all_columns_and_skip_files(spark, tmp_path):
    wide = flatten_products(X.product_events(spark, SF))
    # three months: a copy of the rows in each
    months = [wide.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {31 * m} DAYS")) for m in range(3)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that small slices stay apart
    try:
        for m in months:
            IO.append_snapshots(m, str(tmp_path), slices=4)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = IO.read_snapshots(spark, str(tmp_path))
    assert len(back.columns) == 28 and back.count() == 3 * wide.count()  # 27 and the month
    some = ["ts", "product_id", "sku_id", "attributes", "tags", "seller_rating", "seller_orders", "is_eco", "is_adult"]
    assert (back.filter("yyyymm = 202401").select(*some).exceptAll(months[0].select(*some)).count() == 0)
    # a month is in several files, and each product of a month in one of them
    files = back.select("yyyymm", "product_id", F.input_file_name().alias("file")).distinct()
    assert files.groupBy("yyyymm", "product_id").count().agg(F.max("count")).first()[0] <= 2  # two appends may share a month
    assert files.select("yyyymm", "file").distinct().groupBy("yyyymm").count().agg(F.min("count")).first()[0] > 1
    # narrow rows: the other columns are null
    IO.append_snapshots(X.snap_events(spark, SF), str(tmp_path / "narrow"))
    assert IO.read_snapshots(spark, str(tmp_path / "narrow")).filter("is_eco IS NOT NULL OR tags IS NOT NULL").count() == 0
