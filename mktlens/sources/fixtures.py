"""Adapters from the driver's parquet tables to the marketplace data model.

Every adapter is a pure column function of the input tables (see FIXTURES.md),
so the DuckDB oracle can build the very same rows (``mktlens.oracle.fixtures``).
Nothing here collects to the driver; all of it is lazily planned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.running import running_sum, running_sums

# Fixed values of the fixtures (chosen for this repository, see FIXTURES.md).
EVENTS_AS_OF = "2024-01-31"
LINEITEM_AS_OF = "2000-06-30"
PLAN_NAMES = ["demo", "default", "advanced", "pro"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def snap_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense intra-day snapshots, 2024-01-01 .. 2024-01-30 (one product per user)."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    ev = ev.withColumn("date", F.to_date("ts"))
    ev = running_sums(ev, "user_id", "date", ["ts", "event_id"],
                      {"total_orders_amount": (F.col("event_type") == "purchase").cast("long"),
                       "reviews_amount": (F.col("event_type") == "view").cast("long")})
    sku = F.col("user_id") * 10 + F.col("event_id") % 3
    stock = (F.col("event_id") * 7919) % 50
    price = F.round(F.col("value") * 100).cast("long")
    seller = F.col("user_id") % 10
    return ev.select(
        "ts", "date",
        F.col("user_id").alias("product_id"),
        sku.alias("sku_id"),
        F.concat(F.lit("product "), F.col("user_id").cast("string")).alias("title"),
        (F.lit(1) + F.col("event_id") % 5).cast("decimal(9,2)").alias("rating"),
        (F.lit(2000) + F.col("user_id") % 25).alias("category_id"),
        F.col("reviews_amount").cast("long").alias("reviews_amount"),
        F.col("total_orders_amount").cast("long").alias("total_orders_amount"),
        (stock * 3).alias("total_available_amount"),
        stock.alias("available_amount"),
        F.concat(F.lit("ph"), sku.cast("string")).alias("photo_key"),
        seller.alias("seller_id"),
        (seller % 5).alias("seller_account_id"),
        F.concat(F.lit("shop "), seller.cast("string")).alias("seller_title"),
        F.concat(F.lit("seller-"), seller.cast("string")).alias("seller_link"),
        F.when(F.col("event_id") % 4 != 0, price + 100).alias("full_price"),
        price.alias("purchase_price"),
    )


def snap_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse snapshots from shipments, 1992 .. 1998 ship dates, one product per part."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    li = li.withColumn("date", F.to_date("l_shipdate"))
    li = running_sum(li, "l_partkey", "date", ["l_shipdate", "l_orderkey", "l_linenumber"],
                     F.col("l_quantity"), "total_orders_amount")
    sku = F.col("l_partkey") * 100000 + F.col("l_suppkey")
    stock = F.col("l_orderkey") % 97
    price = F.round(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("long")
    return li.select(
        F.col("l_shipdate").alias("ts"), "date",
        F.col("l_partkey").alias("product_id"),
        sku.alias("sku_id"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("title"),
        (F.lit(1) + F.col("l_linenumber") % 5).cast("decimal(9,2)").alias("rating"),
        (F.lit(3000) + F.col("l_partkey") % 40).alias("category_id"),
        F.col("l_linenumber").cast("long").alias("reviews_amount"),
        F.col("total_orders_amount").cast("long").alias("total_orders_amount"),
        (stock * 2).alias("total_available_amount"),
        stock.alias("available_amount"),
        F.concat(F.lit("ph"), sku.cast("string")).alias("photo_key"),
        F.col("l_suppkey").alias("seller_id"),
        (F.col("l_suppkey") % 7).alias("seller_account_id"),
        F.concat(F.lit("shop "), F.col("l_suppkey").cast("string")).alias("seller_title"),
        F.concat(F.lit("seller-"), F.col("l_suppkey").cast("string")).alias("seller_link"),
        F.when(F.col("l_linenumber") != 1, price + 500).alias("full_price"),
        price.alias("purchase_price"),
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-level forest: regions are roots (1000+r), nations their children (2000+n)."""
    r = table(spark, sf_dir, "region").select(
        (F.lit(1000) + F.col("r_regionkey")).cast("long").alias("category_id"),
        F.lit(0).cast("long").alias("parent_category_id"), F.col("r_name").alias("title"))
    n = table(spark, sf_dir, "nation").select(
        (F.lit(2000) + F.col("n_nationkey")).cast("long").alias("category_id"),
        (F.lit(1000) + F.col("n_regionkey")).cast("long").alias("parent_category_id"),
        F.col("n_name").alias("title"))
    return r.unionByName(n)


def categories_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-level forest over part-key residues: leaf 3000+L -> 4000+L%8 -> 5000+M%2 -> 0."""
    leaves = (table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).alias("l")).distinct())
    leaf = leaves.select((F.lit(3000) + F.col("l")).cast("long").alias("category_id"),
                         (F.lit(4000) + F.col("l") % 8).cast("long").alias("parent_category_id"),
                         F.concat(F.lit("leaf "), F.col("l").cast("string")).alias("title"))
    mid = (leaves.select((F.col("l") % 8).alias("m")).distinct()
           .select((F.lit(4000) + F.col("m")).cast("long").alias("category_id"),
                   (F.lit(5000) + F.col("m") % 2).cast("long").alias("parent_category_id"),
                   F.concat(F.lit("mid "), F.col("m").cast("string")).alias("title")))
    root = (leaves.select((F.col("l") % 2).alias("r")).distinct()
            .select((F.lit(5000) + F.col("r")).cast("long").alias("category_id"),
                    F.lit(0).cast("long").alias("parent_category_id"),
                    F.concat(F.lit("root "), F.col("r").cast("string")).alias("title")))
    return leaf.unionByName(mid).unionByName(root)


def sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("seller_id"),
        F.col("s_nationkey").cast("long").alias("account_id"),
        F.concat(F.lit("seller-"), F.col("s_suppkey").cast("string")).alias("link"),
        F.col("s_name").alias("title"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "view")
    return ev.select(
        "ts",
        F.col("user_id").alias("product_id"),
        (F.col("user_id") * 10 + F.col("event_id") % 3).alias("sku_id"),
        (F.lit(2000) + F.col("user_id") % 25).alias("category_id"),
        ((F.col("event_id") * 31) % 100 + 1).alias("position"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = F.element_at(F.array(*[F.lit(p) for p in PLAN_NAMES]), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        plan.alias("subscription_type"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 60).cast("int"))
        .alias("subscription_end_at"))


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = (F.when(F.col("o_orderstatus") == "F", "success")
              .when(F.col("o_orderstatus") == "O", "pending").otherwise("failed"))
    plan = F.element_at(F.array(*[F.lit(p) for p in PLAN_NAMES[1:]]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("payment_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("created_at"),
        status.alias("status"),
        (F.col("o_orderstatus") == "F").alias("paid"),
        F.col("o_totalprice").alias("amount"),
        plan.alias("subscription_type"),
        (F.lit(1) + F.col("o_orderkey") % 3).alias("multiply"))


def report_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report requests: type by event parity; the seller link or root category asked for; 7-28 day intervals."""
    seller = F.col("event_id") % 2 == 0
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("report_id"),
        "user_id",
        F.col("ts").alias("created_at"),
        F.when(seller, "seller").otherwise("category").alias("report_type"),
        F.when(seller, F.concat(F.lit("seller-"), (F.col("user_id") % 10).cast("string")))
        .otherwise((F.lit(1000) + F.col("user_id") % 5).cast("string")).alias("key"),
        (F.lit(7) * (F.lit(1) + F.col("event_id") % 4)).alias("interval_days"),
        F.lit("completed").alias("status"),
        F.concat(F.lit("report-"), F.col("event_id").cast("string")).alias("content"))


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("api_key"),
        (F.col("event_id") % 9).alias("ip"),
        (F.col("event_id") % 5).alias("browser"),
        "ts")


def access_requests(spark: SparkSession, sf_dir: str, as_of: str = EVENTS_AS_OF) -> DataFrame:
    """Range requests: ``days`` = event_id % 130 ending at ``as_of``."""
    days = (F.col("event_id") % 130).cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), "user_id", days.alias("days"),
        F.date_sub(F.lit(as_of).cast("date"), days).alias("from_date"))


def payment_created_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Created-payment events: every order re-sent under its own id (already known) and under a new id.

    Finished orders are created as successes, open ones as pending, others with a status of no meaning.
    """
    o = table(spark, sf_dir, "orders")
    status = (F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "pending").otherwise("held"))
    ev = lambda pid: o.select(
        pid.alias("payment_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("amount_minor"),
        (F.lit(1) + F.col("o_orderkey") % 3).alias("plan_code"),
        (F.lit(1) + F.col("o_orderkey") % 2).alias("multiply"), status.alias("status"))
    return ev(F.col("o_orderkey")).unionByName(ev(F.col("o_orderkey") + 1000000000))


def payment_status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status events from shipments: R -> canceled, A -> refunded (unknown, ignored), else by line status; odd lines also for
    the order's new id."""
    li = table(spark, sf_dir, "lineitem")
    li = li.unionByName(li.filter(F.col("l_linenumber") % 2 == 1).withColumn("l_orderkey", F.col("l_orderkey") + 1000000000))
    status = (F.when(F.col("l_returnflag") == "R", "canceled").when(F.col("l_returnflag") == "A", "refunded")
              .when(F.col("l_linestatus") == "F", "success").otherwise("pending"))
    return li.select(F.col("l_orderkey").alias("payment_id"), status.alias("status"),
                     F.col("l_shipdate").alias("event_ts"), F.col("l_linenumber").alias("event_seq"))


def _epoch_seconds(ts_ntz):
    """Epoch seconds of a wall-clock UTC timestamp, by date arithmetic (no time zone involved)."""
    return (F.datediff(F.to_date(ts_ntz), F.lit("1970-01-01").cast("date")).cast("long") * 86400
            + F.hour(ts_ntz) * 3600 + F.minute(ts_ntz) * 60 + F.second(ts_ntz))


def product_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested crawler events: one event per product and hour, one SKU entry per event row of that hour.

    Prices are decimal strings (full price '' when absent), characteristics hold
    a duplicate key (the last one must win), times are epoch seconds.
    """
    ev = table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    sid = F.col("user_id") % 10
    kv = lambda t, v: F.struct(F.lit(t).alias("type"), F.concat(F.lit(f"{t} "), v).alias("title"), v.alias("value"))
    sku = F.struct(
        (F.col("user_id") * 10 + F.col("event_id") % 3).alias("sku_id"),
        F.concat(F.lit("ph"), (F.col("user_id") * 10 + F.col("event_id") % 3).cast("string")).alias("photo_key"),
        F.array(kv("color", F.concat(F.lit("c"), (F.col("event_id") % 4).cast("string"))),
                kv("size", F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string"))),
                kv("color", F.concat(F.lit("c"), (F.col("event_id") % 7).cast("string")))).alias("characteristics"),
        F.format_string("%.3f", F.col("value")).alias("purchase_price"),
        F.when(F.col("event_id") % 4 == 0, F.lit("")).otherwise(F.format_string("%.3f", F.col("value") + 1))
        .alias("full_price"),
        ((F.col("event_id") * 7919) % 50).alias("available_amount"))
    g = (ev.groupBy("user_id", "hour")
         .agg(F.collect_list(sku).alias("sku_list"),
              F.count_if(F.col("event_type") == "purchase").alias("orders"),
              F.count_if(F.col("event_type") == "view").alias("reviews_amount"),
              F.sum((F.col("event_id") * 7919) % 50).alias("total_available_amount")))
    seller = F.struct(
        sid.alias("id"), (sid % 5).alias("account_id"),
        F.concat(F.lit("seller-"), sid.cast("string")).alias("seller_link"),
        F.concat(F.lit("shop "), sid.cast("string")).alias("seller_title"),
        (sid * 10).alias("reviews"), (sid * 100).alias("orders"),
        F.concat((sid % 5).cast("string"), F.lit(".5")).alias("rating"),
        (F.lit(1600000000) + sid * 86400).alias("registration_date"),
        F.array(F.struct(F.lit("phone").alias("type"), F.concat(F.lit("+7"), sid.cast("string")).alias("value")),
                F.struct(F.lit("email").alias("type"), F.concat(F.lit("s"), sid.cast("string"), F.lit("@shop"))
                         .alias("value"))).alias("contacts"))
    category = F.struct((F.lit(2000) + F.col("user_id") % 25).alias("id"), F.lit("leaf").alias("title"),
                        F.lit(0).cast("long").alias("product_amount"))
    return g.select(
        F.col("user_id").alias("product_id"), _epoch_seconds(F.col("hour")).alias("time"),
        F.concat(F.lit("product "), F.col("user_id").cast("string")).alias("title"),
        "total_available_amount", "orders",
        F.array(F.concat(F.lit("a"), (F.col("user_id") % 3).cast("string"))).alias("attributes"),
        F.array(F.lit("t")).alias("tags"), "reviews_amount",
        F.concat((F.col("user_id") % 5).cast("string"), F.lit(".5")).alias("rating"),
        "sku_list", seller.alias("seller"), category.alias("category"),
        (F.col("user_id") % 2 == 0).alias("is_eco"), F.lit(False).alias("is_adult"))


def category_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested category trees (root -> mid -> leaf) built from ``categories_deep``, one event per root."""
    c = categories_deep(spark, sf_dir)
    leaf = (c.filter(F.col("category_id") < 4000)
            .groupBy("parent_category_id")
            .agg(F.collect_list(F.struct(F.col("category_id").alias("id"), "title")).alias("children")))
    mid = (c.filter((F.col("category_id") >= 4000) & (F.col("category_id") < 5000))
           .join(leaf.withColumnRenamed("parent_category_id", "category_id"), "category_id", "left")
           .groupBy("parent_category_id")
           .agg(F.collect_list(F.struct(F.col("category_id").alias("id"), "title", "children")).alias("children")))
    return (c.filter(F.col("parent_category_id") == 0)
            .join(mid.withColumnRenamed("parent_category_id", "category_id"), "category_id", "left")
            .select(F.col("category_id").alias("id"), "title", "children"))


def mixed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream of mixed events: purchases carry a product payload, views a position, signups a category."""
    ev = table(spark, sf_dir, "events")
    t = _epoch_seconds(F.col("ts"))
    return ev.select(
        "event_id",
        F.when(F.col("event_type") == "purchase", F.struct(F.col("user_id").alias("product_id"), t.alias("time")))
        .alias("product"),
        F.when(F.col("event_type") == "view", F.struct(
            ((F.col("event_id") * 31) % 100 + 1).alias("position"), F.col("user_id").alias("product_id"),
            (F.col("user_id") * 10 + F.col("event_id") % 3).alias("sku_id"),
            (F.lit(2000) + F.col("user_id") % 25).alias("category_id"), t.alias("time"))).alias("position"),
        F.when(F.col("event_type") == "signup", F.struct((F.lit(2000) + F.col("user_id") % 25).alias("id"),
                                                         F.lit("c").alias("title"))).alias("category"))


def subscription_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grants, one per customer: 'set' for two market segments, 'demo' otherwise; odd nations ask for new user ids."""
    c = table(spark, sf_dir, "customer")
    new_user = F.col("c_nationkey") % 2 == 1
    plan = F.element_at(F.array(*[F.lit(p) for p in PLAN_NAMES[1:]]), (F.col("c_nationkey") % 3 + 1).cast("int"))
    return c.select(
        F.when(new_user, F.col("c_custkey") + 1000000).otherwise(F.col("c_custkey")).alias("user_id"),
        F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING"), "set").otherwise("demo").alias("kind"),
        plan.alias("subscription_type"),
        (F.lit(7) + F.col("c_custkey") % 30).cast("int").alias("days"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 20).cast("int"))
        .cast("timestamp_ntz").alias("granted_at"))
