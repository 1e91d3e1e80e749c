"""Ingest transforms for crawler events (I1-I10): routing, flattening, unit conversion.

They are plain DataFrame functions, so the same code runs on a batch of files
and inside ``foreachBatch`` of a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize_dimension
from ..functions.numeric import to_minor

KV = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("title", T.StringType()),
                               T.StructField("value", T.StringType())]))
CONTACTS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("value", T.StringType())]))
SKU = T.StructType([
    T.StructField("sku_id", T.LongType()), T.StructField("photo_key", T.StringType()),
    T.StructField("characteristics", KV), T.StructField("purchase_price", T.StringType()),
    T.StructField("full_price", T.StringType()), T.StructField("available_amount", T.LongType())])
SELLER = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("account_id", T.LongType()),
    T.StructField("seller_link", T.StringType()), T.StructField("seller_title", T.StringType()),
    T.StructField("reviews", T.LongType()), T.StructField("orders", T.LongType()),
    T.StructField("rating", T.StringType()), T.StructField("registration_date", T.LongType()),
    T.StructField("contacts", CONTACTS)])
CATEGORY_REF = T.StructType([T.StructField("id", T.LongType()), T.StructField("title", T.StringType()),
                             T.StructField("product_amount", T.LongType())])
PRODUCT_EVENT = T.StructType([
    T.StructField("product_id", T.LongType()), T.StructField("time", T.LongType()),
    T.StructField("title", T.StringType()), T.StructField("total_available_amount", T.LongType()),
    T.StructField("orders", T.LongType()), T.StructField("attributes", T.ArrayType(T.StringType())),
    T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("reviews_amount", T.LongType()),
    T.StructField("rating", T.StringType()), T.StructField("sku_list", T.ArrayType(SKU)),
    T.StructField("seller", SELLER), T.StructField("category", CATEGORY_REF),
    T.StructField("is_eco", T.BooleanType()), T.StructField("is_adult", T.BooleanType())])
POSITION_EVENT = T.StructType([
    T.StructField("position", T.LongType()), T.StructField("product_id", T.LongType()),
    T.StructField("sku_id", T.LongType()), T.StructField("category_id", T.LongType()),
    T.StructField("time", T.LongType())])


def route_events(events: DataFrame) -> dict[str, DataFrame]:
    """Split mixed events by payload; rows with none of the known payloads are dropped."""
    return {name: events.filter(F.col(name).isNotNull()).select(
                f"{name}.*" if isinstance(events.schema[name].dataType, T.StructType) else name)
            for name in ("product", "category", "position") if name in events.columns}


def epoch_to_ts(col: Column) -> Column:
    """Epoch seconds -> UTC wall-clock timestamp without time zone (no session time zone involved)."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), col.cast("decimal(18,6)"))


def list_to_map_last(col: Column, key: str = "type", value: str = "value") -> Column:
    """I4: list of (key, value) -> map in order of its keys; the last duplicate wins (independent of the session's dedup policy)."""
    empty = F.create_map().cast(T.MapType(T.StringType(), T.StringType()))
    last = F.aggregate(col, empty, lambda acc, e: F.map_concat(
        F.map_filter(acc, lambda k, v: k != e[key]), F.create_map(e[key], e[value])))
    return F.map_from_entries(F.array_sort(F.map_entries(last)))


def list_to_map_strict(col: Column, key: str = "type", value: str = "value") -> Column:
    """List of (key, value) -> map; a duplicate key is an error (Spark's default map policy)."""
    return F.map_from_arrays(F.transform(col, lambda e: e[key]), F.transform(col, lambda e: e[value]))


def flatten_products(events: DataFrame) -> DataFrame:
    """One snapshot row per SKU of each product event, product and seller fields repeated."""
    e = events.select("*", F.explode("sku_list").alias("sku"))
    return e.select(
        epoch_to_ts(F.col("time")).alias("ts"),
        "product_id", F.col("sku.sku_id").alias("sku_id"), "title",
        F.col("rating").cast("decimal(9,2)").alias("rating"),
        F.col("category.id").alias("category_id"),  # I6: the leaf of the category chain
        "reviews_amount", F.col("orders").alias("total_orders_amount"), "total_available_amount",
        F.col("sku.available_amount").alias("available_amount"),
        "attributes", "tags", F.col("sku.photo_key").alias("photo_key"),
        list_to_map_last(F.col("sku.characteristics"), value="title").alias("characteristics"),
        F.col("seller.id").alias("seller_id"), F.col("seller.account_id").alias("seller_account_id"),
        F.col("seller.seller_title").alias("seller_title"), F.col("seller.seller_link").alias("seller_link"),
        epoch_to_ts(F.col("seller.registration_date")).alias("seller_registration_date"),
        F.col("seller.rating").cast("decimal(9,2)").alias("seller_rating"),
        F.col("seller.reviews").alias("seller_reviews_count"), F.col("seller.orders").alias("seller_orders"),
        list_to_map_strict(F.col("seller.contacts")).alias("seller_contacts"),
        "is_eco", "is_adult",
        to_minor(F.coalesce(F.col("sku.full_price"), F.lit(""))).alias("full_price"),
        to_minor(F.col("sku.purchase_price")).alias("purchase_price"))


def extract_sellers(events: DataFrame) -> DataFrame:
    """I8: distinct sellers seen in product events, for the seller upsert: of several rows the latest event's, then the greatest."""
    key = [F.col("seller.id").alias("seller_id"), F.col("seller.account_id").alias("account_id")]
    seen = F.struct(F.col("seller.seller_link").alias("link"), F.col("seller.seller_title").alias("title"))
    return (events.groupBy(*key).agg(F.max(F.struct("time", seen.alias("seen"))).alias("last"), F.max("time").alias("update_seq"))
            .select("seller_id", "account_id", "last.seen.link", "last.seen.title", "update_seq"))


def category_nodes(events: DataFrame, col: str | None = None) -> DataFrame:
    """(node VARIANT): the category trees of events, given as a VARIANT, JSON text or typed struct column, or as whole typed rows."""
    if col is None:
        return events.select(F.to_variant_object(F.struct("*")).alias("node"))
    kind = events.schema[col].dataType
    rows = events.filter(F.col(col).isNotNull())
    if isinstance(kind, T.StringType):
        return rows.select(F.parse_json(col).alias("node"))
    return rows.select((F.col(col) if isinstance(kind, T.VariantType) else F.to_variant_object(F.col(col))).alias("node"))


def flatten_categories(nodes: DataFrame) -> DataFrame:
    """Category trees (``category_nodes``) of any depth -> (category_id, parent_category_id, title); roots get parent 0.

    The trees are walked level by level until no node has a child; each level is stored reliably before the next.
    """
    level, out = nodes.select("node", F.lit(0).cast("long").alias("parent_category_id")), None
    while True:
        level = materialize_dimension(level)
        if out is not None and level.isEmpty():
            return out
        rows = level.select(F.variant_get("node", "$.id", "bigint").alias("category_id"), "parent_category_id",
                            F.variant_get("node", "$.title", "string").alias("title"))
        out = rows if out is None else out.unionByName(rows)
        level = level.select(F.variant_get("node", "$.id", "bigint").alias("parent_category_id"),
                             F.explode(F.variant_get("node", "$.children", "array<variant>")).alias("node"))


def map_positions(events: DataFrame) -> DataFrame:
    """Position event -> position row."""
    return events.select(epoch_to_ts(F.col("time")).alias("ts"), "product_id", "sku_id", "category_id", "position")
