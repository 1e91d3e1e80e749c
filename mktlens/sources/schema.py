"""Fixed schemas of the data model (snapshot facts, daily states, dimensions).

All money is integer minor units (1/100). Ids are ``long`` everywhere.
"""

from __future__ import annotations

from pyspark.sql import types as T

L, S, D, TS = T.LongType(), T.StringType(), T.DateType(), T.TimestampNTZType()
RATING = T.DecimalType(9, 2)

SNAPSHOT = T.StructType([
    T.StructField("ts", TS, False),
    T.StructField("product_id", L, False),
    T.StructField("sku_id", L, False),
    T.StructField("title", S),
    T.StructField("rating", RATING),
    T.StructField("category_id", L, False),
    T.StructField("reviews_amount", L),
    T.StructField("total_orders_amount", L),
    T.StructField("total_available_amount", L),
    T.StructField("available_amount", L),
    T.StructField("photo_key", S),
    T.StructField("seller_id", L),
    T.StructField("seller_account_id", L),
    T.StructField("seller_title", S),
    T.StructField("seller_link", S),
    T.StructField("full_price", L, True),
    T.StructField("purchase_price", L),
])

# The columns of a stored snapshot that only product events carry; null where rows come from elsewhere.
SNAPSHOT_STORED = T.StructType([
    *SNAPSHOT.fields,
    T.StructField("attributes", T.ArrayType(S)),
    T.StructField("tags", T.ArrayType(S)),
    T.StructField("characteristics", T.MapType(S, S)),
    T.StructField("seller_registration_date", TS),
    T.StructField("seller_rating", RATING),
    T.StructField("seller_reviews_count", L),
    T.StructField("seller_orders", L),
    T.StructField("seller_contacts", T.MapType(S, S)),
    T.StructField("is_eco", T.BooleanType()),
    T.StructField("is_adult", T.BooleanType()),
])

POSITION = T.StructType([
    T.StructField("ts", TS, False),
    T.StructField("product_id", L, False),
    T.StructField("sku_id", L, False),
    T.StructField("category_id", L, False),
    T.StructField("position", L, False),
])

PRICE_HIST = T.ArrayType(T.StructType([T.StructField("price", L), T.StructField("n", L)]))

# The "last value seen" state: ordered by (ts, sku_id) so that a merge of states
# is ``max`` of the struct (see operators.daily).
LAST_STATE = T.StructType([
    T.StructField("ts", TS), T.StructField("sku_id", L), T.StructField("title", S),
    T.StructField("photo_key", S), T.StructField("reviews_amount", L),
    T.StructField("available_amount", L), T.StructField("category_id", L),
])

DAILY = T.StructType([
    T.StructField("date", D, False),
    T.StructField("product_id", L, False),
    T.StructField("sku_id", L, False),
    T.StructField("category_id", L),
    T.StructField("min_total_order_amount", L),
    T.StructField("max_total_order_amount", L),
    T.StructField("min_available_amount", L),
    T.StructField("max_available_amount", L),
    T.StructField("price_hist", PRICE_HIST),
    T.StructField("full_price_hist", PRICE_HIST),
    T.StructField("seller_id", L),
    T.StructField("seller_account_id", L),
    T.StructField("seller_title", S),
    T.StructField("seller_link", S),
    T.StructField("rating", RATING),
    T.StructField("last", LAST_STATE),
])

# The daily table as stored: also the columns that only product events carry (null for rows from elsewhere).
DAILY_STORED = T.StructType([
    *DAILY.fields,
    T.StructField("seller_registration_date", TS),
    T.StructField("is_eco", T.BooleanType()),
    T.StructField("is_adult", T.BooleanType()),
])

CATEGORY = T.StructType([
    T.StructField("category_id", L, False),
    T.StructField("parent_category_id", L, False),
    T.StructField("title", S),
])

SELLER = T.StructType([
    T.StructField("seller_id", L, False),
    T.StructField("account_id", L, False),
    T.StructField("link", S),
    T.StructField("title", S),
])
