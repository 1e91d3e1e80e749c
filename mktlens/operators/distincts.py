"""Exact distinct counts from mergeable bitmap states.

Every value (a seller, a product) first gets a dense number. The state of a
group is then one 4 KB bitmap for each 32,768 numbers: ``bitmap_construct_agg``
builds it map-side, ``bitmap_or_agg`` merges states of days, categories and
tasks, ``bitmap_count`` reads it. A group of any size is spread over its bitmaps,
nothing holds its values, and states stored per (category, day) answer any scope
and any range of days without the rows they came from.

Numbers are dealt in order of ``near`` (a seller's or product's category), so the values
of a category share few bitmaps and stored states stay compressible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATE_KEYS = ["category_id", "date"]


def dense_ids(rows: DataFrame, col: str, near: str) -> DataFrame:
    """(col, dense): the numbers 0, 1, 2, ... for the distinct non-null values of ``col``, values of one ``near`` close together.

    Numbered within hash buckets, each shifted by the sizes of the buckets before it (one
    row a bucket), so no task numbers all values; a ``near`` that holds a large share of
    them spreads over eight buckets.
    """
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = rows.filter(F.col(col).isNotNull()).groupBy(col).agg(F.min(near).alias("_near"))
    values = values.withColumn("_b", F.pmod(F.xxhash64("_near", F.pmod(F.xxhash64(col), F.lit(8))), F.lit(buckets)))
    within = Window.partitionBy("_b").orderBy("_near", col)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    starts = (values.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
              .select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    return (values.withColumn("_i", F.row_number().over(within) - 1).join(starts, "_b")
            .select(col, (F.col("_start") + F.col("_i")).alias("dense")))


def distinct_states(rows: DataFrame, col: str, keys: list[str], near: str = "category_id") -> DataFrame:
    """(keys..., entity, bucket, bits): the bitmap states of the distinct ``col`` of each group."""
    numbered = rows.select(*keys, col).join(dense_ids(rows, col, near), col)
    return (numbered.groupBy(*keys, F.bitmap_bucket_number("dense").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("dense")).alias("bits"))
            .select(*keys, F.lit(col).alias("entity"), "bucket", "bits"))


def merge_states(states: DataFrame, keys: list[str]) -> DataFrame:
    """States of coarser groups: (keys..., entity, bucket, bits)."""
    return states.groupBy(*keys, "entity", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def count_states(states: DataFrame, keys: list[str], names: dict[str, str]) -> DataFrame:
    """(keys..., one count for each entity): ``names`` maps entities to output columns; 0 where a group has none."""
    counts = [F.coalesce(F.sum(F.when(F.col("entity") == e, F.bitmap_count("bits"))), F.lit(0)).cast("long").alias(n)
              for e, n in names.items()]
    return merge_states(states, keys).groupBy(*keys).agg(*counts)


def entity_states(daily: DataFrame) -> DataFrame:
    """The states of distinct sellers and products per (category, day) of the daily table."""
    return distinct_states(daily, "seller_id", STATE_KEYS).unionByName(distinct_states(daily, "product_id", STATE_KEYS))


def write_states(states: DataFrame, path: str) -> None:
    """Store (category, day) states, one folder an entity, in order of day and category inside files."""
    (states.repartition("entity", F.pmod(F.hash("date", "category_id"), F.lit(32))).sortWithinPartitions("date", "category_id")
     .write.mode("overwrite").option("compression", "zstd").partitionBy("entity").parquet(path))


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """Stored states; a filter on ``date`` or ``entity`` prunes files and row groups."""
    return spark.read.schema("category_id long, date date, bucket long, bits binary, entity string").parquet(path)
