"""Storage: snapshot / position tables, layouts, retention, rollup partitions, upserts, reports.

Tables are Parquet directories. Snapshots are partitioned by month
(``yyyymm``), dealt by product and sorted by (product_id, sku_id, ts) inside
each file, so partition pruning, row-group min/max skipping and bloom filters
apply to the usual filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import DAILY_STORED, POSITION, SNAPSHOT_STORED


def yyyymm(ts: Column) -> Column:
    """Month key of a timestamp."""
    return F.date_format(ts, "yyyyMM").cast("int")


def _append_clustered(df: DataFrame, path: str, sort: list[str], slices: int) -> None:
    """Append by month; a month's products are dealt over ``slices`` tasks and files, sorted, with a bloom filter on product_id.

    A day's append of one month thus is never one task, and a product's rows of a month lie in one file:
    row-group statistics and the filter let a read for some products skip the others.
    """
    product_slice = F.pmod(F.xxhash64("product_id"), F.lit(slices))
    (df.withColumn("yyyymm", yyyymm(F.col("ts"))).repartition("yyyymm", product_slice)
     .sortWithinPartitions("yyyymm", *sort)
     .write.mode("append").option("parquet.bloom.filter.enabled#product_id", "true")
     .option("parquet.bloom.filter.expected.ndv#product_id", "1000000").option("parquet.bloom.filter.adaptive.enabled", "true")
     .partitionBy("yyyymm").parquet(path))


def _with_all_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema``; those ``df`` does not have are null."""
    have = set(df.columns)
    return df.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def append_snapshots(df: DataFrame, path: str, slices: int = 16) -> None:
    """Append snapshots with all 27 columns; those ``df`` does not have are null."""
    _append_clustered(_with_all_columns(df, SNAPSHOT_STORED), path, ["product_id", "sku_id", "ts"], slices)


def append_positions(df: DataFrame, path: str, slices: int = 16) -> None:
    """S10."""
    _append_clustered(df.select(*[c.name for c in POSITION]), path, ["category_id", "product_id", "sku_id", "ts"], slices)


def read_snapshots(spark: SparkSession, path: str, ts_from: str | None = None, ts_to: str | None = None) -> DataFrame:
    """All 27 columns with the fixed schema; a time range also prunes month partitions."""
    schema = T.StructType([*SNAPSHOT_STORED.fields, T.StructField("yyyymm", T.IntegerType())])
    df = spark.read.schema(schema).parquet(path)
    if ts_from is not None:
        lo = F.lit(ts_from).cast("timestamp_ntz")
        hi = F.lit(ts_to).cast("timestamp_ntz")
        df = df.filter(F.col("yyyymm").between(yyyymm(lo), yyyymm(hi)) & F.col("ts").between(lo, hi))
    return df


def write_layout(df: DataFrame, path: str, by: list[str]) -> None:
    """A second physical copy ordered by ``by`` (e.g. (category_id, date) or (seller_link, date)).

    Range partitioning keeps each file to a contiguous key range, so Parquet
    min/max statistics skip files for equality / range filters on ``by``.
    """
    df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").parquet(path)


def apply_retention(df: DataFrame, ts_col: str, as_of: str, months: int = 0, hours: int = 0,
                    days: int = 0) -> DataFrame:
    """Keep rows newer than ``as_of`` minus the interval (snapshots 4 months, positions 1, rollups 3 days)."""
    a = F.lit(as_of).cast("timestamp_ntz")
    cutoff = F.add_months(a, -months).cast("timestamp_ntz") if months else a
    if days or hours:
        cutoff = cutoff - F.make_dt_interval(F.lit(days), F.lit(hours))
    return df.filter(F.col(ts_col) > cutoff)


def write_rollup(df: DataFrame, path: str, partition_cols: tuple[str, ...] = ("period", "as_of")) -> None:
    """Idempotent rollup write -- only the (period, as_of) partitions present in ``df`` are replaced."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_cols).parquet(path))


def upsert(existing: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed merge, an update replaces the existing row with the same key (latest update wins).

    ``updates`` may carry an ``update_seq`` column ordering several updates of a key.
    """
    cols = [c for c in existing.columns]
    seq = F.col("update_seq") if "update_seq" in updates.columns else F.lit(0)
    u = updates.select(*cols, F.lit(1).alias("_src"), seq.cast("long").alias("_seq"))
    e = existing.select(*cols, F.lit(0).alias("_src"), F.lit(0).cast("long").alias("_seq"))
    payload = [c for c in cols if c not in keys]
    return (e.unionByName(u).groupBy(*keys)
            .agg(F.max_by(F.struct(*payload), F.struct("_src", "_seq")).alias("_row"))
            .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in payload]))


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Report rows as a table (one directory per report job)."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read a Parquet table, with its fixed schema when given (no inference)."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """S2."""
    return read_table(spark, path, T.StructType([*POSITION.fields, T.StructField("yyyymm", T.IntegerType())]))


def write_daily(df: DataFrame, path: str, slices: int = 16) -> None:
    """Store daily states by date. Only the dates in ``df`` are replaced; the products of a date are dealt over
    ``slices`` tasks and files and sorted, so a day is never one task and reads of some products skip row groups."""
    product_slice = F.pmod(F.xxhash64("product_id"), F.lit(slices))
    (_with_all_columns(df, DAILY_STORED).repartition("date", product_slice).sortWithinPartitions("date", "product_id", "sku_id")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path))


def read_daily(spark: SparkSession, path: str, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """S3: stored daily states with the registration date and flags (merged at read time, see
    ``operators.daily.merge_daily``); a range of dates prunes folders."""
    df = read_table(spark, path, DAILY_STORED).select(*DAILY_STORED.names)
    if date_from is not None:
        df = df.filter(F.col("date").between(F.lit(date_from).cast("date"), F.lit(date_to).cast("date")))
    return df


def read_rollup(spark: SparkSession, path: str, period: str, as_of: str | None = None) -> DataFrame:
    """A period rollup; the (period, as_of) partition filter prunes directories."""
    df = spark.read.parquet(path).filter(F.col("period") == period)
    if as_of is not None:
        df = df.filter(F.col("as_of") == F.lit(as_of).cast("date"))
    return df
