"""Skew-aware running sums.

A plain ``sum().over(partitionBy(key).orderBy(...))`` sends every row of a key
to one task; one hot key can hold a third of all rows. The running sum is
split in two levels instead:

1. per (key, bucket) totals (partial aggregation, map-side combine), then a
   prefix over buckets per key -- a window over at most #buckets rows per key;
2. the running sum inside each (key, bucket), a window whose partitions are
   bounded by one bucket of one key.

The result is ``prefix(bucket) + running(within bucket)``, identical to the
single window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, key: str | list[str], bucket: Column | str, order_cols: list[str],
                value: Column, out: str) -> DataFrame:
    return running_aggs(df, key, bucket, order_cols, {out: ("sum", value)})


def running_sums(df: DataFrame, key: str | list[str], bucket: Column | str, order_cols: list[str],
                 values: dict[str, Column]) -> DataFrame:
    """Several running sums over the same key and order in one pass (one set of shuffles)."""
    return running_aggs(df, key, bucket, order_cols, {n: ("sum", v) for n, v in values.items()})


_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def running_aggs(df: DataFrame, key: str | list[str], bucket: Column | str, order_cols: list[str],
                 values: dict[str, tuple[str, Column]]) -> DataFrame:
    """Running sum / max / min per key in ``order_cols`` order, split by ``bucket``.

    ``bucket`` must be monotone in the order (e.g. the day of the ordering
    timestamp). Result = combine(prefix over earlier buckets, running value
    inside the bucket); the only window over raw rows is partitioned by
    (key, bucket).
    """
    keys = [key] if isinstance(key, str) else list(key)
    names = list(values)
    # a named bucket column is used as is, so the (key, bucket) partitioning of the
    # window survives and later aggregations on (key, bucket, ...) need no new shuffle
    b = bucket if isinstance(bucket, str) else "_rs_bucket"
    if not isinstance(bucket, str):
        df = df.withColumn(b, bucket)
    for i, n in enumerate(names):
        df = df.withColumn(f"_rs_v{i}", values[n][1])
    fn = [_AGG[values[n][0]] for n in names]
    prev = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = df.groupBy(*keys, b).agg(*[fn[i](f"_rs_v{i}").alias(f"_rs_b{i}")
                                                       for i in range(len(names))])
    per_bucket = per_bucket.select(*keys, b, *[
        fn[i](f"_rs_b{i}").over(prev).alias(f"_rs_p{i}") for i in range(len(names))])
    inner = Window.partitionBy(*keys, b).orderBy(*order_cols).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    for i in range(len(names)):
        df = df.withColumn(f"_rs_in{i}", fn[i](f"_rs_v{i}").over(inner))
    df = df.join(per_bucket, [*keys, b])
    for i, n in enumerate(names):
        p, c = F.col(f"_rs_p{i}"), F.col(f"_rs_in{i}")
        if values[n][0] == "sum":
            df = df.withColumn(n, F.coalesce(p, F.lit(0)) + c)
        elif values[n][0] == "max":
            df = df.withColumn(n, F.when(p.isNull(), c).otherwise(F.greatest(p, c)))
        else:
            df = df.withColumn(n, F.when(p.isNull(), c).otherwise(F.least(p, c)))
    drop = [f"_rs_{t}{i}" for t in ("v", "in", "p") for i in range(len(names))]
    return df.drop(*(drop + ([] if isinstance(bucket, str) else [b])))
