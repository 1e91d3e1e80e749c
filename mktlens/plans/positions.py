"""Position history (Q15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.charts import calendar_fill
from ..operators.daily import ts_between


def position_history(pos: DataFrame, date_from: str, date_to: str) -> DataFrame:
    """Last position per (category, product, sku) and day over [from, to) midnights, missing days = 0.

    ``date_to`` itself appears only for a snapshot taken exactly at its midnight.
    """
    p = ts_between(pos, f"{date_from} 00:00:00", f"{date_to} 00:00:00").withColumn("date", F.to_date("ts"))
    day = p.groupBy("category_id", "product_id", "sku_id", "date").agg(F.max_by("position", "ts").alias("position"))
    return calendar_fill(day, ["category_id", "product_id", "sku_id"], date_from, date_to, {"position": 0})
