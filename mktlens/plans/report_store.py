"""Stored reports: the rows of every requested report in one job, committed report by report.

``root/rows/run=R/report=K`` holds the rows of a report as run R computed them, once for all requests
that ask for the same (type, key, interval); ``root/status/run=R`` has one row a request of the run,
written after the rows. A report counts once its status row is there: readers start from the status,
so a run that died half way leaves nothing to be seen. Running a number again replaces that run only;
a later run answers the requests that no earlier one has answered.

A request without rows, or without a key, is 'failed'. Repeated requests get a status each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.daily import product_days, with_orders
from ..operators.filters import page
from ..sources.io import write_report
from ..sources.versions import path_exists
from .reports import report_base, report_key, requested_rows, with_classes
from .sellers import sales_report_rows

STATUS = "report_id long, report string, status string, row_count long, total_orders long, total_revenue double, run int"
# Fixed value: files that the rows of one large report are spread over.
SLICES = 16


def build_reports(requests: DataFrame, daily: DataFrame, scope: DataFrame, categories: DataFrame, as_of: str) -> DataFrame:
    """Q7 / Q8 with R1-R4 for every distinct request: the 11 report columns by ``report``."""
    return with_classes(unclassed_reports(requests, daily, scope, categories, as_of), "report")


def unclassed_reports(requests: DataFrame, daily: DataFrame, scope: DataFrame, categories: DataFrame, as_of: str) -> DataFrame:
    tagged = requested_rows(requests, daily, scope, as_of).withColumn("report", report_key())
    days = with_orders(product_days(tagged, ["report"]), ["report"])
    return report_base(sales_report_rows(days, "report", categories), "report")


def read_status(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """The committed requests, of runs before a number if one is given."""
    schema = T._parse_datatype_string(STATUS)
    if not path_exists(spark, f"{root}/status"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(f"{root}/status")
    return rows if before is None else rows.filter(F.col("run") < before)


def run_reports(requests: DataFrame, daily: DataFrame, scope: DataFrame, categories: DataFrame, as_of: str, root: str,
                run: int) -> DataFrame:
    """One batch: compute and store what earlier runs have not answered; returns the status rows of the run."""
    spark = requests.sparkSession
    open_requests = requests.join(read_status(spark, root, before=run), "report_id", "left_anti")
    # the rows feed the classes of two columns: written first, so that they are computed once
    base = unclassed_reports(open_requests, daily, scope, categories, as_of)
    base.write.mode("overwrite").parquet(f"{root}/work/run={run}")
    rows = with_classes(spark.read.schema(base.schema).parquet(f"{root}/work/run={run}"), "report")
    # a report may hold a third of all rows: its products are dealt over SLICES tasks, each file sorted for paged reads
    (rows.withColumn("_slice", F.pmod(F.xxhash64("product_id"), F.lit(SLICES))).repartition("report", "_slice").drop("_slice")
     .sortWithinPartitions("report", "product_id")
     .write.mode("overwrite").partitionBy("report").parquet(f"{root}/rows/run={run}"))
    sums = (_stored_rows(spark, root, rows.schema).filter(F.col("run") == run).groupBy("report")
            .agg(F.count(F.lit(1)).alias("row_count"), F.sum("orders").alias("total_orders"), F.sum("revenue").alias("total_revenue")))
    answered = (open_requests.select("report_id", report_key().alias("report")).join(sums, "report", "left")
                .select("report_id", "report", F.when(F.col("row_count") > 0, "completed").otherwise("failed").alias("status"),
                        F.coalesce("row_count", F.lit(0).cast("long")).alias("row_count"),
                        F.coalesce("total_orders", F.lit(0).cast("long")).alias("total_orders"),
                        F.coalesce("total_revenue", F.lit(0.0)).alias("total_revenue")))
    answered.write.mode("overwrite").parquet(f"{root}/status/run={run}")
    return read_status(spark, root).filter(F.col("run") == run)


def _stored_rows(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    fields = [f for f in schema.fields if f.name not in ("report", "run")]
    parts = [T.StructField("run", T.IntegerType()), T.StructField("report", T.StringType())]
    return spark.read.schema(T.StructType([*fields, *parts])).parquet(f"{root}/rows")


def read_reports(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The rows of all committed reports, once a report, with the number of requests that share it."""
    shared = (read_status(spark, root).filter(F.col("status") == "completed")
              .groupBy("run", "report").agg(F.count(F.lit(1)).alias("requests")))
    return _stored_rows(spark, root, schema).join(shared, ["run", "report"])


def read_report(spark: SparkSession, root: str, schema: T.StructType, report_id: int, limit: int | None = None,
                offset: int = 0) -> DataFrame:
    """The rows of one request, or a page of them by product; only the folder of its report is read.

    No rows for an unknown, unfinished or failed request. A report id that was asked twice in one run
    is read once; of several runs the first counts.
    """
    asked = read_status(spark, root).filter((F.col("report_id") == report_id) & (F.col("status") == "completed"))
    found = asked.orderBy("run", "report").limit(1).collect()  # one row
    rows = _stored_rows(spark, root, schema)
    if not found:
        return rows.filter(F.lit(False))
    one = rows.filter((F.col("run") == found[0]["run"]) & (F.col("report") == found[0]["report"]))
    return page(one, ["report"], [F.col("product_id").asc()], limit, offset)


def export_report(spark: SparkSession, root: str, schema: T.StructType, report_id: int, path: str, fmt: str = "csv") -> None:
    """One request's rows as a file table."""
    write_report(read_report(spark, root, schema, report_id).drop("run", "report"), path, fmt)
