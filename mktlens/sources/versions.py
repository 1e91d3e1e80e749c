"""Stored tables of versioned parts: copy on write, a manifest that points at each part's files.

``root/data/version=V/part=P`` holds the files of a part (a key bucket, a day, a month) as version
V wrote them; ``root/manifest/version=V`` says, for every part of the table, which version's files
count. A change writes the files of the parts it touches, then one manifest: readers see the
table before or after it, never in between, and files of other parts stay as they are. Running a
version again replaces its own files and manifest only, so a replayed batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .io import upsert

MANIFEST = "part string, at long"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, in whatever file system it names; other errors are errors."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def manifest(spark: SparkSession, root: str, before: int | None = None) -> tuple[int, dict[str, int]]:
    """(version, {part: version of its files}) of the newest manifest, or the newest before a version; -1 and {} without one."""
    if not path_exists(spark, f"{root}/manifest"):
        return -1, {}
    rows = spark.read.schema(MANIFEST + ", version long").parquet(f"{root}/manifest")
    if before is not None:
        rows = rows.filter(F.col("version") < before)
    newest = rows.agg(F.max("version")).first()[0]
    if newest is None:
        return -1, {}
    found = rows.filter(F.col("version") == newest).collect()  # a row a part
    return newest, {r["part"]: r["at"] for r in found if r["part"] is not None}


def publish(spark: SparkSession, root: str, version: int, parts: dict[str, int]) -> None:
    """Make these the table's parts. A row without a part marks the version of an empty table."""
    rows = [(None, version), *sorted(parts.items())]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/version={version}")


def replace_parts(df: DataFrame, root: str, version: int, part: Column) -> list[str]:
    """Write the rows of ``df`` as the whole content of the parts they fall into; returns these parts.

    Rows are rebalanced by part first: a small part becomes one file, a part that holds a large share of the rows is
    split over many tasks.
    """
    spark = df.sparkSession
    data = f"{root}/data/version={version}"
    rows = df.withColumn("part", part.cast("string")).hint("rebalance", F.col("part"))
    rows.write.mode("overwrite").partitionBy("part").parquet(data)
    written = [r["part"] for r in spark.read.schema(T.StructType([T.StructField("part", T.StringType())])).parquet(data).distinct().collect()]
    publish(spark, root, version, manifest(spark, root, version)[1] | dict.fromkeys(written, version))
    return written


def read_parts(spark: SparkSession, root: str, schema: T.StructType, parts: list[str] | None = None,
               before: int | None = None) -> DataFrame:
    """The table, or some parts of it, at its newest manifest (or the newest before a version)."""
    at = manifest(spark, root, before)[1]
    paths = [f"{root}/data/version={v}/part={p}" for p, v in sorted(at.items()) if parts is None or p in parts]
    if not paths:
        return spark.createDataFrame([], schema)
    names = [f.name for f in schema.fields]
    return spark.read.schema(schema).option("basePath", f"{root}/data").parquet(*paths).select(*names)


def merge_keyed(updates: DataFrame, root: str, version: int, keys: list[str], schema: T.StructType, buckets: int = 64) -> list[str]:
    """Keyed merge into the stored table; only the key buckets that the updates touch are rewritten.

    ``updates`` may carry ``update_seq`` (see ``io.upsert``). Returns the rewritten buckets.
    """
    return fold_keyed(updates, root, version, keys, schema, lambda existing: upsert(existing, updates, keys), buckets)


def fold_keyed(updates: DataFrame, root: str, version: int, keys: list[str], schema: T.StructType,
               fold: Callable[[DataFrame], DataFrame], buckets: int = 64) -> list[str]:
    """Rewrite the key buckets that the updates touch as ``fold`` of their rows so far; returns these buckets."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string")
    touched = [r[0] for r in updates.select(bucket).distinct().collect()]  # at most ``buckets`` rows
    if not touched:
        return []
    existing = read_parts(updates.sparkSession, root, schema, touched, before=version)
    return replace_parts(fold(existing), root, version, bucket)


def retain_parts(spark: SparkSession, root: str, version: int, lowest: str, border: str | None = None,
                 keep: Column | None = None, schema: T.StructType | None = None) -> list[str]:
    """Drop the parts below ``lowest`` from the manifest; the ``border`` part keeps the rows that ``keep`` holds for.

    Dropped files stay on disk, for readers that began before, until ``vacuum_paths`` names them.
    """
    at = manifest(spark, root, version)[1]
    left = {p: v for p, v in at.items() if p >= lowest}
    if border in left and keep is not None:
        rows = read_parts(spark, root, schema, [border], before=version).filter(keep)
        data = f"{root}/data/version={version}"
        rows.withColumn("part", F.lit(border)).write.mode("overwrite").partitionBy("part").parquet(data)
        del left[border]
        if path_exists(spark, f"{data}/part={border}"):
            left[border] = version
    publish(spark, root, version, left)
    return sorted(set(at) - set(left))


def retain_months(spark: SparkSession, root: str, version: int, ts_col: str, as_of: str, months: int, schema: T.StructType) -> list[str]:
    """S15 for a table whose parts are months (yyyyMM): keep the rows newer than ``as_of`` minus ``months``.

    Months that are older as a whole leave the manifest unread, the month of the bound is rewritten, the others
    keep their files. Returns the months that left.
    """
    bound = spark.range(1).select(F.add_months(F.lit(as_of).cast("date"), -months)).first()[0]
    keep = F.col(ts_col) > F.lit(bound).cast("timestamp_ntz")
    return retain_parts(spark, root, version, f"{bound:%Y%m}", f"{bound:%Y%m}", keep, schema)


def vacuum_paths(spark: SparkSession, root: str) -> list[str]:
    """Folders of parts that the newest manifest doesn't point at any more."""
    now = {f"version={v}/part={p}" for p, v in manifest(spark, root)[1].items()}
    every = spark.read.schema("part string, version long").parquet(f"{root}/data").select("version", "part").distinct().collect()
    return sorted(f"{root}/data/version={r['version']}/part={r['part']}" for r in every
                  if f"version={r['version']}/part={r['part']}" not in now)
