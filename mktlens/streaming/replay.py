"""Replays of events through the streaming jobs, for queries and checks on stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.events import POSITION_EVENT, PRODUCT_EVENT
from ..sources.versions import merge_keyed, read_parts
from .ingest import ingest_stream, scratch_root

MIXED_EVENT = T.StructType([T.StructField("product", PRODUCT_EVENT), T.StructField("position", POSITION_EVENT),
                            T.StructField("category", T.VariantType())])


def _files(spark: SparkSession, path: str) -> int:
    """How many files of events a folder holds."""
    return len(spark.read.schema(MIXED_EVENT).json(path).inputFiles())


def ingested_table(spark: SparkSession, sink: str, events: DataFrame, before: DataFrame, keys: list[str], schema: T.StructType,
                   n_files: int = 3) -> DataFrame:
    """The stored table of a sink of ``ingest_stream`` after ``events`` were streamed into it.

    ``events`` has a column ``product``, ``position`` or ``category`` with the payload; ``before`` is what the table
    held. The events arrive in files of a size (``n_files`` at least), about ``n_files`` micro-batches of them.
    """
    root = scratch_root(spark, "ingest")
    merge_keyed(before, f"{root}/{sink}", -1, keys, schema)
    source = f"{root}/source"
    events.hint("rebalance").write.json(source)  # tasks and files of a size, however many events there are
    if _files(spark, source) < n_files:  # few events
        events.repartition(n_files).write.mode("overwrite").json(source)
    ingest_stream(spark, source, MIXED_EVENT, {sink: f"{root}/{sink}"}, f"{root}/checkpoint",
                  -(-_files(spark, source) // n_files) or 1).awaitTermination()
    return read_parts(spark, f"{root}/{sink}", schema)
